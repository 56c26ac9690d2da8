"""The pipeline stage by stage against plain versions, and the queries that have SQL twins."""

import pathlib

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from vitalcov.llm import common, queries

D = "/root/testdata/sf0.001"
ROOT = pathlib.Path(corpus_pipeline.__file__).parent
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "benchmark decontamination", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_every_stage(spark):
    docs = common.table(spark, D, "documents")
    passage = common.table(spark, D, "benchmark").first()["text"]
    first = docs.orderBy("doc_id").first()
    clash = [(10**6, passage, "en", "x", 1), (10**6 + 1, first["text"] + " one more word here", "en", "x", 2), (10**6 + 2, None, "en", "x", None), (10**6 + 3, "", None, None, 0)]
    extra = ["extra", "_score", "a b", "n_lines", "Kept", "_key", "rest", "x.y", "row"]
    docs = docs.unionByName(spark.createDataFrame(clash, docs.schema)).withColumns({c: F.lit("e") for c in extra})
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, D), "stage")
        held.append(docs)
        if name != "packing":
            assert docs.columns == [*COLUMNS, *extra]
            assert {tuple(r) for r in docs.select(*[f"`{c}`" for c in extra]).distinct().collect()} == {("e",) * len(extra)}
    texts = [dict(df.select("doc_id", "text").collect()) for df in held[:-1]]
    good, lined, single, clean = texts

    judged = {r["doc_id"]: r["predicted"] for r in queries.op3_quality_classifier(spark, D).collect()}
    agree = sum((i in good) == bool(p) for i, p in judged.items())
    assert agree >= 0.98 * len(judged)  # the odd rows have no label, so the model is the same up to its sample

    want = brute.line_dedup(list(good.items()))
    assert lined == {i: out[0] for (i, _), out in want.items() if out[1] == 0 or out[1] > out[2] + out[3]}
    assert {r["n_chars"] == len(r["text"] or "") for r in held[1].collect()} == {True}

    groups = brute.jaccard(list(lined.items()))
    assert single == {i: t for i, t in lined.items() if groups[i][0] == i}

    items = [tuple(r) for r in common.table(spark, D, "benchmark").select("item_id", "text").collect()]
    found = dict(zip(single, brute.decontamination(list(single.items()), items), strict=True))
    assert clean == {i: t for i, t in single.items() if not (found[i][1] and 20 * found[i][1] >= found[i][0])}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    pieces = held[-1].collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == lengths
    assert sum(r["length"] for r in pieces) == sum(lengths.values())


def test_no_text_is_lost_among_near_duplicates(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, x), (5, x), (5, y), (7, z), (7, z), (None, x), (None, "q " + z + " r"), (9, None), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, D).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, x), (5, y), (7, z), (9, None), (9, ""), (None, None)], key=str)


def test_documents_that_lose_every_line_go(spark):
    long = "a line of some length that repeats here\nand another one that is as long as that"
    rows = [(1, long), (2, long), (3, long + "\nbut this is new in three"), (4, "\n \n"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, docs, D).collect()}
    assert got == {1: (long, len(long)), 3: ("but this is new in three", 24), 4: ("\n \n", 3), 5: (None, 0), 6: ("", 0)}


def test_workers_need_no_copy_of_the_repository(spark, tmp_path):
    """The queries that broadcast, in a session whose workers cannot import the package."""
    import subprocess
    import sys

    script = tmp_path / "job.py"
    script.write_text(f"""
import os, sys
sys.path.insert(0, {str(ROOT)!r})
os.environ.pop("PYTHONPATH", None)
os.chdir({str(tmp_path)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def absent(_):
    try:
        import vitalcov
        yield False
    except ModuleNotFoundError:
        yield True
assert all(spark.sparkContext.parallelize(range(2), 2).mapPartitions(absent).collect())
from vitalcov.llm import queries
for name in ("op4_decontamination", "op8_language_id", "op11_fill_middle", "op12_embedding_whitening"):
    assert queries.QUERIES[name](spark, {D!r}).count() > 0, name
print("all ran")
""")
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_run_ends_with_pieces(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100


def test_stages_take_empty_tables(spark):
    docs = common.table(spark, D, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, D), "empty")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{D}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    have = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(have)
    assert sorted(tuple(r) for r in df.select(*have).collect()) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_all_documents(spark, name):
    rows = queries.QUERIES[name](spark, D).collect()
    key, table = ("vec_id", "embeddings") if name == "op12_embedding_whitening" else ("doc_id", "documents")
    assert len({r[key] for r in rows}) == common.table(spark, D, table).count()
    for r in rows[:50]:
        assert all(v is not None for v in r) and not any(isinstance(v, float) and np.isnan(v) for v in r)


def test_line_dedup_query_equals_plain_version(spark):
    import hashlib

    rows = [tuple(r) for r in common.table(spark, D, "documents").select("doc_id", "text").collect()]
    want = {i: (n, exact, near, hashlib.sha256(text.encode()).hexdigest()) for (i, _), (text, n, exact, near) in brute.line_dedup(rows).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op7_line_dedup(spark, D).collect()} == want
