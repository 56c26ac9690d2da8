"""A corpus in five stages: quality, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`: doc_id, text, lang, source, n_chars; n_chars follows the text. Rows without a doc_id have no label and are compared like any other;
empty tables give empty tables, and extra columns go along until packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcov.llm import common, decontaminate, jaccard_join, line_dedup, packing, quality_crf, queries


def _named(columns: list[str]) -> list[Column]:
    return [F.col(common.quoted(c)) for c in columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    fold = common.crc_of_id(F.col("doc_id")) % 4
    model = quality_crf.train(docs, common.table(spark, sf_dir, "labels"), fold=fold != 2)
    score = common.free_name(docs.columns, "_score")
    return quality_crf.with_scores(docs, model, score_col=score).where(F.col(score) >= queries.GOOD).select(*_named(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before. Those that lose all their words that way go: every line of theirs stands in earlier documents."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    held = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(common.quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)]).alias("rest"))
    kept = line_dedup.dedup_lines(held).where((F.col("n_lines") == 0) | (F.col("n_lines") > F.col("n_exact") + F.col("n_near")))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")} | {c: F.col(f"rest.c{k}") for k, c in enumerate(rest)}
    return kept.select(*[made[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similar documents.

    Documents are told apart by id and text, so that texts which share an id, or have none, are each compared. Rows equal in both are one document and one of them stays.
    """
    key = common.free_name(docs.columns, "_key")
    told = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(F.xxhash64("text")))
    keyed = docs.withColumn(key, told)
    grouped = jaccard_join.similar_documents(keyed.select(key, "text"), id_col=key)
    # the key whose document stays: the smallest id of its class, an id before none
    ids = keyed.groupBy(key).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    known = common.written(grouped.select(F.col(key).alias("k"), "class_id").join(ids, F.col("k") == F.col(key)).select("k", "class_id", "id", "rows"), "keys")
    first = known.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("f"), F.count("*").alias("members")).where("members > 1")
    # only members of groups are looked at; most documents are alone
    going = known.join(first.select("class_id", F.col("f.k").alias("stays")), "class_id").where("k <> stays").select(F.col("k").alias(key))
    kept = keyed.join(going, key, "left_anti")
    again = known.where("rows > 1").select(F.col("k").alias(key))
    if again.isEmpty():
        return kept.select(*_named(docs.columns))
    again = common.written(again, "repeated_rows")
    once = kept.join(again, key, "left_semi").dropDuplicates([key])
    return kept.join(again, key, "left_anti").unionByName(once).select(*_named(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the benchmark contaminates."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(common.quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)])
    found = decontaminate.find(docs.select(row.alias("row"), "text"), common.table(spark, sf_dir, "benchmark"), id_col="row", keep_text=True)
    made = {"text": F.col("text")} | {c: F.col(f"row.c{k}") for k, c in enumerate(rest)}
    return decontaminate.judged(found).where(~F.col("contaminated")).select(*[made[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, as query op9 has them."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and MinHash have no SQL form; the stages are tested against plain Python instead.
ORACLE_SQL: str | None = None
