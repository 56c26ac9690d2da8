"""The corpus operators against plain versions, on rows that are odd in every way their docstrings name."""

import collections
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitalcov.llm import common, decontaminate, jaccard_join, langid, line_dedup, lm_score, packing, quality_crf, rules, substring_dedup, token_files, tokens

# names of columns that the operators use inside
CLASHING = ["id", "k", "k2", "t", "n", "row", "spans", "items", "label", "bands", "part", "words", "start", "line", "lines", "_rules", "n_lines", "target", "wanted"]


def odd_rows(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "The.", "é", "naïve,", "***", "|"]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(45))

    def text():
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 5))]
        return "\n".join([*lines, passage] if rnd.random() < 0.4 else lines)

    rows = [(i, text()) for i in range(60)]
    near = [rows[3][1] + f" extra{i}" for i in range(4)] + [rows[3][1], rows[3][1]]
    rows += [(100 + i, t) for i, t in enumerate(near)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "..."), (204, "\n\n"), (205, "a"), (206, "A\x00b \x1f c"), (207, "日本 語\nx y")]
    rows += [(208, "x\n" * 50), (209, "same words again " * 3000), (None, text()), (None, None)]
    return rows + rows[:3]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({c: F.lit("x") for c in CLASHING}).repartition(4).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def bag(values):
    return collections.Counter(map(repr, values))


# 1 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [2000, 2])
def test_substring_dedup(docs, rows, hot):
    got = substring_dedup.remove_repeats(docs, window=12, minimiser=3, hot=hot)
    want = [(i, *out) for (i, _), out in zip(rows, brute.substring_dedup(rows, 12), strict=True)]
    assert bag(tuple(r) for r in got.collect()) == bag(want)
    assert sum(w[2] for w in want) > 1000


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "rolling", lambda words, size: np.zeros(max(0, len(words) - size + 1), np.uint64))
    strings = [b"a b c d", b"b c d e", b"x y z"]
    got = substring_dedup.repeated_windows(strings, np.array([False, False, False]), 3, common.WordHashes())
    assert [g.tolist() for g in got] == [[False, True], [True, False], [False]]


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.remove_repeats(none).collect() == []


# 2 ----------------------------------------------------------------------------------------------


def test_jaccard_join(docs, rows):
    known = [r for r in dict.fromkeys(rows) if r[0] is not None]
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.similar_documents(docs).collect()}
    assert got == brute.jaccard(known)
    assert got[100][0] == 3 and got[104][1] == 3 and got[104][2] == 2 and got[200] == (200, 200, 0, 0)


@pytest.mark.parametrize(("threshold", "recall"), [((4, 5), 0.999), ((4, 5), 0.99), ((1, 2), 0.999), ((19, 20), 0.999), ((1, 4), 0.9)])
def test_bands_and_rows_meet_the_recall(threshold, recall):
    bands, rows = jaccard_join.band_plan(threshold, recall)
    similarity = threshold[0] / threshold[1]

    def found(b, r):
        return 1 - (1 - similarity**r) ** b

    assert found(bands, rows) >= recall > found(bands - 1, rows) and bands * rows <= jaccard_join.HASHES
    assert found(jaccard_join.HASHES // (rows + 1), rows + 1) < recall  # no plan with more rows would do


def test_band_plans_that_cannot_be():
    assert jaccard_join.band_plan() == (38, 8) and jaccard_join.band_plan((1, 1)) == (1, 1)
    for threshold, recall in [((1, 100), 0.999), ((0, 1), 0.9), ((5, 4), 0.9), ((4, 5), 1.0), ((4, 5), 0.0)]:
        with pytest.raises(ValueError):
            jaccard_join.band_plan(threshold, recall)


@pytest.mark.parametrize("threshold", [(4, 5), (1, 2)])
def test_the_recall_at_the_threshold_as_measured(threshold):
    # pairs of sets whose similarity is the threshold itself
    rnd, plan = np.random.default_rng(5), jaccard_join.band_plan(threshold)
    met, pairs, union = 0, 3000, 40 * threshold[1]
    for _ in range(pairs):
        values = np.unique(rnd.integers(0, 2**63, union, dtype=np.uint64))
        rnd.shuffle(values)
        shared, rest = values[: 40 * threshold[0]], values[40 * threshold[0] :]
        a, b = (np.sort(np.concatenate([shared, part])) for part in (rest[::2], rest[1::2]))
        x, y = jaccard_join.band_hashes([a, b], *plan)
        met += bool((x == y).any())
    assert met >= 0.9965 * pairs


def test_jaccard_join_at_half(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(60):  # every fourth word changed or a tail put on: between 0.3 and 0.8
        w = [f"v{i}_{k}" for k in range(60)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w + [f"t{rnd.randrange(9999)}" for _ in range(rnd.randrange(10, 90))])), (3 * i + 2, " ".join(w[: rnd.randrange(20, 60)]))]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), threshold=(1, 2))
    sets = {i: jaccard_join.shingle_set(t.encode(), 5, common.WordHashes()) for i, t in rows}
    want = {i: 0 for i in sets}
    for i in sets:
        for j in range(i - i % 3, i - i % 3 + 3):
            both = len(np.intersect1d(sets[i], sets[j]))
            want[i] += j != i and 2 * both >= len(sets[i]) + len(sets[j]) - both and both < max(len(sets[i]), len(sets[j]))
    assert sum(want.values()) > 50
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == want


@pytest.mark.parametrize("size", [1 << 24, 2000])
def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            w[rnd.randrange(120)] = f"z{rnd.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.jaccard(rows)
    assert {i: g[:3] for i, g in got.items()} == {i: w[:3] for i, w in want.items()}
    assert sum(g[3] for g in got.values()) >= 0.997 * sum(w[3] for w in want.values())
    assert all(got[i][3] <= want[i][3] for i in want)


def test_very_long_near_copies(spark):
    words = [f"w{(k * k) % 99991}_{k % 7}" for k in range(150_000)]
    other = list(words)
    other[70_000:70_500] = ["changed"] * 500
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:20_000])), (4, "short")]
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1, 0, 1), 2: (1, 2, 0, 1), 3: (3, 3, 0, 0), 4: (4, 4, 0, 0)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(jaccard_join.components(edges, "bigint").collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_jaccard_join_of_nothing(none):
    assert jaccard_join.similar_documents(none).collect() == []


# 3 ----------------------------------------------------------------------------------------------


def test_forward_backward_equals_all_labelings():
    rnd = np.random.default_rng(5)
    lengths = np.array([3, 1, 4])
    starts = np.array([0, 3, 4])
    emission, pair = rnd.normal(size=(8, 2)), rnd.normal(size=(2, 2))
    marginal, expected, log_z = quality_crf.chain(emission, pair, starts, lengths)
    want_pairs, total = np.zeros((2, 2)), 0.0
    for s, n in zip(starts, lengths, strict=True):
        weight, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(emission[s + k, y[k]] for k in range(n)) + sum(pair[y[k], y[k + 1]] for k in range(n - 1)))
            weight += w
            good += w * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += w
        assert marginal[s : s + n, 1] == pytest.approx(good / weight)
        want_pairs += pairs / weight
        total += np.log(weight)
    assert expected == pytest.approx(want_pairs)
    assert log_z == pytest.approx(total)


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    fold = common.crc_of_id(F.col("doc_id")) % 4
    model = quality_crf.train(docs, labels, fold=fold != 2)
    held = quality_crf.score(docs, model).join(labels, "doc_id").where(fold == 2).collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in held)
    assert len(held) > 50 and right >= 0.95 * len(held)


def test_quality_of_odd_documents(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(1, 1, "x"), (2, None, "x"), (None, 1, "x"), (9999, 0, "x")], "doc_id long, quality int, id string")
    model = quality_crf.train(docs, labels)
    got = quality_crf.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_text = collections.defaultdict(set)
    for r in quality_crf.with_scores(docs, model).select("text", "_score").collect():
        by_text[r["text"] or ""].add(r["_score"])
    assert all(max(s) - min(s) < 1e-9 for s in by_text.values())
    assert quality_crf.score(none, model).collect() == []
    for some, share in ((labels.where("false"), 0.5), (labels.where("quality = 1"), 1.0)):
        assert {r["score"] for r in quality_crf.score(docs, quality_crf.train(docs, some)).collect()} == {share}


def test_training_fetches_no_more_than_its_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b\nc")] * 5 + [(2, "# *\n|")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    taken = []
    fit = quality_crf.fit
    monkeypatch.setattr(quality_crf, "fit", lambda x, words, starts, y: taken.append((len(x), len(y))) or fit(x, words, starts, y))
    quality_crf.train(docs, labels, most=6, most_lines=400)
    quality_crf.train(docs, labels, most_lines=400)
    quality_crf.train(docs, labels, most=50, most_lines=40)
    assert taken == [(12, 6), (16, 8), (16, 8)]


# 4 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, rows, most_bytes):
    items = [(1, rows[5][1][:90].upper()), (10, "w1 w2"), (2, "The"), (3, None), (4, "... !"), (None, rows[7][1]), (1, "naïve é"), (5, rows[209 - 209 + 9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("x"))
    found = decontaminate.judged(decontaminate.find(docs, bench, window=4, most_bytes=most_bytes, keep_text=True)).collect()
    want = [(i, *out) for (i, _), out in zip(rows, brute.decontamination(rows, items, 4), strict=True)]
    assert bag((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found) == bag(want)
    for r in found:
        w = brute.bench_words(r["text"])
        kept = [x for k, x in enumerate(w) if not any(s["start"] <= k < s["end"] for s in r["spans"])]
        clean = decontaminate.without_spans((r["text"] or "").encode(), [tuple(s) for s in r["spans"]]).decode()
        assert len(brute.bench_words(clean)) == len(kept) or r["spans"]
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])


def test_fm_index_finds_every_occurrence():
    rnd = np.random.default_rng(2)
    for highest, n in ((2, 400), (9, 900), (300, 700)):
        text = rnd.integers(0, highest + 1, n)
        text[0] = text[-1] = 0
        index = decontaminate.FMIndex(text, highest)
        table = np.zeros((60, 5), np.int64)
        lengths = rnd.integers(1, 6, 60)
        for row, m in zip(table, lengths, strict=True):
            at = rnd.integers(1, n - m)
            row[:m] = np.maximum(text[at : at + m], 1)
        low, high = index.ranges(table, lengths)
        for row, m, a, b in zip(table, lengths, low, high, strict=True):
            want = [k for k in range(n - m + 1) if (text[k : k + m] == row[:m]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find(none, bench).collect() == []
    assert {len(r["spans"]) for r in decontaminate.find(docs, bench.where("false")).collect()} == {0}


def test_clean_text(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b, C d! And that"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a B c D")], "item_id long, text string")
    got = decontaminate.with_clean_text(decontaminate.find(docs, bench, keep_text=True)).orderBy("doc_id").collect()
    assert [r["clean_text"] for r in got] == ["Keep this. ! And that", None]


# 5 ----------------------------------------------------------------------------------------------


def test_rules(docs, rows):
    got = rules.apply_rules(docs).collect()
    want = []
    for i, t in rows:
        w = [x.decode() for x in brute.words(t)]
        lines = [x for x in (t or "").split("\n") if not brute.is_blank(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), brute.repeat_words(w)))
    assert bag(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got) == bag(want)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert {"id", "k", "row"} <= set(rules.apply_rules(docs).columns)


def test_stop_words_of_the_caller(spark):
    """Sixty different words of a language that the fixed list lacks: kept with its own stop words, at the beginning of a sentence too."""
    text = " ".join(f"{'Och' if k % 40 == 0 else 'och' if k % 10 == 0 else 'ord' + chr(97 + k % 26) + chr(97 + k // 26)}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    fixed = {r["doc_id"]: r for r in rules.apply_rules(docs).collect()}
    own = {r["doc_id"]: r for r in rules.apply_rules(docs, stop_words=["och", "och"]).collect()}
    assert (fixed[1]["n_stop_words"], fixed[1]["kept"]) == (0, False)
    assert (own[1]["n_stop_words"], own[1]["kept"]) == (6, True)
    assert not any(own[i]["kept"] or own[i]["n_stop_words"] for i in (2, 3))
    assert [r["n_stop_words"] for r in rules.apply_rules(docs, stop_words=[]).collect()] == [0, 0, 0]


def test_rules_of_nothing(none):
    assert rules.apply_rules(none).collect() == []


# 6 and 9 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ids(rows):
    def of(name, end):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.encode_special_tokens = True
        return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for _, t in rows]

    return of


ODD_TEXTS = ["a .b", "x...y, z.", "(a).b", "1.5, 2,000 a.b", "a \n.b", "\n a", "À.b ½.x ª,y ²,3 x²,3", "a~b ~ c", "a  b\n c", "x ́y", "<|endoftext|> a", "'s it's", "tab\tq  ", " lead", "nb sp", "Σας ΟΔΟΣ b", "a­b", "a.\nb", "a\n", ".\n.", "*\n.b", "\0 a\0b"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_the_whole_text(name, spaced, rows):
    encoder = tokens.Encoder(public_tokenizers.path(name), spaced, limit=50)
    texts = [*ODD_TEXTS, *(t for _, t in rows if t)]
    for _ in range(3):
        got = encoder.encode(texts)
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_literal_special_tokens_have_the_ids_of_the_plain_library_call(name, spaced):
    texts = ["<|endoftext|>", "a b, c.<|endoftext|>d e.\nf <|endoftext|> g", "x <|startoftext|>y\n<|endoftext|>\nz", "<|endoftext|><|endoftext|> ", "<|EndOfText|> a", *ODD_TEXTS]
    texts += [f"{t}<|endoftext|>{t}" for t in ODD_TEXTS]
    encoder, plain = tokens.Encoder(public_tokenizers.path(name), spaced, limit=50), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(3):
        got = [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_of_tokens_come_back():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        for high in (1, 2, 200, 50000, 1 << 16, 1 << 20, 1 << 32):
            x = rnd.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            x[::97] = 2**32 - 1
            payload = token_files.encode_segment(x)
            assert (token_files.decode_segment(payload) == x).all()
            if n == 3000:
                assert (token_files.decode_segment(payload, range(2, 4)) == x[1024:2048]).all()
    for width in range(20):
        values = rnd.integers(0, 1 << width, (3, 512)).astype(np.uint32)
        assert (token_files.unpack_block_bits(token_files.pack_block_bits(values, width), width, 512) == values).all()


def test_token_files(spark, docs, rows, ids, none, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), 2, segment_ids=500)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    made = sorted(zip(rows, ids("byte_bpe_50k.json", 2), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, (x[0][1] or "").encode()))
    at = 0
    for r, ((i, _), x) in zip(got, made, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(x))
        assert bytes(r["ids"]) == x.tobytes()
        at += len(x)
    token_files.write_tokens(none, str(tmp_path / "n"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_tokens(spark, str(tmp_path / "n")).collect() == []


def test_packing(docs, rows, ids, none):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, length=64).collect()
    want = collections.Counter((i, zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids("word_bpe_49k.json", 1), strict=True))
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    last = max(filled)
    for sequence, held in filled.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 64 or sequence == last
    assert sorted(filled) == list(range(last + 1))
    stream = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    whole, held = collections.Counter(), b""
    for r in stream:
        assert r["start"] * 4 == len(held)
        held += bytes(r["ids"])
        if len(held) == 4 * r["doc_tokens"]:
            whole[r["doc_id"], zlib.crc32(held)] += 1
            held = b""
    assert whole == want and not pieces
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 1).collect() == []


# 7 ----------------------------------------------------------------------------------------------


def test_bit_parallel_edit_distance(spark):
    rnd = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(4, 40)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k, o = rnd.randrange(len(b)), rnd.random()
            b[k : k + (o >= 0.33)] = [rnd.choice("abc")] if o < 0.66 else []
        pairs.append((a, "".join(b)))
    for most in (1, 2, 3):
        usable = [(a, b, brute.edits(a, b, most)) for a, b in pairs if abs(len(a) - len(b)) <= most and min(len(a), len(b)) > most]
        df = spark.createDataFrame(usable, "a string, b string, d int")
        got = F.least(F.lit(most + 1), line_dedup.edit_distance(F.split("a", ""), F.split("b", ""), most))
        assert df.where(got != F.col("d")).count() == 0 < len(usable)


def test_trimming_keeps_the_distance(spark):
    rnd = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(20, 200)))
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(b))
            b[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
        pairs.append((a, "".join(b)))
    pairs += [("ab" * 40, "ab" * 39), ("a" * 70, "a" * 72)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.trimmed(F.col("a"), F.col("b")).alias("t")).collect()
    for r in got:
        assert brute.edits(r["a"], r["b"], 3) == brute.edits(r["t"]["a"], r["t"]["b"], 3)
        assert min(len(r["t"]["a"]), len(r["t"]["b"])) >= 16
    assert sum(len(r["t"]["a"]) for r in got) < 0.5 * sum(len(r["a"]) for r in got)


def line_rows():
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(15, 60))) for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                k, o = rnd.randrange(len(line)), rnd.random()
                line[k : k + (o >= 0.4)] = ["x"] if o < 0.7 else []
            lines += ["".join(line), ""] if rnd.random() < 0.1 else ["".join(line)]
        rows.append((None if i == 7 else i, "\n".join(lines) if i % 40 else None))
    return rows + rows[:2]


def test_line_dedup(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = line_dedup.dedup_lines(docs.repartition(5)).collect()
    want = brute.line_dedup(rows)
    assert bag((r["doc_id"], r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in got) == bag((r[0], *want[r]) for r in rows)
    assert sum(w[3] for w in want.values()) > 50
    assert {"id", "k", "row"} <= set(got[0].asDict())


@pytest.mark.parametrize("classes", [((10, 1), (20, 2)), ((20, 2),), ((6, 1), (9, 2), (14, 3))])
def test_line_dedup_by_classes_of_length(spark, classes):
    rnd, rows = random.Random(17), []
    base = ["".join(rnd.choice("abcé") for _ in range(5 + k % 21)) for k in range(60)]
    for i in range(300):
        line = list(base[i % 60])
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            k, o = rnd.randrange(len(line)), rnd.random()
            line[k : k + (o >= 0.4)] = [rnd.choice("abx")] if o < 0.7 else []
        rows.append((i, "".join(line)))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), classes=classes).collect()}
    want = brute.line_dedup(rows, classes)
    assert got == {r[0]: want[r] for r in rows}
    shortest = [len(t) for (_, t), w in want.items() if w[3]]
    assert min(shortest) in (classes[0][0], classes[0][0] + 1) and len(shortest) > 20


@pytest.mark.parametrize("classes", [(), ((3, 2),), ((20, 2), (10, 1)), ((10, 2), (20, 2)), ((10, 0), (20, 1))])
def test_classes_that_cannot_be(none, classes):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(none, classes=classes)


def test_documents_with_one_id_keep_one_of_equal_lines(spark):
    rows = [(1, "one line of some length\nonly here"), (1, "one line of some length\nonly there"), (None, "one line of some length")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [line for r in got for line in r["text"].split("\n") if line]
    assert sorted(kept) == ["one line of some length", "only here", "only there"]


def test_line_dedup_of_odd_documents(docs, rows, none):
    got = line_dedup.dedup_lines(docs).collect()
    want = brute.line_dedup(rows)
    assert bag((r["doc_id"], r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in got) == bag((r[0], *want[r]) for r in rows)
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_stays_in_the_jvm(docs):
    assert "Python" not in line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()


# 8 ----------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    fold = common.crc_of_id(F.col("doc_id")) % 5
    model = langid.train(docs.where(fold != 0))
    held = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold == 0).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held) and len(held) > 100


def test_scores_equal_plain_bayes(spark):
    rows = [(1, "en", "the cat sat"), (2, "fr", "le chat été"), (3, "en", "a hat"), (4, None, "x"), (5, "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    total = model.log_prior.copy()
    for order in langid.ORDERS:
        for bucket in langid.ngram_buckets(["le chat été"], order)[0]:
            total = total + model.log_p[bucket]
    assert got[2]["lang_pred"] == "fr" and got[2]["score"] == pytest.approx(1 / (1 + np.exp(total[0] - total[1])), rel=1e-4)
    assert (got[5]["lang_pred"], got[5]["score"]) == ("und", 0.0)


def test_ngrams_do_not_reach_over_texts():
    both, ends = langid.ngram_buckets(["ab", "Cde"], 3)
    one, _ = langid.ngram_buckets(["ab"], 3)
    two, _ = langid.ngram_buckets(["cde"], 3)
    assert both.tolist() == [*one, *two] and ends.tolist() == [2, 5]


def test_languages_of_odd_documents(spark, docs, rows, none):
    model = langid.train(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t in rows if i == r["doc_id"]]
        if not any(c.isalpha() for t in texts for c in t or ""):
            assert r["lang_pred"] == "und"
    assert langid.predict(none, model).collect() == []
    empty = langid.train(docs.where("false").withColumn("lang", F.lit("x")))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


# 10 ---------------------------------------------------------------------------------------------


def plain_scores(rows, target, size, prior):
    import math

    import xxhash

    def signed(w):
        return int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64))

    split = [(t, lm_score.words_of((x or "").encode())) for t, (_, x) in zip(target, rows, strict=True)]
    every = collections.Counter(w for _, ws in split for w in ws)
    top = sorted(every, key=lambda w: (-every[w], signed(w)))[:size]
    number = {w: k for k, w in enumerate(sorted(top, key=signed), 2)}
    total = len(top) + 2
    one, two, starts = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], [0, 0]
    coded = [[number.get(w, 1) for w in ws] for _, ws in split]
    for (t, _), n in zip(split, coded, strict=True):
        side = 0 if t else 1
        starts[side] += bool(n)
        one[side].update(n)
        two[side].update(zip([0, *n[:-1]], n, strict=True) if n else [])
    out = []
    for (i, _), n in zip(rows, coded, strict=True):
        loss = [0.0, 0.0]
        for a, b in zip([0, *n[:-1]], n, strict=True) if n else []:
            for s in (0, 1):
                p = (one[s][b] + 1) / (one[s].total() + total)
                loss[s] -= math.log((two[s][a, b] + prior * p) / ((one[s][a] if a else starts[s]) + prior))
        out.append((i, len(n), *(x / max(1, len(n)) for x in loss)))
    return out


@pytest.mark.parametrize("vocabulary", [30, None])
def test_lm_scores(spark, rows, none, monkeypatch, vocabulary):
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 500)
    target = [None if k % 3 == 0 else k % 2 == 0 for k in range(len(rows))]
    made = spark.createDataFrame([(i, t, g) for (i, t), g in zip(rows, target, strict=True)], "doc_id long, text string, wanted boolean").withColumns({c: F.lit("x") for c in CLASHING if c != "wanted"})
    got = lm_score.score_documents(made.repartition(3), "wanted", vocabulary=vocabulary, block_tokens=300).collect()
    want = plain_scores(rows, target, vocabulary, lm_score.PRIOR)
    key = lambda r: (str(r[0]), r[1], round(r[2], 6), round(r[3], 6))
    for r, w in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert r[:2] == w[:2] and r[2:4] == pytest.approx(w[2:4], rel=1e-9) and r[4] == pytest.approx(r[2] - r[3])
    assert lm_score.score_documents(none.withColumn("wanted", F.lit(True)), "wanted").collect() == []


def test_every_word_of_a_large_vocabulary_is_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 5000)
    bulk = [" ".join(f"r{k // 2}" for k in range(at, at + 10_000)) for at in range(0, 140_000, 10_000)]
    rows = [(0, "a b", True), (1, "a c", False), *((2 + i, t, False) for i, t in enumerate(bulk))]
    got = {r["doc_id"]: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string, wanted boolean"), "wanted", block_tokens=20_000).collect()}
    size, prior, tokens = 70_003 + 2, lm_score.PRIOR, (2, 140_002)

    def loss(side, *steps):
        """Mean over (count of the bigram, count of the word, count of what is before)."""
        return -np.mean([np.log((joint + prior * (word + 1) / (tokens[side] + size)) / (before + prior)) for joint, word, before in steps])

    assert got[0]["target_loss"] == pytest.approx(loss(0, (1, 1, 1), (1, 1, 1)), rel=1e-9)
    assert got[0]["background_loss"] == pytest.approx(loss(1, (1, 1, 15), (0, 0, 1)), rel=1e-9)
    assert got[1]["background_loss"] == pytest.approx(loss(1, (1, 1, 15), (1, 1, 1)), rel=1e-9)
    assert got[1]["n_tokens"] == 2 and len(got) == 16
