"""Language-model scoring by cross-entropy difference: how much better a model of the target texts tells a document's words than one of the background.

Both models are bigram models over one vocabulary, with Dirichlet smoothing towards their unigrams. Target: the texts of chosen documents; background: all others.
The vocabulary is every word that occurs, however many there are, and one unknown word that none of them is.

1. Texts become blocks of about BLOCK_TOKENS words, written once: the sorted hashes of the block's distinct words, and for each word its place among them.
2. Every block counts its distinct words and bigrams, deals them out to buckets by ranges of their hashes and gets back, in the same order, their counts over the
   whole corpus. The tables of the models grow with the corpus and are never in one place: the number of buckets follows the number of tokens, and however
   frequent a word or bigram, it reaches its bucket once from each block. The size of the vocabulary is summed over the buckets of words.
3. Each block scores its own documents: per token the loss under the target less the loss under the background; a document's score is their mean.

Words and bigrams are told apart by 64 bits of hash. With `vocabulary` only that many most frequent words are kept apart (counted in a pass before, broadcast) and all
others are the unknown word; no query sets it.

Words are [^\\x20\\x09-\\x0D]+ in lower case (ASCII). Each document begins with a start mark that is predicted from nothing. A null text or one without words has score 0 and no tokens.
Lower scores are closer to the target. Repeated rows are scored and counted each. A null target flag is no target. Without target or background texts its counts are
zero and its model is uniform. No rows give none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcov.llm import common

BLOCK_TOKENS, BUCKET_TOKENS, PRIOR = 1 << 19, 1 << 21, 50.0
#: Keys of a bucket that are unpacked together.
FOLD_KEYS = 1 << 19
#: In the place of a hash: the start of a document, and words that are not in the vocabulary.
START, UNKNOWN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x2545F4914F6CDD1D)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes, and so on: small values compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(values.size, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def bucket_bounds(buckets: int) -> np.ndarray:
    """The least hash of each bucket but the first."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def count_words(rows: DataFrame) -> DataFrame:
    """Of (target, text): hash of each word, and its count in target and background texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        held: list[np.ndarray] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate([h for h, _ in held])
            counts = np.concatenate([c for _, c in held])
            found, place = np.unique(values, return_inverse=True)
            total = np.zeros((len(found), 2), np.int64)
            np.add.at(total, place, counts)
            return found, total

        for batch in common.pieces(batches, "text"):
            target = np.array([bool(t) for t in batch.column("target").to_pylist()])
            words = [words_of(t) for t in common.byte_texts(batch, "text")]
            values = hashes.of([w for ws in words for w in ws])
            if not len(values):
                continue
            flag = np.repeat(target, [len(ws) for ws in words])
            found, place = np.unique(values, return_inverse=True)
            inside = np.bincount(place, weights=flag, minlength=len(found)).astype(np.int64)
            held.append((found, np.column_stack([inside, np.bincount(place, minlength=len(found)) - inside])))
            size += len(found)
            if size > 1 << 19:
                held = [summed()]
                size = len(held[0][0])
                if size > 1 << 19:  # mostly different words: pass them on
                    yield rows_of(*held[0])
                    held, size = [], 0
        if held:
            yield rows_of(*summed())

    def rows_of(found: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.ascontiguousarray(total[:, 0])), pa.array(np.ascontiguousarray(total[:, 1]))], names=["w", "target", "background"])

    cells = rows.select("target", "text").mapInArrow(count, "w long, target long, background long")
    return cells.groupBy("w").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def most_frequent(words: DataFrame, vocabulary: int) -> DataFrame:
    """The `vocabulary` most frequent words; equal counts by hash.

    A histogram over powers of 2 ** (1 / 16), some hundred rows, tells from which count on there are enough, so that the last sort gets
    little more than it keeps, whatever the number of tasks.
    """
    total = F.col("target") + F.col("background")
    level = F.floor(16 * F.log2(total.cast("double")))
    have, lowest = 0, 0
    for row in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        have, lowest = have + row["count"], row["level"]
        if have >= vocabulary:
            break
    return words.where(level >= lowest).orderBy(total.desc(), "w").limit(vocabulary)


def score_documents(docs: DataFrame, target: str, *, vocabulary: int | None = None, prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: `id_col`, n_tokens, target_loss, background_loss (nats a token) and score, their difference. `target`: name of a boolean column."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(target).cast("boolean"), F.lit(False)).alias("target"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lexicon = None
    if vocabulary is not None:
        top = most_frequent(common.written(count_words(rows), "words"), vocabulary).toArrow()
        lexicon = spark.sparkContext.broadcast(np.sort(top.column("w").to_numpy().view(np.uint64)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, serial = common.WordHashes(), TaskContext.get().partitionId(), 0
        ids, flags, lengths, held, total = [], [], [], [], 0
        id_type = None

        def block() -> pa.RecordBatch:
            values = np.concatenate(held) if held else np.empty(0, np.uint64)
            if lexicon is not None:
                values = np.where(np.isin(values, lexicon.value), values, UNKNOWN)
            found, place = np.unique(values, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([serial], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([flags], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64())), pa.array([found.astype("<u8").tobytes()], pa.binary()), pa.array([planes(place.astype("<u4"))], pa.binary())],
                names=["part", "serial", "ids", "flags", "lengths", "words", "places"],
            )

        for batch in common.pieces(batches, "text"):
            id_type = batch.schema.field("id").type
            words = [words_of(t) for t in common.byte_texts(batch, "text")]
            held.append(hashes.of([w for ws in words for w in ws]))
            ids += batch.column("id").to_pylist()
            flags += batch.column("target").to_pylist()
            lengths += [len(ws) for ws in words]
            total += len(held[-1])
            if total >= block_tokens:
                yield block()
                serial += 1
                ids, flags, lengths, held, total = [], [], [], [], 0
        if ids:
            yield block()

    blocks = common.written(rows.mapInArrow(number, f"part int, serial int, ids array<{kind}>, flags array<boolean>, lengths array<long>, words binary, places binary"), "blocks")

    sizes_of = blocks.select(F.explode(F.arrays_zip("flags", "lengths")).alias("d")).where("d.lengths > 0").groupBy("d.flags").agg(F.count("*").alias("texts"), F.sum("d.lengths").alias("tokens")).collect()
    starts_of, tokens_of = (tuple(float(sum(r[c] for r in sizes_of if r["flags"] is flag)) for flag in (True, False)) for c in ("texts", "tokens"))
    # the first buckets are those of words
    word_buckets, gram_buckets = int(sum(tokens_of) // (4 * BUCKET_TOKENS)) + 1, int(sum(tokens_of) // BUCKET_TOKENS) + 1
    wide = "<u4" if sum(tokens_of) < 1 << 32 else "<u8"

    def keys_of(words: bytes, places: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words and of the distinct bigrams; of each token the place of its word, of its bigram, and that of the word before (-1 at the first)."""
        known, own = np.frombuffer(words, "<u8"), from_planes(places, "<u4").astype(np.int64)
        before = np.concatenate([[-1], own[:-1]]) if len(own) else own
        sizes = np.array(lengths, np.int64)
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        left = np.append(known, START)[before]
        grams, place = np.unique(common.mixed(common.mixed(left) * np.uint64(0x9E3779B97F4A7C15) + known[own]), return_inverse=True)
        return known, grams, own, place, before

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = bucket_bounds(word_buckets), bucket_bounds(gram_buckets)
        for batch in batches:
            for at_row in range(batch.num_rows):
                part, serial, flags, lengths, words, places = (batch.column(c)[at_row].as_py() for c in ("part", "serial", "flags", "lengths", "words", "places"))
                known, grams, own, place, _ = keys_of(words, places, lengths)
                flag = np.repeat(np.array(flags, bool), lengths)
                out: list[tuple[int, bytes, bytes]] = []
                for keys, at, limits, first in ((known, own, bounds[0], 0), (grams, place, bounds[1], word_buckets)):
                    inside = np.bincount(at, weights=flag, minlength=len(keys)).astype("<u4")
                    counts = np.column_stack([inside, np.bincount(at, minlength=len(keys)).astype("<u4") - inside]).astype("<u4")
                    begins = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
                    out += [(first + b, planes(np.diff(keys[x:y], prepend=np.uint64(0)).astype("<u8")), planes(counts[x:y])) for b, (x, y) in enumerate(zip(begins, begins[1:])) if x < y]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([serial] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
                    names=["bucket", "part", "serial", "keys", "counts"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a bucket stay packed; their keys and counts are folded into one sorted table of sums a few at a time, and looked up there in a second walk
        bucket, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            found, sums = np.empty(0, np.uint64), np.empty((0, 2), wide)
            some: list[tuple[np.ndarray, np.ndarray]] = []
            for k, (_, _, keys, counts) in enumerate(held):
                some.append((unpacked(keys), from_planes(counts, "<u4").reshape(-1, 2)))
                if sum(len(x) for x, _ in some) >= FOLD_KEYS or k == len(held) - 1:
                    found, sums = folded(found, sums, some)
                    some = []
            for k, (part, serial, keys, _) in enumerate(held):
                data = planes(sums[np.searchsorted(found, unpacked(keys))])
                new = len(found) if k == 0 and bucket < word_buckets else 0
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([serial], pa.int32()), pa.array([bucket], pa.int64()), pa.array([data], pa.binary()), pa.array([new], pa.int64())], names=["part", "serial", "bucket", "sums", "new_words"])

        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "serial", "keys", "counts")), strict=True):
                if b != bucket and held:
                    yield from settle()
                    held = []
                bucket = b
                held.append(row)
        if held:
            yield from settle()

    def unpacked(keys: bytes) -> np.ndarray:
        return np.cumsum(from_planes(keys, "<u8"), dtype=np.uint64)

    def folded(found: np.ndarray, sums: np.ndarray, some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their sums, with those of `some` rows added."""
        keys = np.concatenate([found, *(x for x, _ in some)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        counts = np.concatenate([sums, *(c for _, c in some)])[order]
        return keys[begins], np.add.reduceat(counts, begins, axis=0, dtype=wide) if len(begins) else sums

    seen = blocks.select("part", "serial", "flags", "lengths", "words", "places").mapInArrow(count, "bucket long, part int, serial int, keys binary, counts binary")
    # a row of a bucket is a block's share of it: as many go to a task's Python together as hold some 16 MB
    with common.rows_per_batch(spark, min(10_000, max(64, 2 * gram_buckets))):
        sums = common.written(seen.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "part int, serial int, bucket long, sums binary, new_words long"), "sums")
    # the start and the unknown word are symbols too
    size = 2 + (int(sums.agg(F.sum("new_words")).first()[0] or 0) if lexicon is None else len(lexicon.value))
    answers = sums.groupBy("part", "serial").agg(F.collect_list(F.struct("bucket", "sums")).alias("answers"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lengths = row.column("lengths")[0].as_py()
                known, _, own, place, before = keys_of(row.column("words")[0].as_py(), row.column("places")[0].as_py(), lengths)
                told = sorted((a["bucket"], a["sums"]) for a in row.column("answers")[0].as_py() or [])
                sums = np.concatenate([np.empty(0, wide), *(from_planes(x, wide) for _, x in told)]).reshape(-1, 2).astype(np.float64)
                unigrams, joint = sums[: len(known)], sums[len(known) :]
                losses = []
                for side in (0, 1):
                    plain = (unigrams[:, side] + 1) / (tokens_of[side] + size)
                    context = np.append(unigrams[:, side], starts_of[side])[before]
                    losses.append(-np.log((joint[place, side] + prior * plain[own]) / (context + prior)))
                sizes = np.array(lengths, np.int64)
                ends = np.cumsum(sizes)
                mean = [np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.concatenate([[0], ends])]) / np.maximum(sizes, 1) for x in losses]
                ids = row.column("ids").flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], names=["id", "n_tokens", "target_loss", "background_loss", "score"])

    joined = blocks.join(answers, ["part", "serial"], "left").select("ids", "lengths", "words", "places", "answers")
    return joined.mapInArrow(score, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double").withColumnRenamed("id", id_col)
