"""Removal of benchmark passages: an FM-index for each shard of the training texts, searched backwards with the phrases of the benchmark.

Words are compared after lower-casing A-Z; `window` consecutive words of an item make a phrase, and an item of fewer words, but not none, is one phrase itself.
A shard is a run of rows of one partition with about SHARD_BYTES of text. Its symbols are the words that the phrases use; all other words are separators, and stretches
between separators that are shorter than the shortest phrase cannot hold one and are left out. The index is the Burrows-Wheeler transform of the symbols as a
wavelet matrix with rank counts, and samples of suffix positions: every 32nd and the first of each stretch. Phrases are searched together, last word first;
occurrences walk back to the next sample; overlapping occurrences merge into spans.

The benchmark goes to the executors in slices of at most MOST_BYTES of text; a larger one is searched slice by slice over the same rows, without a shuffle.

A null or empty text has no words and is never hit. A null or empty item is no phrase; an item without an id hits but is not named. Repeated documents and
items count each by itself, repeated item ids are named once. An empty benchmark hits nothing; no documents give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vitalcov.llm import common

SHARD_BYTES, MOST_BYTES, SAMPLE = 4 << 20, 8 << 20, 32
WORD = re.compile(rb"[^ ]+")
#: Bytes in lower case, and a blank for those that no word has.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Wavelet:
    """Wavelet matrix: for each bit of the symbols, highest first, how many zeros stand before each place."""

    def __init__(self, symbols: np.ndarray, highest: int):
        self.n, self.depth = len(symbols), max(1, int(highest).bit_length())
        self.zeros, self.total = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            self.total.append(int(self.zeros[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = np.zeros(1 << self.depth, np.int64)
        self.first = self._down(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, (zeros, total) in enumerate(zip(self.zeros, self.total, strict=True)):
            left = zeros[place]
            place = np.where((symbol >> (self.depth - 1 - k)) & 1, total + place - left, left)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, place) - self.first[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and how often each stands before its place."""
        symbol = np.zeros(len(place), np.int64)
        for zeros, total in zip(self.zeros, self.total, strict=True):
            left = zeros[place]
            bit = (zeros[place + 1] == left).astype(np.int64)
            symbol = symbol * 2 + bit
            place = np.where(bit, total + place - left, left)
        return symbol, place - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling. Separators (0) count as different from one another, the earlier as smaller, and below all words."""
    n, gaps = len(symbols), symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols + int(gaps.sum()))
    length = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - length] = rank[length:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        length *= 2
        if int(rank.max()) == n - 1 or length >= n:
            return order


class FMIndex:
    """Of symbols that begin and end with a separator (0)."""

    def __init__(self, symbols: np.ndarray, highest: int):
        order = suffix_array(symbols)
        before = symbols[order - 1]
        self.n = len(symbols)
        self.wavelet = Wavelet(before, highest)
        counts = np.bincount(symbols, minlength=highest + 2)
        self.smaller = np.cumsum(counts) - counts
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.place_of = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with each phrase (padded rows of symbols), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            symbol = phrases[live, lengths[live] - step]
            low[live] = self.smaller[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: back to the next sample."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            symbol, rank = self.wavelet.access(rows[open_])
            rows[open_] = self.smaller[symbol] + rank
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.samples[self.place_of[rows]] + steps


@dataclass(frozen=True)
class Phrases:
    symbol_of: dict[bytes, int]
    table: np.ndarray
    lengths: np.ndarray
    #: For each phrase the ids of its items.
    items: list[list[str]]


def phrases_of(items: list[tuple[str | None, bytes | None]], window: int) -> Phrases:
    symbol_of: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        symbols = [symbol_of.setdefault(w, len(symbol_of) + 1) for w in words_of(text)]
        for k in range(max(1, len(symbols) - window + 1) if symbols else 0):
            found.setdefault(tuple(symbols[k : k + window]), set()).update([] if item is None else [item])
    table = np.zeros((len(found), window), np.int64)
    for row, phrase in zip(table, found, strict=True):
        row[: len(phrase)] = phrase
    return Phrases(symbol_of, table, np.fromiter(map(len, found), np.int64, len(found)), [sorted(x) for x in found.values()])


def search_shard(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """For each document its merged spans of words, and the items that occur in it."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    get = phrases.symbol_of.get
    symbols = np.zeros(int(sizes.sum()) + len(docs) + 1, np.int64)  # a separator before each document and at the end
    starts = np.cumsum(sizes + 1) - sizes
    for at, words in zip(starts.tolist(), docs, strict=True):
        symbols[at : at + len(words)] = [get(w, 0) for w in words]
    known = symbols > 0
    edge = np.flatnonzero(np.diff(known.astype(np.int8)))
    begin, end = edge[::2] + 1, edge[1::2] + 1
    long = end - begin >= phrases.lengths.min(initial=1)
    begin, end = begin[long], end[long]
    if not len(begin) or not len(phrases.table):
        return spans, items
    sizes = end - begin + 1  # with a separator behind each stretch
    place = np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    text = np.concatenate([[0], np.where(place < np.repeat(end, sizes), symbols[place], 0)])
    place = np.concatenate([[-1], place])
    index = FMIndex(text, len(phrases.symbol_of))
    low, high = index.ranges(phrases.table, phrases.lengths)
    many = high - low
    phrase = np.repeat(np.arange(len(many)), many)
    if not len(phrase):
        return spans, items
    at = index.locate(np.repeat(low, many) + np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many))
    doc = np.searchsorted(starts, place[at], side="right") - 1
    for d, p in np.unique(np.column_stack([doc, phrase]), axis=0).tolist():
        items[d].update(phrases.items[p])
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.lengths[phrase], -1)
    covered = np.concatenate([[0], np.cumsum(change)[:-1] > 0, [0]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(covered))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, place[a], side="right")) - 1
        spans[d].append((int(place[a] - starts[d]), int(place[a] - starts[d]) + b - a))
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`text` without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*keep, text[at:]])


FOUND_ARROW = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = MOST_BYTES, keep_text: bool = False) -> DataFrame:
    """Per row: `id_col`, n_words, spans (merged, in words, end exclusive) and items (sorted); `keep_text` keeps the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // most_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        listed = [(r.item, r.text.encode()) for r in part.collect()]  # at most about `most_bytes`
        shared = common.Shared(spark, phrases_of(listed, window))

        with_text = keep_text or k < slices - 1

        def search(batches: Iterator[pa.RecordBatch], shared=shared, with_text=with_text) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in common.pieces(batches, "text", SHARD_BYTES):
                words = [words_of(t) for t in common.byte_texts(batch, "text")]
                spans, found = search_shard(words, phrases)
                spans = [merged([(x["start"], x["end"]) for x in old or []] + new) for old, new in zip(batch.column("spans").to_pylist(), spans, strict=True)]
                found = [sorted({*(old or []), *new}) for old, new in zip(batch.column("items").to_pylist(), found, strict=True)]
                named = [[{"start": a, "end": b} for a, b in x] for x in spans]
                columns = {"id": batch.column("id")} | ({"text": batch.column("text")} if with_text else {})
                columns |= zip(("n_words", "spans", "items"), (pa.array(x, kind) for x, kind in zip(([len(w) for w in words], named, found), FOUND_ARROW, strict=True)), strict=True)
                yield pa.RecordBatch.from_pydict(columns)

        kept = ["id", "text", "n_words", "spans", "items"] if with_text else ["id", "n_words", "spans", "items"]
        rows = rows.mapInArrow(search, StructType([StructField(c, rows.schema[c].dataType) for c in kept]))
    return rows.withColumnRenamed("id", id_col)


def with_clean_text(found: DataFrame, text_col: str = "text") -> DataFrame:
    """`found` with clean_text: the text without the words of its spans and what stands between them."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(x["start"], x["end"]) for x in s or []] for s in batch.column("spans").to_pylist()]
            texts = [None if t is None else without_spans(t, s) for t, s in zip(common.byte_texts(batch, text_col), spans, strict=True)]
            yield batch.append_column("clean_text", pa.array(texts, pa.binary()).cast(pa.string()))

    return found.mapInArrow(clean, StructType([*found.schema.fields, StructField("clean_text", StringType())]))


def judged(found: DataFrame) -> DataFrame:
    """`found` with n_hit, n_items and contaminated: hit words make a twentieth of all words or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")}).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ORACLE = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, words, least(len(words), 13) AS n FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
phrases AS (SELECT DISTINCT item, n, array_to_string(words[i:i + n - 1], ' ') AS s FROM (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM b)),
windows AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM phrases) WHERE len(words) >= n)),
found AS (SELECT doc_id, item, n, i FROM windows JOIN phrases USING (n, s)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
