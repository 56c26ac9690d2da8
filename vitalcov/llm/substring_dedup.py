"""Removal of word sequences that occur elsewhere: super-k-mers of words, dealt out by minimiser and counted exactly by sorting.

A window is `window` consecutive words of a document. Its minimiser is the run of MINIMISER words in it with the smallest hash; consecutive windows with the
minimiser at one place make a super-k-mer. Equal windows have equal minimisers, so

1. super-k-mers are counted by minimiser, on hashes alone; where a minimiser occurs once, no window can occur twice, and nothing else of it travels;
2. the others go to their minimiser's bucket as one packed string of words. Equal strings of one batch travel once, marked as repeated: their places are known
   to be repeated on the spot. Windows whose minimiser is common to more than HOT super-k-mers go one by one, to the bucket of the whole window instead,
   so that a bucket of a common passage holds no more than one string for each batch;
3. a bucket sorts the hashes of its windows, compares the words of neighbours with equal hashes, and answers with the spans of words that repeated windows cover;
4. spans come back to their documents, whose texts are shuffled once for steps 2 and 4.

Words are [^\\x20\\x09-\\x0D]+. A null or short text has no window and loses nothing; kept_text of a null text is empty. Repeated rows repeat all their windows. A null id is kept
like any other. No rows give none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcov.llm import common

WINDOW, MINIMISER, HOT = 35, 8, 2000
#: Bytes of strings that a bucket task sorts at a time, whole minimisers at least.
SORT_BYTES = 2 << 20
SHIFT = np.uint64(24)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each `size` consecutive words, by one running sum."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    base = 0x5851F42D4C957F2D
    most = 1 << max(16, (len(words)).bit_length())
    up, down = common.worker_state(f"powers {most}", lambda: tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(most, b, np.uint64))]) for b in (base, pow(base, -1, 2**64))))
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)])])
    return common.mixed((total[size:] - total[:-size]) * down[: len(words) - size + 1])


def super_kmers(hashes: np.ndarray, sizes: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the concatenated word hashes of documents with `sizes` words: per super-k-mer its first word (in all words), windows, document and minimiser."""
    n = len(hashes) - window + 1
    nothing = np.empty(0, np.int64)
    if n <= 0:
        return nothing, nothing, nothing, np.empty(0, np.uint64)
    grams = rolling(hashes, minimiser)
    lowest = ((grams >> SHIFT) << SHIFT) | (np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << 24) - 1))
    span, have = window - minimiser + 1, 1
    while have < span:
        step = min(have, span - have)
        lowest = np.minimum(lowest[: len(lowest) - step], lowest[step:])
        have += step
    doc = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(valid):
        return nothing, nothing, nothing, np.empty(0, np.uint64)
    at = (lowest[valid] & np.uint64((1 << 24) - 1)).astype(np.int64)
    place = valid - (valid & ((1 << 24) - 1)) + at
    place += np.where(place < valid, 1 << 24, 0)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    first = valid[new]
    return first, np.diff(np.append(new, len(valid))), doc[first], grams[place[new]]


def repeated_windows(strings: list[bytes], marked: np.ndarray, window: int, hashes: common.WordHashes) -> list[np.ndarray]:
    """For each packed string (words between single blanks) which of its windows occur twice or more in all strings; those of a marked string count twice."""
    words = [s.split() for s in strings]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    every = [w for ws in words for w in ws]
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in every), np.int64, len(every))
    values = rolling(hashes.of(every), window)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    many = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(strings)), many)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + starts[owner]
    values = values[begin]
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    alike = np.flatnonzero(ordered[1:] == ordered[:-1])
    offsets = np.arange(window)
    differ = np.zeros(len(alike), bool)
    for low in range(0, len(alike), 1 << 14):
        part = alike[low : low + (1 << 14)]
        differ[low : low + (1 << 14)] = (codes[begin[order[part]][:, None] + offsets] != codes[begin[order[part + 1]][:, None] + offsets]).any(axis=1)
    twice = marked[owner].copy()
    twice[order[alike[~differ]]] = True
    twice[order[alike[~differ] + 1]] = True
    if differ.any():  # windows that share a hash only: settle their whole runs by their words
        for value in np.unique(ordered[alike[differ]]):
            groups: dict[bytes, list[int]] = {}
            run = order[np.searchsorted(ordered, value) : np.searchsorted(ordered, value, side="right")]
            for k in run.tolist():
                groups.setdefault(codes[begin[k] : begin[k] + window].tobytes(), []).append(k)
            for same in groups.values():
                twice[same] = len(same) > 1 or bool(marked[owner[same[0]]])
    return np.split(twice, np.cumsum(many)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _words(batch: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray]:
    words = [t.split() if t else [] for t in common.byte_texts(batch, "text")]
    return words, np.fromiter(map(len, words), np.int64, len(words))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, minimiser: int = MINIMISER, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, n_words, n_removed and kept_text, the words that no repeated window covers, joined by single blanks."""
    key = [F.col(id_col), F.col(text_col)]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(*key).alias("k"), F.hash(*reversed(key)).alias("k2"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in common.pieces(batches, "text"):
            words, sizes = _words(batch)
            _, _, doc, lowest = super_kmers(hashes.of([w for ws in words for w in ws]), sizes, window, minimiser)
            order = np.lexsort((lowest, doc))
            doc, lowest = doc[order], lowest[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lowest[1:] != lowest[:-1])])) if len(doc) else np.empty(0, np.int64)
            row = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([pa.array(lowest[new].view(np.int64)), batch.column("k").take(row), batch.column("k2").take(row), pa.array(np.diff(np.append(new, len(doc))).astype(np.int32))], names=["g", "k", "k2", "n"])

    seen = texts.select("k", "k2", "text").mapInArrow(count, "g long, k long, k2 int, n int")
    often = seen.groupBy("g").agg(F.sum("n").alias("total")).where("total > 1").select("g", (F.col("total") > hot).alias("hot"))
    wanted = seen.join(often, "g").groupBy("k", "k2").agg(F.collect_set(F.struct("g", "hot")).alias("wanted"))
    held = texts.join(wanted, ["k", "k2"], "left").where(F.col("wanted").isNotNull())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in common.pieces(batches, "text", 4 << 20):
            words, sizes = _words(batch)
            every = [w for ws in words for w in ws]
            first, many, doc, lowest = super_kmers(hashes.of(every), sizes, window, minimiser)
            before = np.cumsum(sizes) - sizes
            ks, k2s = batch.column("k").to_pylist(), batch.column("k2").to_pylist()
            asked = [{w["g"]: w["hot"] for w in ws} for ws in batch.column("wanted").to_pylist()]
            groups: dict[bytes, list] = {}  # packed string -> bucket, then the places of its copies
            for f, m, d, g in zip(first.tolist(), many.tolist(), doc.tolist(), lowest.view(np.int64).tolist(), strict=True):
                common_one = asked[d].get(g)
                if common_one is None:
                    continue
                for start, length in [(f, m)] if not common_one else [(f + i, 1) for i in range(m)]:
                    text = b" ".join(every[start : start + length + window - 1])
                    if (group := groups.get(text)) is None:
                        groups[text] = group = [hashes.hash(text) - 2**63 if common_one else g]
                    group.append((d, start - int(before[d]), length))
            out, spans = [], {}
            for text, (bucket, *places) in groups.items():
                d, start, _ = places[0]
                out.append((bucket, text, len(places) > 1, ks[d], k2s[d], start))
                if len(places) > 1:
                    for d, start, length in places:
                        spans.setdefault(d, []).append((start, start + length + window - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()), strict=True)] + [pa.nulls(len(out), pa.int32())],
                names=["bucket", "words", "marked", "k", "k2", "start", "end"],
            )
            known = [(hashes.hash(b"%d" % ks[d]) - 2**63, None, True, ks[d], k2s[d], a, b) for d, found in spans.items() for a, b in joined(found)]
            if known:  # answers that need no bucket travel along, dealt out by document
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*known, strict=True), (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["bucket", "words", "marked", "k", "k2", "start", "end"])

    def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    sent = held.select("id", "k", "k2", "text", "wanted").mapInArrow(send, "bucket long, words binary, marked boolean, k long, k2 int, start int, end int")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        strings, marked, places, held_bytes, last = [], [], [], 0, None

        def answers() -> list[tuple]:
            out = []
            for (k, k2, start), mark, flags in zip(places, marked, repeated_windows(strings, np.array(marked, bool), window, hashes), strict=True):
                if not mark:  # places of a marked string have their answer
                    out += [(k, k2, start + a, start + b + window - 1) for a, b in runs(flags)]
            return out

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["k", "k2", "start", "end"])

        for batch in batches:
            known = []
            for bucket, text, mark, k, k2, start, end in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "marked", "k", "k2", "start", "end")), strict=True):
                if text is None:
                    known.append((k, k2, start, end))
                    continue
                if bucket != last and held_bytes > SORT_BYTES:
                    known += answers()
                    strings, marked, places, held_bytes = [], [], [], 0
                last = bucket
                strings.append(text)
                marked.append(mark)
                places.append((k, k2, start))
                held_bytes += len(text)
            if known:
                yield rows(known)
        if strings and (found := answers()):
            yield rows(found)

    spans = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, "k long, k2 int, start int, end int")
    spans = spans.groupBy("k", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            words, sizes = _words(batch)
            kept, removed = [], []
            for ws, found in zip(words, batch.column("spans").to_pylist(), strict=True):
                if not found:
                    kept.append(b" ".join(ws))
                    removed.append(0)
                    continue
                out, at = [], 0
                for a, b in joined([(s["start"], s["end"]) for s in found]):
                    out += ws[at:a]
                    at = b
                out += ws[at:]
                kept.append(b" ".join(out))
                removed.append(len(ws) - len(out))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    answered = texts.join(spans, ["k", "k2"], "left").select("id", "text", "spans")
    return answered.mapInArrow(keep, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, list(i) AS places FROM (SELECT DISTINCT doc_id, i + o AS i FROM twice, range(0, 35) AS t(o)) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(places, i), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN covered USING (doc_id)
"""
