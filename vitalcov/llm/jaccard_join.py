"""Similarity join on word shingles: every document whose set of n-grams has a Jaccard similarity of `threshold` or more with another document's.

Documents with equal n-gram sets form a copy class; its smallest id stands for it, and only representatives take part in the rest, so copies make no pairs.
MinHash signatures are made in one pass. The numbers of bands and rows follow from the threshold and a target recall (`band_plan`): a pair exactly at the threshold
shares a band with at least that probability, a more similar one with more; at 0.8 and 0.999 these are 38 bands of 8 rows. Representatives are shuffled on their band hashes. Buckets with the same members, as a pair makes in most of its bands, are kept once.

Verification is exact, on the full n-gram sets, and yields counts and a spanning forest instead of pairs: a bucket's members travel as compressed texts, a bucket of more
than BLOCK members or BLOCK_BYTES of text as pairs of blocks, so no task holds the n-grams of more than two blocks, and one text open at a time. A pair is verified and counted only in the first of its common buckets, which
both signatures tell. Groups are the connected components of verified links, found by passing on the smallest id along the forest's edges.

Words are [^\\x20\\x09-\\x0D]+; a text of fewer words than `n`, but not none, is one shingle. A null or empty text has none, is never linked and is its own group.
Rows with one id are one document, whose text is the one with the smallest hash; a null id is left out. No rows give none. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcov.llm import common

N, THRESHOLD, RECALL, SEED = 5, (4, 5), 0.999, 7
#: Hashes of a signature, at most. More make narrower bands, hence fewer pairs to verify in vain, and cost more to draw.
HASHES = 320
#: Members of a bucket, and bytes of their texts, that are compared in one block.
BLOCK, BLOCK_BYTES = 256, 1 << 24


def band_plan(threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows by which a pair at the threshold shares a band with a probability of `recall` or more: of all such plans within `hashes` that with the most rows.

    A band of r rows agrees with probability s^r at similarity s, and one of b bands with 1 - (1 - s^r)^b.
    """
    up, down = threshold
    if not 0 < up <= down or not 0 < recall < 1:
        raise ValueError("the threshold lies in (0, 1], the recall between 0 and 1")
    best = None
    for rows in range(1, hashes + 1):
        alike = (up / down) ** rows
        bands = 1 if alike == 1 else max(1, math.ceil(math.log1p(-recall) / math.log1p(-alike)))
        if bands * rows > hashes:
            break
        best = bands, rows
        if alike == 1:  # equal sets are one class before bands are made
            break
    if best is None:
        raise ValueError(f"{hashes} hashes are too few for a recall of {recall} at {up}/{down}")
    return best


def shingle_set(text: bytes | None, n: int, hashes: common.WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    size = min(n, len(words))
    found = common.window_hashes(hashes.of(words), size)
    return np.unique(found if size == n else found + np.uint64(size))


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Rows of `bands` hashes, for non-empty sets."""
    draw = np.random.default_rng(SEED)
    factor = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.empty((len(sets), bands * rows), np.uint64)
    start = 0
    while start < len(sets):  # a few thousand shingles at a time stay in the processor's cache
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= 8192):
            held += len(sets[stop])
            stop += 1
        values = np.concatenate(sets[start:stop])
        begins = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : stop - 1]])]).astype(np.int64)
        work = np.empty_like(values)
        for k in range(bands * rows):
            np.multiply(values, factor[k], out=work)
            np.add(work, add[k], out=work)
            out[start:stop, k] = np.minimum.reduceat(work, begins)
        start = stop
    mixed = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        mixed = common.mixed(mixed * np.uint64(31) + out[:, r::rows])
    return mixed


def signatures(texts: DataFrame, bands: int, rows: int, *, n: int = N) -> DataFrame:
    """Of id, t and text: id, t, size (bytes of the text), digest of the n-gram set (null if empty) and the band hashes as bytes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = common.WordHashes()
        for batch in common.pieces(batches, "text"):
            sets = [shingle_set(t, n, hashes) for t in common.byte_texts(batch, "text")]
            some = [k for k, s in enumerate(sets) if len(s)]
            made: list[bytes | None] = [None] * len(sets)
            for k, row in zip(some, band_hashes([sets[k] for k in some], bands, rows) if some else [], strict=True):
                made[k] = row.astype("<u8").tobytes()
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            made_columns = [batch.column("id"), batch.column("t"), batch.column("size"), pa.array(digests, pa.binary()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(made_columns, names=["id", "t", "size", "digest", "bands"])

    sized = texts.select("id", "t", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return sized.mapInArrow(sign, f"id {texts.schema['id'].dataType.simpleString()}, t long, size long, digest binary, bands binary")


def verify_block(left: list[tuple], right: list[tuple], bucket: int, same: bool, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Link counts of both sides and forest edges (places; those of `right` follow those of `left`).

    Members are (id, bands, n-gram set). A pair counts here if no earlier band of theirs agrees (`bucket` is this one's band).
    """
    members = left if same else left + right
    sets = [m[2] for m in members]
    sizes = np.array([len(s) for s in sets])
    bands = np.vstack([np.frombuffer(m[1], "<u8") for m in members])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    walk = np.argsort(column, kind="stable")
    owner, column = owner[walk], column[walk]
    cut = len(members) if same else len(left)
    rows = np.arange(cut)
    others = np.arange(len(members)) if same else np.arange(cut, len(members))
    common_count = np.zeros((len(rows), len(others)), np.float32)
    width = int(often.sum())
    for at in range(0, width, 2048):  # a slice of the shingles at a time
        inside = slice(*np.searchsorted(column, [at, at + 2048]))
        grid = np.zeros((len(members), min(2048, width - at)), np.float32)
        grid[owner[inside], column[inside] - at] = 1
        common_count += grid[rows] @ grid[others].T
    up, down = threshold
    shared = np.rint(common_count).astype(np.int64)
    union = sizes[rows][:, None] + sizes[others][None, :] - shared
    linked = down * shared >= up * union
    for band in range(bucket):
        linked &= bands[rows, band][:, None] != bands[others, band][None, :]
    if same:
        np.fill_diagonal(linked, False)
    counts = np.zeros(len(members), np.int64)
    counts[rows] += linked.sum(axis=1)
    if not same:
        counts[others] += linked.sum(axis=0)
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        for j in others[linked[i]].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                edges.append((i, j))
    return counts[: len(left)], counts[len(left) :], edges


def components(edges: DataFrame, id_type: str) -> DataFrame:
    """Smallest id of the connected component of every id in `edges` (a, b). Labels travel along edges and jump to their label's label."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.checkpointed(both)
    labels = common.checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("further"))
        new = common.checkpointed(lower.join(jump, "next", "left").select("id", "label", F.least("next", F.coalesce("further", "next")).alias("new")))
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels


def similar_documents(docs: DataFrame, *, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: `id_col`, class_id (smallest id of its group of linked documents), copy_of (smallest id with an equal n-gram set),
    n_copies (other documents with that set) and n_links (other sets with a similarity of at least the threshold). `recall`: of the links exactly at the threshold, the share that is expected to be found."""
    bands, rows = band_plan(threshold, recall)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    kind = source.schema["id"].dataType.simpleString()
    signed = signatures(source, bands, rows, n=n).groupBy("id").agg(F.min(F.struct("t", "digest", "size", "bands")).alias("s")).select("id", "s.*")
    signed = common.written(signed, "signatures")
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("copy_of"), F.count("*").alias("members"))
    member = common.written(
        signed.join(classes, "digest", "left").select("id", "t", "size", F.coalesce("copy_of", "id").alias("copy_of"), (F.coalesce("members", F.lit(1)) - 1).alias("n_copies"), F.when(F.col("id") == F.col("copy_of"), F.col("bands")).alias("bands")),
        "members",
    )
    kept = member.where(F.col("bands").isNotNull()).select("id", "t", "size", "bands")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grid = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<u8").reshape(batch.num_rows, -1)
                place = np.repeat(np.arange(batch.num_rows), grid.shape[1])
                own = [batch.column(c).take(pa.array(place)) for c in ("id", "size")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.tile(np.arange(grid.shape[1], dtype=np.int32), batch.num_rows)), pa.array(grid.ravel().view(np.int64))], names=["id", "size", "band", "h"])

    entries = kept.select("id", "size", "bands").mapInArrow(spread, f"id {kind}, size long, band int, h long")
    # sums of a mixed hash tell sets of members apart without gathering them
    mixed = F.xxhash64("id")
    buckets = entries.groupBy("band", "h").agg(F.count("*").alias("members"), F.sum("size").alias("size"), F.min("id").alias("least"), F.sum(F.shiftright(mixed, 34)).alias("s1"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 34)).alias("s2"))
    chosen = buckets.where("members > 1").groupBy("members", "least", "s1", "s2").agg(F.min(F.struct("band", "h", "size")).alias("b")).select("b.band", "b.h", "b.size", "members")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.least(F.ceil(F.col("size") / BLOCK_BYTES), F.col("members"))).cast("int")
    chosen = chosen.select("band", "h", blocks.alias("blocks"))
    chosen = common.written(chosen, "buckets")
    # the number of a member in its bucket is drawn, not counted: blocks are even enough and nothing is gathered
    joined = entries.drop("size").join(chosen, ["band", "h"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks").cast("long")).cast("int"))
    wanted = joined.groupBy("id").agg(F.collect_list(F.struct("band", "h", "blocks", "block")).alias("buckets"))
    carried = kept.join(wanted, "id").join(source, ["id", "t"]).select("id", "bands", "buckets", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in common.pieces(batches, "text"):
            out: list[tuple] = []
            for key, bands_, buckets_, text in zip(batch.column("id").to_pylist(), batch.column("bands").to_pylist(), batch.column("buckets").to_pylist(), common.byte_texts(batch, "text"), strict=True):
                data = squeeze(text)
                for b in buckets_:
                    for other in range(b["blocks"]):
                        low, high = sorted((b["block"], other))
                        out.append((b["band"], b["h"], low, high, b["block"] == low, key, bands_, data))
                if len(out) > 2000:
                    yield rows_of(out, batch.schema.field("id").type)
                    out = []
            if out:
                yield rows_of(out, batch.schema.field("id").type)

    def rows_of(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), id_type, pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["band", "h", "low", "high", "left", "id", "bands", "data"])

    packed = carried.mapInArrow(pack, f"band int, h long, low int, high int, left boolean, id {kind}, bands binary, data binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_up, hashes = zstandard.ZstdDecompressor().decompress, common.WordHashes()
        key, left, right, seen = None, [], [], set()
        id_type = None

        def settle() -> pa.RecordBatch | None:
            same = key[2] == key[3]
            if len(left) + len(right) < 2 or not (same or (left and right)):
                return None
            members = left if same else left + right
            counts, more, edges = verify_block(left, [] if same else right, key[0], same, threshold)
            linked = [(members[i][0], int(c), None) for i, c in enumerate([*counts.tolist(), *more.tolist()]) if c]
            linked += [(members[i][0], 0, members[j][0]) for i, j in edges]
            if not linked:
                return None
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*linked, strict=True), (id_type, pa.int64(), id_type), strict=True)], names=["id", "links", "other"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for band, h, low, high, is_left, ident, bands_, data in zip(*(batch.column(c).to_pylist() for c in ("band", "h", "low", "high", "left", "id", "bands", "data")), strict=True):
                if key != (band, h, low, high):
                    if key is not None and (found := settle()) is not None:
                        yield found
                    key, left, right, seen = (band, h, low, high), [], [], set()
                if ident in seen:  # a row that stands twice in the input
                    continue
                seen.add(ident)
                (left if is_left else right).append((ident, bands_, shingle_set(open_up(data), n, hashes)))
        if key is not None and (found := settle()) is not None:
            yield found

    order = ["band", "h", "low", "high"]
    links = common.written(packed.repartition(*order).sortWithinPartitions(*order).mapInArrow(verify, f"id {kind}, links long, other {kind}"), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("n_links"))
    group = components(links.where(F.col("other").isNotNull()).select(F.col("id").alias("a"), F.col("other").alias("b")), kind)
    told = counts.join(group, "id", "left").select(F.col("id").alias("copy_of"), "n_links", "label")
    zero = F.lit(0).cast("long")
    return member.join(told, "copy_of", "left").select(F.col("id").alias(id_col), F.coalesce("label", "copy_of").alias("class_id"), "copy_of", "n_copies", F.coalesce("n_links", zero).alias("n_links"))


#: Exact: every pair that shares an n-gram. The query equals it where MinHash misses no linked pair.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
sets AS (SELECT doc_id, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS rep, count(*) AS members, gs, len(gs) AS n FROM sets GROUP BY gs),
grams AS (SELECT rep, n, g FROM classes JOIN s ON doc_id = rep),
pairs AS (SELECT a.rep AS x, b.rep AS y FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
walk(x, y) AS (SELECT rep, rep FROM classes UNION SELECT walk.x, pairs.y FROM walk JOIN pairs ON walk.y = pairs.x),
groups AS (SELECT x, min(y) AS label FROM walk GROUP BY x),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT w.doc_id, coalesce(label, rep, w.doc_id) AS class_id, coalesce(rep, w.doc_id) AS copy_of, (coalesce(members, 1) - 1)::BIGINT AS n_copies,
  coalesce(links.n, 0)::BIGINT AS n_links
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (gs) LEFT JOIN groups ON groups.x = rep LEFT JOIN links ON links.x = rep
"""
