"""Packing of whole documents into sequences of one length, by patterns fitted to the histogram of lengths.

Only documents longer than a sequence are cut: a first piece of what is left over, then full sequences. What remains is a histogram: how many pieces there are of each length
below that of a sequence. Its size is that of a sequence, not of the corpus, so the plan is made on the driver from at most `length` numbers, whatever the number of documents.

1. Pass one encodes every text once and writes ids, the task's number, and the rank of each piece among the pieces of its length in that task.
2. Patterns: all ways to fill a sequence exactly with at most three lengths that occur. Repeat counts x >= 0 minimise |A x - histogram|, A having a column for each pattern, by
   accelerated projected gradients (non-negative least squares); A is used through its few entries a column only.
3. Counts are rounded down, so that the pieces left over are a mix of lengths as all are. These go, longest first and many at a time, into the fullest sequence they fit in.
4. So a plan is a list of runs: pieces `first` to `last` of a length lie in sequences of consecutive numbers at one offset. Ranks count through the tasks by prefix sums per length, and
   pass two looks up each piece's run. No text or id is shuffled; sequences are only numbers.

A null text counts as empty and gives the end id alone. Repeated rows are packed as often as they occur. No rows give no pieces. Other columns are not looked at. Which of the
documents of one length lies where follows the order of pass one's tasks and rows, fixed by the table it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from vitalcov.llm import common, tokens

#: Documents in a pattern, and steps of the fit.
PARTS, STEPS = 3, 500
#: Largest table of ranks (bytes) that is broadcast.
MOST_BROADCAST = 16 << 20


def patterns(lengths: np.ndarray, length: int) -> np.ndarray:
    """All ways to write `length` as a sum of at most PARTS = 3 of the `lengths`, rising, with zeros in front."""
    there = np.zeros(length + 1, bool)
    there[lengths] = True
    out = [np.array([[0, 0, length]])] if there[length] else []
    small = lengths[2 * lengths <= length]
    pairs = small[there[length - small]]
    out.append(np.column_stack([np.zeros_like(pairs), pairs, length - pairs]))
    for a in lengths[3 * lengths <= length].tolist():
        b = lengths[(lengths >= a) & (2 * lengths <= length - a)]
        b = b[there[length - a - b]]
        out.append(np.column_stack([np.full_like(b, a), b, length - a - b]))
    return np.concatenate(out).astype(np.int64)


def fitted(ways: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that come closest to the histogram in least squares."""
    wanted = histogram.astype(np.float64)
    wanted[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(ways[:, k], weights=x, minlength=len(wanted)) for k in range(PARTS))
        total[0] = 0
        return total

    def gathered(r: np.ndarray) -> np.ndarray:
        return sum(r[ways[:, k]] for k in range(PARTS))

    probe, size = np.ones(len(ways)), 1.0
    for _ in range(30):  # largest eigenvalue of A'A, for the step
        probe = gathered(used(probe))
        size = float(np.linalg.norm(probe))
        probe /= size
    x = y = np.zeros(len(ways))
    momentum = 1.0
    for _ in range(steps):
        # the slack of 2 % covers what the power method may have left
        new = np.maximum(0, y - gathered(used(y) - wanted) / (1.02 * size))
        if ((y - new) @ (new - x)) > 0:  # overshot: start the momentum anew
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def rounded(ways: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Repeat counts rounded down, most used patterns first, never beyond the histogram; and the pieces left over, which are then a fair mix of all lengths."""
    left, plan = histogram.copy(), []
    for k in np.argsort(-x, kind="stable").tolist():
        repeats = int(x[k] + 1e-9)
        if not repeats:
            break
        way = tuple(v for v in ways[k].tolist() if v)
        for v in set(way):
            repeats = min(repeats, int(left[v]) // way.count(v))
        if repeats:
            plan.append((way, repeats))
            for v in way:
                left[v] -= repeats
    return plan, left


def best_fit(left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """The rest, longest first, each into the fullest sequence that has room. Equal sequences are one entry with a count, so the work does not grow with the counts."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room -> (lengths inside, how many)
    rooms = np.zeros(length + 1, bool)
    for size in range(length, 0, -1):
        count = int(left[size])
        while count:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                inside, many = open_[room].pop()
                rooms[room] = bool(open_[room])
                each = room // size  # as many of this size as go in
                if count < each:
                    full, each = 1, count
                else:
                    full = min(many, count // each)
                if many > full:
                    open_[room].append((inside, many - full))
                    rooms[room] = True
            else:
                inside, room, each = (), length, length // size
                if count < each:
                    full, each = 1, count
                else:
                    full = count // each
            count -= full * each
            rest = room - each * size
            open_.setdefault(rest, []).append((inside + (size,) * each, full))
            rooms[rest] = rest > 0
    return [way for ways in open_.values() for way in ways]


def plan_runs(histogram: np.ndarray, length: int) -> np.ndarray:
    """The plan as runs, sorted by size and first rank: size, first rank, first sequence, offset. Rank r of a size lies in sequence (first sequence + r - first rank)."""
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    plan: list[tuple[tuple[int, ...], int]] = []
    left = histogram.copy()
    left[0] = 0
    if left[length]:
        plan.append(((length,), int(left[length])))
        left[length] = 0
    lengths = lengths[lengths < length]
    ways = patterns(lengths, length) if len(lengths) else np.empty((0, PARTS), np.int64)
    if len(ways):
        made, left = rounded(ways, fitted(ways, left), left)
        plan += made
    plan += best_fit(left, length)
    taken, sequence, runs = [0] * (length + 1), 0, []
    for way, repeats in plan:
        offset = 0
        for size in sorted(way, reverse=True):
            runs.append((size, taken[size], sequence, offset))
            taken[size] += repeats
            offset += size
        sequence += repeats
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, length: int, *, spaced: bool, id_col: str, text_col: str) -> DataFrame:
    """Per row its ids (little-endian 32-bit, end id included), with `part`, the task that made it, and the ranks in that task of its left-over piece (`rank`, among
    those of its length) and of its first full piece (`rank_full`)."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = tokens.encoder(tokenizer, spaced), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for batch in common.pieces(batches, "text"):
            found = [ids + end for ids in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            counts = np.array([len(ids) // 4 for ids in found], np.int64)
            rest, full = counts % length, counts // length
            order = np.argsort(rest, kind="stable")
            many = np.bincount(rest, minlength=length)
            rank = np.empty(len(rest), np.int64)
            rank[order] = np.arange(len(rest)) - np.repeat(np.cumsum(many) - many, many) + seen[rest[order]]
            rank_full = seen[length] + np.cumsum(full) - full
            seen[:length] += many
            seen[length] += full.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part, np.int32)), batch.column("id"), pa.array(counts), pa.array(rank), pa.array(rank_full), pa.array(found, pa.binary())], names=["part", "id", "n_tokens", "rank", "rank_full", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [("n_tokens", LongType()), ("rank", LongType()), ("rank_full", LongType()), ("ids", BinaryType())]
    return rows.mapInArrow(encode, StructType([StructField("part", IntegerType()), StructField("id", rows.schema["id"].dataType), *[StructField(c, t) for c, t in kinds]]))


def cells_of(table: DataFrame, length: int) -> DataFrame:
    """Number `n` of pieces per task and size. The first of each size (0: none) is left over, the full ones count under `length`."""
    by = table.groupBy("part", (F.col("n_tokens") % length).cast("int").alias("size")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n_tokens") / length)).alias("full"))
    sizes = F.explode(F.array(F.struct("size", "n"), F.struct(F.lit(length).alias("size"), F.col("full").alias("n"))))
    return by.select("part", sizes.alias("c")).groupBy("part", "c.size").agg(F.sum("c.n").alias("n")).where("size > 0 AND n > 0")


def starts_of(cells: DataFrame, length: int) -> DataFrame:
    """Per task the number of pieces of each size in the tasks before it, as an array by size."""
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    gathered = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("size", "before"))).alias("m"))
    by_size = F.transform(F.sequence(F.lit(0), F.lit(length)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    return gathered.select("part", by_size.alias("starts"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, length: int = 1024, spaced: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: `id_col`, piece (from 0), start (ids of its document before it), length, sequence_id, offset and ids (little-endian 32-bit)."""
    spark = docs.sparkSession
    table = common.written(encoded(docs, tokenizer, end_id, length, spaced=spaced, id_col=id_col, text_col=text_col), "encoded")
    cells = common.written(cells_of(table, length), "cells")
    histogram = np.zeros(length + 1, np.int64)
    for row in cells.groupBy("size").agg(F.sum("n").alias("n")).collect():
        histogram[row["size"]] = row["n"]
    runs = plan_runs(histogram, length)
    # sizes and ranks as one sorted number; the plan's size depends on the length of a sequence alone
    plan = spark.sparkContext.broadcast((runs[:, 0] << 48 | runs[:, 1], runs[:, 1], runs[:, 2], runs[:, 3]))
    starts = common.written(starts_of(cells, length), "starts")
    small = 8 * (length + 1) * starts.count() <= MOST_BROADCAST
    joined = table.join(F.broadcast(starts) if small else starts, "part")
    own, full = F.get("starts", (F.col("n_tokens") % length).cast("int")), F.get("starts", F.lit(length))
    placed = joined.select("id", "n_tokens", (own + F.col("rank")).alias("rank"), (full + F.col("rank_full")).alias("rank_full"), "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequences, offsets = plan.value
        for batch in common.pieces(batches, "ids", 1 << 22):
            counts, rank, rank_full = (batch.column(c).to_numpy() for c in ("n_tokens", "rank", "rank_full"))
            rest = counts % length
            pieces = counts // length + (rest > 0)
            row = np.repeat(np.arange(batch.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            has_rest = rest[row] > 0
            short = has_rest & (piece == 0)
            size = np.where(short, rest[row], length)
            place_of = np.where(short, rank[row], rank_full[row] + piece - has_rest)
            run = np.searchsorted(keys, size << 48 | place_of, side="right") - 1
            start = np.where(piece == 0, 0, np.where(has_rest, rest[row], length) + (piece - 1) * length)
            ids = batch.column("ids").to_pylist()
            data = [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(sequences[run] + place_of - first[run]), pa.array(offsets[run]), pa.array(data, pa.binary())],
                names=["id", "piece", "start", "length", "sequence_id", "offset", "ids"],
            )

    kinds = [("piece", IntegerType()), *[(c, LongType()) for c in ("start", "length", "sequence_id", "offset")], ("ids", BinaryType())]
    made = placed.mapInArrow(place, StructType([StructField("id", table.schema["id"].dataType), *[StructField(c, t) for c, t in kinds]]))
    return made.withColumnRenamed("id", id_col)
