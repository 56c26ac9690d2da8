"""Packing of token ids into sequences of one length: concatenate and cut.

Pass one encodes every text once and writes ids, partition number and the running total inside the partition. The totals of the partitions,
one small row each, give by a prefix sum where each partition starts in the stream of all ids. Pass two cuts each document at the multiples of the
sequence length; a document that crosses one leaves a piece on either side. No text or id is shuffled, and only the last sequence is not full.

A null text counts as empty and gives the end id alone. Repeated rows are packed as often as they occur. No rows give no pieces. Other columns are ignored.
The order of the stream is the order of pass one's partitions and rows, fixed by the table it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalcov.llm import common, tokens


def encoded(docs: DataFrame, tokenizer: str, end_id: int, *, spaced: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its ids (little-endian 32-bit, end id included), with `part`, the task that made it, and `local`, the ids before it in that task."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total, part = tokens.encoder(tokenizer, spaced), 0, TaskContext.get().partitionId()
        for batch in common.pieces(batches, "text"):
            found = [ids + end for ids in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            counts = np.array([len(ids) // 4 for ids in found], np.int64)
            before = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part, np.int32)), pa.array(before), batch.column("id"), pa.array(counts), pa.array(found, pa.binary())], names=["part", "local", "id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"part int, local long, id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")


def part_starts(table: DataFrame) -> DataFrame:
    """`part` and the ids before it. One row for each task that wrote the table, which the scheduler of the driver holds a record of as well."""
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("part_start"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, length: int = 2048, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: `id_col`, start (ids of its document before it), length, doc_tokens, sequence_id, offset and ids (little-endian 32-bit)."""
    table = common.written(encoded(docs, tokenizer, end_id, spaced=spaced, id_col=id_col, text_col=text_col), "encoded")
    kind = table.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "ids", 1 << 22):
            begins = batch.column("begin").to_numpy()
            counts = batch.column("n_tokens").to_numpy()
            first, last = begins // length, (begins + counts - 1) // length
            many = last - first + 1
            row = np.repeat(np.arange(batch.num_rows), many)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            low = np.maximum(sequence * length, begins[row])
            high = np.minimum((sequence + 1) * length, (begins + counts)[row])
            start = low - begins[row]
            ids = batch.column("ids").to_pylist()
            data = [ids[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), (start + high - low).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(start), pa.array(high - low), pa.array(counts[row]), pa.array(sequence), pa.array(low - sequence * length), pa.array(data, pa.binary())],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    placed = table.join(F.broadcast(part_starts(table)), "part").select("id", (F.col("part_start") + F.col("local")).alias("begin"), "n_tokens", "ids")
    made = placed.mapInArrow(cut, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return made.withColumnRenamed("id", id_col)
