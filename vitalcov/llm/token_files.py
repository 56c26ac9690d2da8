"""Token ids as patched frame-of-reference blocks in files.

A segment is a run of whole documents in ascending order of id, about SEGMENT_IDS ids long, and one row of the table that is written. Its payload:

    magic "PFR1", then little-endian 32-bit: ids, ids in a block, blocks, bytes of the exception lists
    for each block: minimum (32 bit), width in bits (8 bit), exceptions (16 bit)
    block starts in the packed part (32 bit, one more than blocks): the index
    packed part: per block, values less the block's minimum in `width` bits, low bits of the outliers included
    exception lists: places in their block (16 bit), then the bits above `width` (32 bit)

The width of a block is that of its values' percentile PERCENTILE; the values above it are its exceptions. Any block can be read alone.
Next to the payload stand the documents' ids, their counts of ids, the number of the range partition and the ids before the segment in it.

A null text counts as empty. Rows with one id lie side by side, ordered by text; a null id comes first. No rows give an empty table. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcov.llm import common, packing, tokens

BLOCK, PERCENTILE, SEGMENT_IDS = 512, 90, 1 << 16
HEAD = "<4s4I"


def pack_block_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, low bits first. Eight values fill `width` bytes; up to 16 bits they are put together in two words."""
    if width == 0:
        return np.empty((len(values), 0), np.uint8)
    if width > 16 or values.shape[1] % 8:
        bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    eight = values.reshape(-1, 8).astype(np.uint64)
    low, high = eight[:, 0].copy(), eight[:, 4].copy()
    for k in (1, 2, 3):
        low |= eight[:, k] << np.uint64(k * width)
        high |= eight[:, 4 + k] << np.uint64(k * width)
    words = np.zeros((len(eight), 2), "<u8")
    if width == 16:
        words[:, 0], words[:, 1] = low, high
    else:
        words[:, 0] = low | (high << np.uint64(4 * width))
        words[:, 1] = high >> np.uint64(64 - 4 * width)
    return np.ascontiguousarray(words.view(np.uint8)[:, :width]).reshape(len(values), -1)


def unpack_block_bits(data: np.ndarray, width: int, count: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(data), count), np.uint32)
    if width > 16 or count % 8:
        bits = np.unpackbits(data, axis=1, count=count * width, bitorder="little").reshape(len(data), count, width)
        out = np.zeros((len(data), count), np.uint32)
        for k in range(width):
            out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        return out
    words = np.zeros((len(data) * count // 8, 16), np.uint8)
    words[:, :width] = data.reshape(-1, width)
    words = words.view("<u8")
    low, high = words[:, 0], words[:, 1]
    if width < 16:
        high = (low >> np.uint64(4 * width)) | (high << np.uint64(64 - 4 * width))
    keep = np.uint64((1 << width) - 1)
    out = np.empty((len(words), 8), np.uint32)
    for k in range(4):
        out[:, k] = (low >> np.uint64(k * width)) & keep
        out[:, 4 + k] = (high >> np.uint64(k * width)) & keep
    return out.reshape(len(data), count)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The payload of `ids` (unsigned 32-bit). The last block is filled up with its own minimum."""
    n = len(ids)
    blocks = -(-n // block)
    grid = np.empty(blocks * block, np.uint32)
    grid[:n] = ids
    if blocks:
        grid[n:] = ids[(blocks - 1) * block :].min()
    grid = grid.reshape(blocks, block)
    low = grid.min(axis=1, initial=2**32 - 1) if blocks else np.empty(0, np.uint32)
    rest = grid - low[:, None]
    rank = min(block - 1, block * percentile // 100)
    usual = np.partition(rest, rank, axis=1)[:, rank] if blocks else np.empty(0, np.uint32)
    width = np.ceil(np.log2(usual.astype(np.float64) + 1)).astype(np.uint8)
    out = rest.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    row, place = np.nonzero(out)
    high = (rest[row, place].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
    sizes = (block * width.astype(np.int64) + 7) // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.empty(starts[-1], np.uint8)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        keep = np.uint32((1 << int(w)) - 1)
        body[(starts[mine][:, None] + np.arange(sizes[mine[0]])).ravel()] = pack_block_bits(rest[mine] & keep, int(w)).ravel()
    lists = place.astype("<u2").tobytes() + high.tobytes()
    return b"".join([struct.pack(HEAD, b"PFR1", n, block, blocks, len(lists)), low.astype("<u4").tobytes(), width.tobytes(), out.sum(axis=1).astype("<u2").tobytes(), starts.astype("<u4").tobytes(), body.tobytes(), lists])


def decode_segment(payload: bytes, blocks: range | None = None) -> np.ndarray:
    """All ids of a payload, or those of a range of its blocks, found by the index."""
    magic, n, block, count, n_lists = struct.unpack_from(HEAD, payload)
    if magic != b"PFR1":
        raise ValueError("no segment of token blocks")
    at = struct.calcsize(HEAD)
    low = np.frombuffer(payload, "<u4", count, at)
    width = np.frombuffer(payload, np.uint8, count, at := at + 4 * count)
    exceptions = np.frombuffer(payload, "<u2", count, at := at + count).astype(np.int64)
    starts = np.frombuffer(payload, "<u4", count + 1, at := at + 2 * count).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, int(starts[-1]), at := at + 4 * (count + 1))
    total = int(exceptions.sum())
    place = np.frombuffer(payload, "<u2", total, at := at + int(starts[-1]))
    high = np.frombuffer(payload, "<u4", total, at + 2 * total)
    wanted = range(count) if blocks is None else blocks
    grid = np.zeros((len(wanted), block), np.uint32)
    some = np.arange(wanted.start, wanted.stop)
    for w in np.unique(width[some]):
        mine = some[width[some] == w]
        size = (block * int(w) + 7) // 8
        grid[mine - wanted.start] = unpack_block_bits(body[(starts[mine][:, None] + np.arange(size))], int(w), block)
    row = np.repeat(np.arange(count), exceptions)
    chosen = (row >= wanted.start) & (row < wanted.stop)
    row, place, high = row[chosen], place[chosen].astype(np.int64), high[chosen]
    grid[row - wanted.start, place] |= high << width[row].astype(np.uint32)
    grid += low[some][:, None]
    return grid.ravel()[: max(0, min(n, wanted.stop * block) - wanted.start * block)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, spaced: bool = True, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every text, appends `end_id` and writes the segments under `path`, in ascending order of id over partitions and rows."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, local = tokens.encoder(tokenizer, spaced), TaskContext.get().partitionId(), 0
        kind = None
        held_ids, held, size = [], [], 0

        def segment() -> pa.RecordBatch:
            payload = encode_segment(np.frombuffer(b"".join(held), "<u4"))
            counts = [len(x) // 4 for x in held]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([local], pa.int64()), pa.array([size], pa.int64()), pa.array([held_ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["part", "local", "n_tokens", "doc_ids", "doc_counts", "payload"])

        for batch in common.pieces(batches, "text"):
            kind = batch.schema.field("id").type
            for key, ids in zip(batch.column("id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                held_ids.append(key)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= segment_ids:
                    yield segment()
                    local += size
                    held_ids, held, size = [], [], 0
        if held:
            yield segment()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    ordered.mapInArrow(encode, f"part int, local long, n_tokens long, doc_ids array<{kind}>, doc_counts array<long>, payload binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document from the files: `id_col`, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit)."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts, begin, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "doc_counts", "begin", "payload")), strict=True):
                data, ends = decode_segment(payload).astype("<u4").tobytes(), np.cumsum(counts)
                starts = ends - counts
                found = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("doc_ids").type.value_type), pa.array(begin + starts), pa.array(counts, pa.int64()), pa.array(found, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    placed = table.join(F.broadcast(packing.part_starts(table)), "part").select("doc_ids", "doc_counts", (F.col("part_start") + F.col("local")).alias("begin"), "payload")
    return placed.mapInArrow(decode, f"id {kind}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
