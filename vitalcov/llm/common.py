"""Helpers shared by the corpus operators: input tables, shared scratch tables, Arrow batches in bounded pieces, word hashes."""

from __future__ import annotations

import contextlib
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task looks at together. Bounds its memory; a single longer text is still taken whole.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a folder of our own where it is unset (local runs and tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="vitalcov-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vitalcov-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, tables that are written pass at most `rows` rows to Python in one Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Shared:
    """A value broadcast by value: workers need no copy of the modules its classes are from."""

    def __init__(self, spark: SparkSession, value: object):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        """The value, unpacked once in each task that asks for it."""
        return pickle.loads(self.packed.value)


def free_name(taken: Iterable[str], name: str) -> str:
    """`name`, made longer until no column has it, in whatever letter case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def left_join(left: DataFrame, right: DataFrame, on: str | list[str], most_rows: int = 500_000) -> DataFrame:
    """Left join with a narrow table: broadcast after a count of its rows, shuffled if there are more than `most_rows`."""
    return left.join(F.broadcast(right) if right.limit(most_rows + 1).count() <= most_rows else right, on, "left")


def crc_of_id(column: Column) -> Column:
    """crc32 of the id written as text, as the held-out folds define it."""
    return F.crc32(column.cast("string").cast("binary"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes in `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            seen = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, seen + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def worker_state(key: str, make: Callable[[], object]) -> object:
    """What `make` builds, once in the life of a Python worker."""
    state = sys.__dict__.setdefault("_vitalcov_llm_state", {})
    if key not in state:
        state[key] = make()
    return state[key]


class WordHashes(dict):
    """64-bit hash of each word (bytes). Keeps what it has seen, up to `limit` words."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        self.hash, self.limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        if len(word) < 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive word hashes; empty when there are fewer. Grown by doubling, so log2(size) passes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    have, length, out, done = words, 1, None, 0
    left = size
    while left:
        if left & 1:
            part = have[done : done + n]
            out = part.copy() if out is None else mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += length
        left >>= 1
        if left:
            have = mixed(have[: len(have) - length] * np.uint64(0xD1342543DE82EF95) + have[length:])
            length *= 2
    return out


def flat(values: list[bytes | None]) -> list[bytes]:
    return [v or b"" for v in values]
