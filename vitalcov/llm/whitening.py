"""Whitening of embeddings by the leading principal components, found by Chebyshev-filtered subspace iteration.

An entry c becomes the whole number floor(256 c), so that sums are exact and equal vectors are equal. The covariance is that of the distinct vectors (each once, divisor
their number n) and never written down: all the driver holds are blocks of `d` x `BLOCK` numbers, d being the dimension, and every product with the covariance is one pass over
the distinct vectors, which stand as packed matrices in the shared folder. A task centres its matrices, multiplies them with the block, and returns one d x BLOCK
partial sum; partial sums are added up in two steps, so the driver gets at most `MEET` of them.

1. A few block Krylov steps give bounds: where the spectrum begins, and the smallest Ritz value of the block, below which it is unwanted.
2. The block is filtered by the Chebyshev polynomial that stays within -1 and 1 on the unwanted interval and grows steeply beyond it, by its three-term recurrence, one pass
   a degree. The degree is as high as the block's condition allows.
3. QR and Rayleigh-Ritz give new vectors, values and, from the same pass, the residuals |Vq - eq|.
4. Until residuals are below `TOLERANCE` of the largest value and fall no further, or are at rounding level. Then a random block outside the found space is put through
   Krylov steps: no value beyond the last component's may show up there, or the iteration goes on with that block.

A null vector, or one with a null, NaN or infinite entry, is left out; so are vectors of another length than the commonest (the shorter of equally common ones) and empty ones. Entries
beyond the range of a long take its end. Repeated vectors count once for the covariance and are each returned. Components with no variance are not returned: a single
distinct vector gives no row, nor do no rows. Null and repeated ids stay as they are. `deviation` is null where it is beyond a long. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from vitalcov.llm import common

SCALE, COMPONENTS = 256, 4
#: Vectors iterated beyond the wanted ones, numbers in one packed matrix, and partial sums that reach the driver.
GUARD, CELLS, MEET = 20, 1 << 19, 32
#: Residual, as a part of the largest eigenvalue, that is asked for; and where rounding begins.
TOLERANCE, ROUNDING = 1e-11, 2e-15
MOST_ROUNDS, SEED = 200, 12


@dataclass(frozen=True)
class Whitening:
    """`sums` / n is the mean; columns of `vectors` are components by falling `values`; `trace` of the covariance; `residuals` of the components; largest entry of the whitened
    covariance less the identity; passes made over the vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int


def whole_numbers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the list column are usable, and these as a matrix of whole numbers."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = sizes == dims
    values = column.filter(pa.array(right)).flatten()
    plain = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    fine = np.isfinite(plain).all(axis=1)
    usable = np.flatnonzero(right)[fine]
    floors = np.floor(scale * plain[fine])
    edge = 2.0**63
    whole = np.where(np.abs(floors) < edge, floors, 0).astype(np.int64)
    whole[floors >= edge] = np.iinfo(np.int64).max
    whole[floors < -edge] = np.iinfo(np.int64).min
    return usable, whole


def dimension(vectors: DataFrame) -> int:
    """The commonest length of a vector; 0 if there is none."""
    lengths = vectors.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return lengths["d"] if lengths else 0


def packed_distinct(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """The distinct vectors as packed matrices: m (little-endian, row after row), width (bytes of a number) and rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, whole = whole_numbers(batch.column("v"), dims, scale)
            once = np.unique(whole.astype("<i8").view(np.dtype((np.void, 8 * dims))).ravel())  # copies of one batch travel once
            yield pa.RecordBatch.from_arrays([pa.array(once.tolist(), pa.binary())], names=["x"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held = max(1, CELLS // dims), []

        def block(rows: list[bytes]) -> pa.RecordBatch:
            matrix = np.frombuffer(b"".join(rows), "<i8")
            peak = max(-(int(matrix.min()) + 1), int(matrix.max()))
            width = next(w for w in (1, 2, 4, 8) if peak < 1 << (8 * w - 1))
            return pa.RecordBatch.from_arrays([pa.array([matrix.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([len(rows)], pa.int64())], names=["m", "width", "rows"])

        for batch in batches:
            held += batch.column("x").to_pylist()
            while len(held) >= most:
                yield block(held[:most])
                held = held[most:]
        if held:
            yield block(held)

    rows = vectors.mapInArrow(pack, StructType([StructField("x", BinaryType())])).distinct()
    made = rows.mapInArrow(gather, StructType([StructField("m", BinaryType()), StructField("width", IntegerType()), StructField("rows", LongType())]))
    return common.written(made, "distinct_vectors")


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for m, width in zip(batch.column("m"), batch.column("width").to_pylist(), strict=True):
            yield np.frombuffer(m.as_buffer(), f"<i{width}").reshape(-1, dims)


def summed(blocks: DataFrame, dims: int, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of `partial` over all matrices: one float64 array a task, then one for each of MEET groups of tasks, then all."""
    kind = StructType([StructField("k", IntegerType()), StructField("s", BinaryType())])

    def row(total: np.ndarray, k: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "s"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for matrix in matrices(batches, dims):
            total += partial(matrix)
            some = True
        if some:
            yield row(total, TaskContext.get().partitionId() % MEET)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for s in batch.column("s"):
                total += np.frombuffer(s.as_buffer(), np.float64).reshape(shape)
                some = True
        if some:
            yield row(total, 0)

    parts = blocks.mapInArrow(first, kind)
    found = parts.repartition(MEET, "k").mapInArrow(second, kind).toArrow().column("s")
    return sum((np.frombuffer(s.as_buffer(), np.float64).reshape(shape) for s in found), np.zeros(shape))


def exact_sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension as whole numbers. High and low halves are summed apart, so that no sum of a matrix leaves a long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, [0] * dims, [0] * dims
        for matrix in matrices(batches, dims):
            wide = matrix.astype(np.int64)
            rows += len(wide)
            high = [a + int(b) for a, b in zip(high, (wide >> 32).sum(axis=0), strict=True)]
            low = [a + int(b) for a, b in zip(low, (wide & 0xFFFFFFFF).sum(axis=0), strict=True)]
        at = [-1, *range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([0, *high], pa.int64()), pa.array([rows, *low], pa.int64())], names=["at", "high", "low"])

    kind = StructType([StructField("at", IntegerType()), StructField("high", LongType()), StructField("low", LongType())])
    wide = blocks.mapInArrow(add, kind).groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in wide.collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dims)]


class Covariance:
    """The covariance of the packed vectors, known by its products only."""

    def __init__(self, blocks: DataFrame, dims: int, n: int, mean: np.ndarray):
        self.blocks, self.dims, self.n, self.mean, self.passes = blocks, dims, n, mean, 0

    def sum(self, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        self.passes += 1
        return summed(self.blocks, self.dims, partial, shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        mean = self.mean

        def partial(matrix: np.ndarray) -> np.ndarray:
            centred = matrix - mean
            return centred.T @ (centred @ block)

        return self.sum(partial, block.shape) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self.sum(lambda matrix: np.square(matrix - mean).sum(axis=0), (self.dims,)).sum() / self.n)


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block, twice over for full precision; with `against`, outside that space."""
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        block = np.linalg.qr(block)[0]
    return block


def krylov_values(product: Callable[[np.ndarray], np.ndarray], block: np.ndarray, steps: int, against: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (rising), their residuals and Ritz vectors of the block Krylov space of `steps` products; outside the space of `against` if given."""
    room = block.shape[0] - (0 if against is None else against.shape[1])
    basis, image, new = np.empty((block.shape[0], 0)), np.empty((block.shape[0], 0)), block
    for _ in range(steps):
        new = new[:, : room - basis.shape[1]]
        if not new.shape[1]:
            break
        outside = basis if against is None else np.hstack([against, basis])
        new = orthonormal(new, outside)
        basis, made = np.hstack([basis, new]), product(new)
        image, new = np.hstack([image, made]), made
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors, images = basis @ turn, image @ turn
    if against is not None:
        images = images - against @ (against.T @ images)
    return values, np.linalg.norm(images - vectors * values, axis=0), vectors


def filtered(product: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, low: float, high: float) -> np.ndarray:
    """The Chebyshev polynomial of `degree` on [low, high], of the matrix behind `product`, times `block`. Columns are kept at length about 1: scaling all terms alike does no harm."""
    centre, half = (high + low) / 2, (high - low) / 2
    before, now = block, (product(block) - centre * block) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (product(now) - centre * now) / half - before
        size = np.linalg.norm(now, axis=0)
        before, now = before / size, now / size
    return now


def leading(cov: Covariance, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, their vectors as columns, and their residuals, certified."""
    dims, rng = cov.dims, np.random.default_rng(SEED)
    wanted = min(wanted, dims)
    size = min(dims, wanted + GUARD)
    values, errors, vectors = krylov_values(cov.times, rng.standard_normal((dims, size)), 2)
    low = max(0.0, float(values[0] - errors[0]))
    block, theta = vectors[:, ::-1][:, :size], values[::-1][:size]
    residual = errors[::-1][:size]
    last, stalled = np.inf, 0
    for _ in range(MOST_ROUNDS):
        top = theta[0]
        worst = residual[:wanted].max() if top > 0 else 0.0
        stalled = stalled + 1 if worst > 0.5 * last else 0
        last = min(last, worst)
        if top <= 0 or worst <= ROUNDING * top or size == dims or (worst <= TOLERANCE * top and stalled):
            missed = outsiders(cov, block[:, :wanted], theta[wanted - 1], rng)
            if missed is None:
                return theta[:wanted], block[:, :wanted], residual[:wanted]
            block, stalled, last = np.hstack([block[:, : size - missed.shape[1]], missed]), 0, np.inf
            low = 0.0
        # below the block's values, and so far below the wanted ones that these grow even among many equal ones
        high = min(float(theta[-1]), low + 0.9 * (float(theta[wanted - 1]) - low))
        if high <= low:
            low, high = 0.0, 0.9 * float(theta[wanted - 1]) or 0.5 * float(top)
        centre, half = (high + low) / 2, (high - low) / 2
        steep = [np.arccosh(max(1.0, (theta[k] - centre) / half)) for k in (0, wanted - 1)]
        condition, need = steep[0] - steep[1], np.log(1e17 * max(worst / max(top, 1e-300), 1e-16))
        degree = int(np.clip(min(18 / max(condition, 1e-3), need / max(steep[1], 1e-3)), 2, 30))
        block = orthonormal(filtered(cov.times, block, degree, low, high))
        image = cov.times(block)
        small = block.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residual = np.linalg.norm(image - block * theta, axis=0)
        low = max(0.0, min(low, float(theta[-1] - residual[-1])))
    raise ArithmeticError(f"no certified components after {MOST_ROUNDS} rounds")


def outsiders(cov: Covariance, found: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray | None:
    """Vectors outside the found space whose Ritz value is above `least`, or none: a larger value cannot have been passed over, save with a probability that vanishes with the steps."""
    room = cov.dims - found.shape[1]
    if room <= 0:
        return None
    values, errors, vectors = krylov_values(cov.times, rng.standard_normal((cov.dims, min(room, GUARD))), 2, found)
    beyond = values > least * (1 + 1e-9)
    return vectors[:, beyond][:, ::-1][:, :GUARD] if beyond.any() else None


def fit(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, vector_col: str = "embedding") -> Whitening:
    """Mean, leading components and their variances of the distinct vectors."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    dims = dimension(rows)
    empty = Whitening(0, [0] * dims, np.empty(0), np.empty((dims, 0)), 0.0, np.empty(0), 0.0, 0)
    if not dims:
        return empty
    blocks = packed_distinct(rows, dims, scale)
    n, sums = exact_sums(blocks, dims)
    if not n:
        return empty
    mean = np.array([s / n for s in sums])
    cov = Covariance(blocks, dims, n, mean)
    trace = cov.trace()
    if trace <= 0:
        return Whitening(n, sums, np.empty(0), np.empty((dims, 0)), 0.0, np.empty(0), 0.0, cov.passes)
    values, found, residuals = leading(cov, components)
    some = values > dims * np.finfo(float).eps * trace
    values, found, residuals = values[some], found[:, some], residuals[some]
    shape = (len(values), len(values))
    scaled = found / np.sqrt(values)

    def products(matrix: np.ndarray) -> np.ndarray:
        white = (matrix - mean) @ scaled
        return np.vstack([white.T @ white, white.sum(axis=0)])

    total = cov.sum(products, (shape[0] + 1, shape[1])) / n
    error = np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(values))).max()
    return Whitening(n, sums, values, found, trace, residuals, float(error), cov.passes)


def whiten(vectors: DataFrame, model: Whitening, *, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component: `id_col`, component (from 1), n, deviation (sum over dimensions of (n x - S) squared), whitened, explained, identity_error."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    n, dims, count = model.n, len(model.sums), len(model.values)
    sums = np.array(model.sums, object)
    mean = np.array([s / n for s in model.sums]) if n else np.zeros(dims)
    scaled = model.vectors / np.sqrt(model.values)
    explained = (model.values / model.trace if model.trace else model.values).tolist()
    plain, error = (model.values.tolist(), scaled), model.identity_error
    least, most = (min(model.sums, default=0), max(model.sums, default=0))

    def deviations(whole: np.ndarray) -> list[int | None]:
        reach = max(abs(n * int(e) - s) for e in (whole.min(), whole.max()) for s in (least, most))
        if reach * reach * dims < 1 << 63 and max(abs(least), abs(most)) < 1 << 62:
            return np.square(n * whole - sums.astype(np.int64)).sum(axis=1).tolist()
        exact = [sum((n * x - s) ** 2 for x, s in zip(row, model_sums, strict=True)) for row in whole.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    model_sums = list(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, whole = whole_numbers(batch.column("v"), dims, scale) if count else ([], None)
            if not len(usable):
                continue
            white = (whole - mean) @ plain[1]
            again = np.repeat(usable, count)
            ids = batch.column("id").take(pa.array(again))
            size = len(usable)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)), pa.array(np.full(size * count, n, np.int64)), pa.array([x for x in deviations(whole) for _ in range(count)], pa.int64()),
                 pa.array(white.ravel()), pa.array(explained * size), pa.array(np.full(size * count, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kinds = {"component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}
    kind = StructType([StructField("id", rows.schema["id"].dataType), *[StructField(c, t) for c, t in kinds.items()]])
    return rows.mapInArrow(project, kind).withColumnRenamed("id", id_col)
