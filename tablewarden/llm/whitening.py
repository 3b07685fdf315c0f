"""Operator 13: whitening of embeddings by LOBPCG, with products of the covariance and a block computed on the executors.

Components become integers, x = floor(scale * c) + shift, so n and the sums S are exact, and n * x - S is exact too: rows are
centred before anything is multiplied. The covariance itself is never formed. Each iteration sends an orthonormal basis of the
iterate, residual and previous direction blocks to the rows (a few vectors of the embedding's length) and gets back the product
of the covariance with it; Rayleigh-Ritz on that subspace gives the next iterate. It ends when each
residual, |V u - e u|, is at most `TOLERANCE` of the greatest eigenvalue, by a product of its own. `GUARD` vectors more than asked for are
iterated, so that no wanted one is missed. Partial products are summed in groups, so the driver gets at most `GROUPS` of them.

Defined results: vectors that are null or hold null or non-finite components, or have another length than the most frequent
one (of equally frequent ones the longest), are dropped; rows that share an id, or have none, are each a row; components of eigenvalue at most
`NOTHING` of the greatest have no scale and are left out, so a table of equal vectors gives no rows, and neither does an empty one; a
deviation beyond 64 bits is null, and components beyond HELD are held there; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, session_defaults, written
from .vector_search import matrix, usable

TOLERANCE = 1e-13
#: A residual that no longer falls is accepted below this.
ROUNDING = 1e-11
NOTHING = 1e-12
#: Where greater integers are held.
HELD = 1 << 61
GUARD = 8
GROUPS = 64
ROUNDS = 200


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact: longs, or Python integers where longs could overflow."""
    top = max(abs(int(x.max())), abs(int(x.min())), 1) * n if x.size else 1
    if 2 * top < 1 << 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def deviations(scaled: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exact; None beyond 64 bits."""
    top = max((abs(int(scaled.max())), abs(int(scaled.min()))), default=0) if scaled.size else 0
    if top * top * max(1, scaled.shape[1]) < 1 << 63:
        s = scaled.astype(np.int64)
        return (s * s).sum(1).tolist()
    sums = (scaled.astype(object) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in sums]


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over Arrow batches of part(integer matrix), an array of doubles; first by task, then by group of tasks."""

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(matrix(batch.column("v")))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()])], ["part", "m"])

    def by_group(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_py()) for m in table.column("m"))
        return pa.table({"m": [total.tobytes()]})

    got = rows.select("v").mapInArrow(by_task, "part int, m binary").groupBy("part").applyInArrow(by_group, "m binary").collect()
    return sum((np.frombuffer(r["m"]) for r in got), np.zeros(int(np.prod(shape)))).reshape(shape)


def orthonormal(block: np.ndarray, against: np.ndarray | None = None, least: float = 1e-8) -> np.ndarray:
    """An orthonormal basis of the block's part outside `against`; directions that nearly vanish are dropped."""
    for _ in range(2):  # twice is enough
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if against is not None:
            block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric operator, with unit eigenvectors (columns) and the residuals' norms.

    product: of the operator and a block of columns.
    """
    k = min(k, dims)
    wide = min(dims, k + GUARD)
    x = orthonormal(np.random.default_rng(seed).standard_normal((dims, wide)))
    basis, before, last = x, None, np.inf
    for _ in range(ROUNDS):
        image = product(basis)
        small = basis.T @ image
        values, c = np.linalg.eigh((small + small.T) / 2)
        c, values = c[:, ::-1][:, :wide], values[::-1][:wide]
        new, image = basis @ c, image @ c
        before = new - x @ (x.T @ new) if basis is not x else None  # the direction just taken
        x = new
        residual = image - x * values
        size = np.linalg.norm(residual[:, :k], axis=0)
        worst, top = float(size.max(initial=0.0)), float(abs(values[0])) if dims else 0.0
        if worst <= TOLERANCE * top or worst <= ROUNDING * top and worst >= last / 2:
            x = orthonormal_columns(x)[:, :k]
            image = product(x)
            values = np.einsum("ij,ij->j", x, image)
            size = np.linalg.norm(image - x * values, axis=0)
            if size.max(initial=0.0) <= ROUNDING * top:
                return values, x, size
        last = worst
        x = orthonormal_columns(x)
        extra = orthonormal(residual, x)
        basis = np.concatenate((x, extra), 1)
        if before is not None and basis.shape[1] < dims:
            basis = np.concatenate((basis, orthonormal(before, basis)), 1)
        basis = basis[:, :dims]
    raise ArithmeticError(f"residuals stay at {worst:.3g} of {top:.3g} after {ROUNDS} rounds")


def orthonormal_columns(x: np.ndarray) -> np.ndarray:
    """The orthonormal block nearest to x, column by column (x is nearly so)."""
    u, _, v = np.linalg.svd(x, full_matrices=False)
    return u @ v


def whitened(vectors: DataFrame, k: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual of each row and component."""
    spark = vectors.sparkSession
    session_defaults(spark)
    rows = written(usable(vectors).select("vec_id", F.transform("v", lambda c: F.greatest(F.least(F.floor(c * scale).cast("long"), F.lit(HELD)), F.lit(-HELD)) + shift).alias("v")), "integers")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    sums = rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("dim").collect()
    if not sums:
        return spark.createDataFrame([], schema)
    n, total, dims = sums[0]["n"], np.array([int(r["s"]) for r in sums], object), len(sums)

    def centre(x: np.ndarray) -> np.ndarray:
        return centred(x, n, total).astype(float) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ block)

        return summed(rows, part, block.shape) / n

    trace = float(summed(rows, lambda x: np.array([(centre(x) ** 2).sum()]), (1,))[0]) / n
    values, vectors_, residuals = lobpcg(product, dims, k)
    some = values > NOTHING * max(values.max(initial=0.0), 0.0)
    values, vectors_, residuals = values[some], vectors_[:, some], residuals[some]
    if not len(values):
        return spark.createDataFrame([], schema)
    vectors_ = vectors_ * np.sign(vectors_[np.abs(vectors_).argmax(0), np.arange(len(values))])
    onto, explained = vectors_ / np.sqrt(values), values / trace
    mean = summed(rows, lambda x: (centre(x) @ onto).sum(0), (len(values),)) / n

    def square(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ onto - mean
        return z.T @ z

    error = float(np.abs(summed(rows, square, (len(values),) * 2) / n - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scaled = centred(matrix(part.column("v")), n, total)
                which = np.repeat(np.arange(part.num_rows), m)
                z = scaled.astype(float) / n @ onto
                tiled = lambda x: np.tile(x, part.num_rows)
                cols = [part.column("vec_id").take(pa.array(which)), tiled(np.arange(1, m + 1, dtype=np.int32)), np.full(len(which), n, np.int64), pa.array(deviations(scaled), pa.int64()).take(pa.array(which)), z.ravel(), tiled(explained), np.full(len(which), error), tiled(residuals)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(documents(spark, sf_dir, "embeddings"))
