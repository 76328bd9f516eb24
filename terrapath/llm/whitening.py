"""Whitening of embeddings by block subspace iteration: the covariance is only ever multiplied with, never built.

A Spark pass over the fit list forms Xᵀ(XQ) of the centred rows, task by task, and sums the d x p numbers. On the
driver, where all matrices are d x p or p x p, Rayleigh-Ritz turns the block into approximate components; each of the
k wanted ones is certified by its residual ``|Vq - eq|``. While one is too large, the block is filtered by a Chebyshev
polynomial of V (damping everything between 0 and the least Ritz value of the block), each degree being one more
pass, and orthonormalised by QR.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Columns of the block (or the dimensions, if fewer), degree of the filter, and the residual that certifies, relative to the largest eigenvalue.
BLOCK, DEGREE, TOLERANCE = 32, 8, 2e-13
#: Passes after which the residuals must have come down; a larger number changes no result.
MAX_PASSES = 2_000
#: Fixed-point steps of an entry of 1.
SCALE = 256
LONG_MAX = 2**63 - 1


def fixed_point(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` (vec_id, x) without the rows whose vector is null or holds a null or non-finite entry; x is floor(256 * entry), as longs."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))  # NaN counts as larger than infinity
    return kept.filter(F.col("v").isNotNull() & whole).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _padded(rows: DataFrame, dims: int) -> DataFrame:
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S exactly, in whole numbers, and x - S / n as doubles."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), max(map(abs, sums), default=0))
    kind = np.int64 if (largest * n + largest) * 2 < LONG_MAX else object
    exact = x.astype(kind) * n - np.array(sums, dtype=kind)
    return exact, (exact / n).astype(np.float64)


def _summed(fit: DataFrame, dims: int, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of ``part``, which maps a matrix of rows to an array of ``shape``; each task sends its sum's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            total += part(_matrix(b, dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "part"])

    cells = fit.mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part"))
    found = np.zeros(int(np.prod(shape)))
    for r in cells.collect():  # as many rows as the shape has cells
        found[r["cell"]] = r["part"]
    return found.reshape(shape)


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), vectors and their products with V, of V within the span of ``q``."""
    inner = q.T @ vq
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], q @ turn[:, ::-1], vq @ turn[:, ::-1]


def components(multiply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int = BLOCK, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues and unit eigenvectors (as columns) of the matrix that ``multiply`` multiplies with, and the number of products.

    A spectrum so flat that ``MAX_PASSES`` products don't certify it is an error; a wider block helps then. Of equal
    eigenvalues any orthonormal basis is returned.
    """
    k, width, passes = min(k, dims), min(dims, max(block, k)), 0
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((dims, width)))[0]
    while True:
        values, q, vq = _ritz(q, multiply(q))
        passes += 1
        residuals = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0)
        if residuals.max(initial=0) <= TOLERANCE * max(values[0], 0):
            # One more orthonormalisation takes out what rounding left.
            return values[:k], np.linalg.qr(q[:, :k])[0] * np.sign(np.diag(np.linalg.qr(q[:, :k])[1])), passes
        if passes >= MAX_PASSES:
            raise ValueError(f"residuals {residuals} after {passes} passes: choose a block wider than {width}")
        half = max(values[-1], values[0] * 1e-12) / 2  # [0, 2 half] is damped
        last, now = q, (vq - half * q) / half
        for _ in range(degree - 1 if width < dims else 0):
            last, now = now, 2 * (multiply(now) - half * now) / half - last
            passes += 1
            scale = np.linalg.norm(now, axis=0)
            last, now = last / scale, now / scale
        q = np.linalg.qr(now if width < dims else q)[0]


def whiten(vectors: DataFrame, k: int = 4, block: int = BLOCK, vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and each of the first k components.

    Rows whose vector is null or holds null or non-finite entries go; rows of null or repeated ids are kept each. The fit
    list holds each distinct vector once, so copies don't weigh. A vector shorter than the longest one counts as ending
    in zeros. There are no more components than dimensions; a component without variance has a null ``whitened`` and
    0 as ``explained``. ``deviation`` is exact, and null where it doesn't fit a long. Equal eigenvalues may give any basis of
    their space, the same for all rows. Other columns are not read; no rows give no rows.
    """
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = fixed_point(vectors, vector_col)
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], schema)
    rows = _padded(rows, dims)
    fit = materialize(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = [0] * dims
    for r in fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():  # a row a dimension
        sums[r["i"]] = int(r["s"])

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)[1]
            return c.T @ (c @ q)

        return _summed(fit, dims, q.shape, part) / n

    values, q, _ = components(multiply, dims, k, block)
    trace = float(_summed(fit, dims, (1,), lambda x: np.array([np.sum(_centred(x, n, sums)[1] ** 2)]))[0]) / n
    varied = values > dims * np.finfo(float).eps * max(trace, 0)
    roots = np.sqrt(np.where(varied, values, 1))

    def inner(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums)[1] @ q / roots
        return w.T @ w

    error = float(np.abs(_summed(fit, dims, (len(values),) * 2, inner) / n - np.eye(len(values)))[np.ix_(varied, varied)].max(initial=0))
    explained = [float(e / trace) if ok else 0.0 for e, ok in zip(values, varied, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(values)
        for b in batches:
            exact, c = _centred(_matrix(b, dims), n, sums)
            m = len(exact)
            whole = exact if exact.dtype != object and float(np.abs(exact).max(initial=0)) ** 2 * dims < 2**62 else exact.astype(object)
            deviation = [int(d) if d <= LONG_MAX else None for d in np.sum(whole * whole, axis=1)]
            w = (c @ q / roots).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), width), pa.int64(), from_pandas=True),
                    pa.array(np.tile(np.arange(1, width + 1), m), pa.int32()),
                    pa.array(np.full(m * width, n), pa.int64()),
                    pa.array([d for d in deviation for _ in range(width)], pa.int64()),
                    pa.array(w, pa.float64(), mask=~np.tile(varied, m)),
                    pa.array(np.tile(explained, m), pa.float64()),
                    pa.array(np.full(m * width, error), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
