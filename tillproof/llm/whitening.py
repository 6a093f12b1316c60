"""Whitened embeddings: matrix-free block subspace iteration over the rows.

The covariance V of the rows is never built. A pass over the rows gives V Q = X'(X Q) / n for a block Q of orthonormal
columns, X being the centred rows; the driver holds Q and V Q, a few columns as long as a vector, and no rows.

1. Entries become whole numbers; their sums are exact, so rows are centred on S / n with one rounding.
2. Rayleigh-Ritz: the eigenvectors of Q'(V Q) turn Q towards V's; theta are the eigenvalues so far.
3. The residuals V q - theta q of the wanted components certify them: once all are below `tolerance` times the largest
   eigenvalue, the rest of the algorithm only projects.
4. If not, the next block is V Q's part outside of Q (the residuals) beside the Ritz vectors, made orthonormal by QR.
   The block grows by that up to `widest` times the components, then starts again from the best vectors; in a space that
   the block fills, one pass is enough, and its residuals are rounding.

Every pass is a mapInArrow that emits one row per dimension and task, and a sum over these in Spark, so what a task or
the driver holds doesn't grow with the rows. The whole numbers are written once to the shared folder, so that a lost
executor costs no more than its own tasks.

Vectors that are null, empty or hold null or non-finite entries go. So do those of another length than most vectors
have (of two lengths that are as frequent, the larger one counts). Entries beyond 2**40 in size are taken as that.
Rows of equal or null ids are rows of their own and all count; components without variance (eigenvalue not above rounding)
are left out, as nothing can be scaled to them; an empty table, or one of equal vectors, gives none. The deviation is null
where it doesn't fit a long. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_batches, written

#: Entries become floor(SCALE * entry) + SHIFT; fixed values.
SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
#: Rows that a task multiplies at a time.
ROWS = 4096


def whole_numbers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x: the entries of all vectors that count, as whole numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = rows.select(F.col(f"`{key}`").alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    fine = fine.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    lengths = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    scaled = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c)) * SCALE).cast("long") + SHIFT)
    return fine.where(F.size("v") == (lengths[0].d if lengths else 0)).select("id", scaled.alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


class Centre:
    """The exact sums of n rows; rows come back centred."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = [s // n for s in sums]
        self.rest = np.array([s % n for s in sums], np.float64) / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are subtracted exactly."""
        return (x - np.array(self.base, np.int64)).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n x - S)**2."""
        far = x - np.array(self.base, np.int64)
        rest = [s % self.n for s in self.sums]
        bound = self.n * (int(np.abs(far).max(initial=0)) + 1)
        if bound * bound * x.shape[1] < 1 << 63:
            d = far * self.n - np.array(rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = far.astype(object) * self.n - np.array(rest, object)
        return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def summed(parts: DataFrame, by: str, of: str, width: int) -> list[tuple[int, np.ndarray]]:
    """For each value of `by` the sum over tasks of the arrays `of`, added up in Spark."""
    sums = parts.groupBy(by).agg(F.array(*(F.sum(F.get(of, F.lit(j))) for j in range(width))).alias("s"))
    return [(r[0], np.array(r[1])) for r in sums.collect()]


def totals(rows: DataFrame) -> Centre | None:
    """How many rows, and the exact sum of each dimension: tasks add whole numbers and hand on two parts of each sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[int] = []
        for batch in batches:
            x = matrix(batch)
            for a in range(0, len(x), ROWS):  # few enough for a long
                own = [len(x[a : a + ROWS]), *x[a : a + ROWS].sum(axis=0).tolist()]
                sums = [s + t for s, t in zip(sums or [0] * len(own), own, strict=True)]
        high, low = [s >> 31 for s in sums], [s & (1 << 31) - 1 for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["i", "high", "low"])

    by = rows.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = [(r.high << 31) + r.low for r in sorted(by.collect())]
    return Centre(found[0], found[1:]) if found else None


def multiplied(rows: DataFrame, centre: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, by one pass over the rows."""
    d, b = q.shape

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, trace = np.zeros((d, b)), 0.0
            for batch in batches:
                x = matrix(batch)
                for a in range(0, len(x), ROWS):
                    c = centre.centred(x[a : a + ROWS])
                    out += c.T @ (c @ q)
                    trace += float(np.einsum("ij,ij->", c, c))
            made = np.vstack([out, np.full((1, b), trace)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array(list(made), pa.list_(pa.float64()))], names=["i", "v"])

        return run

    found = dict(summed(rows.mapInArrow(make(), "i int, v array<double>"), "i", "v", b))
    return np.stack([found[i] for i in range(d)]) / centre.n, float(found[d][0]) / centre.n


def spread_of(rows: DataFrame, centre: Centre, w: np.ndarray) -> np.ndarray:
    """The covariance of the whitened rows, centred before they are multiplied."""
    k = w.shape[1]

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sum((centre.centred(matrix(b)) @ w).sum(axis=0) for b in batches) + np.zeros(k)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out], pa.list_(pa.float64()))], names=["i", "v"])

    mean = summed(rows.mapInArrow(means, "i int, v array<double>"), "i", "v", k)[0][1] / centre.n

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k))
        for b in batches:
            z = centre.centred(matrix(b)) @ w - mean
            out += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "v"])

    found = dict(summed(rows.mapInArrow(squares, "i int, v array<double>"), "i", "v", k))
    return np.stack([found[i] for i in range(k)]) / centre.n


def orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' part outside of `against`; columns that hold nothing new are left out."""
    for _ in range(2):
        columns = columns - against @ (against.T @ columns)
        lengths = np.linalg.norm(columns, axis=0)
        columns = columns[:, lengths > 0] / lengths[lengths > 0]
        if not columns.shape[1]:
            return columns
        q, r = np.linalg.qr(columns)
        columns = q[:, np.abs(np.diag(r)) > 1e-10]
    return columns


def components(rows: DataFrame, centre: Centre, k: int = 32, extra: int = 8, widest: int = 4, tolerance: float = 1e-13, passes: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """The first k eigenvalues above rounding, their unit eigenvectors as columns, and the trace of V."""
    d = len(centre.sums)
    k, block = min(k, d), min(k + extra, d)
    q = np.linalg.qr(np.random.default_rng(12).standard_normal((d, block)))[0]
    for _ in range(passes):
        vq, trace = multiplied(rows, centre, q)
        small = q.T @ vq
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, image = q @ turn, vq @ turn
        residual = image - ritz * theta
        error = np.linalg.norm(residual[:, :k], axis=0)
        if theta[0] <= 0 or q.shape[1] == d or (error <= tolerance * theta[0]).all():
            real = int((theta[:k] > d * np.finfo(float).eps * max(theta[0], 0)).sum())
            return theta[:real], ritz[:, :real], trace
        keep = q.shape[1] if q.shape[1] + block <= widest * block or q.shape[1] + block >= d else block
        kept = np.linalg.qr(ritz[:, :keep])[0]
        new = orthonormal(residual[:, :block], kept)[:, : d - keep]
        if not new.shape[1] and keep < d:  # what is left of the space holds nothing of V; its rounding alone is in the way
            new = orthonormal(np.random.default_rng(keep).standard_normal((d, min(block, d - keep))), kept)
        q = np.hstack([kept, new])
    raise RuntimeError(f"residuals of {error.max():g} after {passes} passes; the bound is {tolerance * theta[0]:g}")


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 32, **how) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error for every row that counts and each component.

    how: parameters of components().
    """
    kind = rows.select(F.col(f"`{key}`")).schema[0].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    bounded_batches(rows.sparkSession)
    numbers = written(whole_numbers(rows, key, vector), "whitening")
    centre = totals(numbers)
    if centre is None:
        return rows.sparkSession.createDataFrame([], schema)
    e, vectors, trace = components(numbers, centre, k, **how)
    m = len(e)
    if not m:
        return rows.sparkSession.createDataFrame([], schema)
    w = vectors / np.sqrt(e)
    error = float(np.abs(spread_of(numbers, centre, w) - np.eye(m)).max())

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, ids = matrix(batch), batch.column("id")
            z, n = centre.centred(x) @ w, len(x)
            at = pa.array(np.repeat(np.arange(n), m))
            far = pa.array(centre.deviations(x), pa.int64())
            columns = [ids.take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)), pa.array(np.full(n * m, centre.n)), far.take(at), pa.array(z.ravel()), pa.array(np.tile(e / trace, n)), pa.array(np.full(n * m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return step

    return in_batches(numbers, make, schema)
