"""Approximate nearest neighbours by a permutation index.

A vector is represented by its `near` nearest pivots, in order. An index block holds up to
`block` vectors and a file that lists, for each pivot, the vectors that have it among theirs, by rank.
A query reads the lists of its own pivots, ranks the block's vectors by the induced footrule distance
(a pivot that one side lacks has the rank `near`), and the best `share` of the block are
scored again by the exact cosine. Every row is indexed; only the choice of pivots takes a bounded
sample. Queries meet the index block by block, an exchange on a slot number; the nearest k of each block go on.

Edge cases: vectors that are null, zero, of another length than the pivots, or hold null or non-finite
components take no part, neither do rows without id; ids that repeat among the queries are asked once, and a query's own id is
no candidate for it; fewer than k candidates are all returned; equal scores go by the smaller id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, in_batches, spread, written


def usable(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a proper vector, and those vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.array([-1 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    flat = pc.list_flatten(column)
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(length[length > 0]).argmax()) if dim is None and (length > 0).any() else dim or 0
    size = np.maximum(length, 0)
    rows = np.flatnonzero(length == dim) if dim else np.zeros(0, np.int64)
    x = values[spread((np.cumsum(size) - size)[rows], np.full(len(rows), dim))].reshape(len(rows), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = (x * x).sum(1)
    good = np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm)
    return rows[good], x[good]


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


class Pivots:
    def __init__(self, x: np.ndarray, near: int):
        self.x = (x / norms(x)[:, None]).astype(np.float32) if len(x) else x.astype(np.float32)
        self.near = min(near, len(x))

    def order(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        c = (x / norms(x)[:, None]).astype(np.float32) @ self.x.T
        part = np.argpartition(-c, self.near - 1, axis=1)[:, : self.near]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(c, part, 1), axis=1, kind="stable"), 1)


def choose(vectors: DataFrame, key: str, column: str, pivots: int, near: int, sample: int = 4096) -> Pivots:
    """Pivots at random, from the `sample` rows with the least hash of the id; a bounded sample."""
    rows = vectors.select(F.col(column).alias("v")).where(F.col(key).isNotNull() & F.col(column).isNotNull()).orderBy(F.xxhash64(key), F.xxhash64(column)).limit(sample)
    found = rows.toArrow().column("v")
    if not len(found):
        return Pivots(np.zeros((0, 0)), near)
    x = np.unique(usable(found)[1], axis=0)
    draw = np.random.default_rng(11).permutation(len(x))[:pivots]
    return Pivots(x[draw], near)


def index(vectors: DataFrame, pivots: Pivots, key: str, column: str, block: int = 4096, slots: int = 64) -> DataFrame:
    """Index blocks: ids, vectors and the pivots' lists, as bytes; slot deals them out."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = "slot int, n int, dim int, ids binary, x binary, starts binary, rows binary, ranks binary"
    bounded_batches(vectors.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        pivots, ids, xs, part, number = shared.value, [], [], TaskContext.get().partitionId(), 0

        def flush():
            nonlocal ids, xs, number
            i, x = np.concatenate(ids), np.concatenate(xs)
            order = pivots.order(x)
            pivot, rank = order.ravel(), np.tile(np.arange(pivots.near), len(x))
            by = np.lexsort([rank, pivot])
            starts = np.searchsorted(pivot[by], np.arange(len(pivots.x) + 1))
            raw = [i.astype("<i8"), x.astype("<f8"), starts.astype("<u4"), (by // pivots.near).astype("<u4"), rank[by].astype("<u2")]
            row = [pa.array([(part * 7919 + number) % slots], pa.int32()), pa.array([len(i)], pa.int32()), pa.array([x.shape[1]], pa.int32()), *(pa.array([r.tobytes()]) for r in raw)]
            ids, xs, number = [], [], number + 1
            return pa.RecordBatch.from_arrays(row, ["slot", "n", "dim", "ids", "x", "starts", "rows", "ranks"])

        for batch in batches:
            good, x = usable(batch.column(column), pivots.x.shape[1])
            i = batch.column(key).to_numpy(zero_copy_only=False)[good].astype(np.int64)
            for a in range(0, len(i), block):
                ids.append(i[a : a + block])
                xs.append(x[a : a + block])
                if sum(map(len, ids)) >= block:
                    yield flush()
        if sum(map(len, ids)):
            yield flush()

    return vectors.select(key, column).where(F.col(key).isNotNull()).mapInArrow(run, schema)


def query_blocks(queries: DataFrame, pivots: Pivots, key: str, column: str) -> DataFrame:
    """The queries' ids, vectors and pivots, a batch to a row."""
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def make():
        pivots = shared.value

        def step(batch: pa.RecordBatch):
            good, x = usable(batch.column(column), pivots.x.shape[1])
            if len(good):
                i = batch.column(key).to_numpy(zero_copy_only=False)[good].astype("<i8")
                raw = [i, x.astype("<f8"), pivots.order(x).astype("<u2")]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()]) for r in raw], ["q_ids", "q_x", "q_order"])

        return step

    return in_batches(queries.select(key, column), make, "q_ids binary, q_x binary, q_order binary")


class Block:
    """An index block in memory."""

    def __init__(self, r: dict, near: int):
        self.ids, self.x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["x"], "<f8").reshape(r["n"], r["dim"])
        self.starts, self.rows, self.ranks = np.frombuffer(r["starts"], "<u4").astype(np.int64), np.frombuffer(r["rows"], "<u4"), np.frombuffer(r["ranks"], "<u2").astype(np.int64)
        self.near, self.norm = near, norms(self.x)

    def gains(self, order: np.ndarray) -> np.ndarray:
        """By how much each vector's footrule distance falls short of that of one without a common pivot."""
        n = self.starts[order + 1] - self.starts[order]
        at = spread(self.starts[order], n)
        rank = np.repeat(np.arange(len(order)), n)
        return np.bincount(self.rows[at], self.near - np.maximum(rank, self.ranks[at]), len(self.ids))

    def search(self, query: int, x: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest k of the best share by the footrule distance: ids and cosines."""
        gain = self.gains(order)
        gain[self.ids == query] = -1
        most = min(len(gain), max(32 * k, int(share * len(gain))))
        c = np.argpartition(-gain, most - 1)[:most]
        c = c[gain[c] >= 0]
        score = (self.x[c] * x).sum(1) / (self.norm[c] * np.sqrt((x * x).sum()))
        best = np.lexsort([self.ids[c], -score])[:k]
        return self.ids[c[best]], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 5, pivots: int = 256, near: int = 64, share: float = 0.15, slots: int = 64, block: int = 4096) -> DataFrame:
    """query_id, rank, <key>, score: the k nearest of every query by cosine."""
    schema = f"query_id long, `{key}` long, score double"
    chosen = choose(vectors, key, column, pivots, near)
    if not len(chosen.x):
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    blocks = written(index(vectors, chosen, key, column, block, slots), "index")
    asked = written(query_blocks(queries.where(F.col(key).isNotNull()).dropDuplicates([key]), chosen, key, column), "queries")
    dealt = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # A planner sees the queries as they are stored, not dealt to every slot: the merge keeps them from being broadcast.
    pairs = blocks.hint("merge").join(dealt, "slot")
    size = chosen.near

    def make():
        last: list = [None, None]

        def step(batch: pa.RecordBatch):
            for r in batch.to_pylist():
                if last[0] != (r["ids"], r["starts"]):
                    last[:] = [(r["ids"], r["starts"]), Block(r, size)]
                block = last[1]
                q = np.frombuffer(r["q_ids"], "<i8")
                x, order = np.frombuffer(r["q_x"], "<f8").reshape(len(q), -1), np.frombuffer(r["q_order"], "<u2").reshape(len(q), -1).astype(np.int64)
                found = [block.search(int(i), x[n], order[n], k, share) for n, i in enumerate(q.tolist())]
                many = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, many)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", key, "score"])

        return step

    names = ["n", "dim", "ids", "x", "starts", "rows", "ranks", "q_ids", "q_x", "q_order"]
    found = in_batches(pairs.select(*names), make, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")


def recall(vectors: np.ndarray, ids: np.ndarray, found: dict[int, list[int]], k: int = 5) -> float:
    """The share of the true k nearest that was found, against brute force."""
    u = vectors / norms(vectors)[:, None]
    at = {int(i): n for n, i in enumerate(ids)}
    hits = total = 0
    for query, got in found.items():
        score = u @ u[at[query]]
        score[at[query]] = -np.inf
        true = ids[np.lexsort([ids, -score])[:k]]
        hits, total = hits + len(set(true.tolist()) & set(got)), total + min(k, len(ids) - 1)
    return hits / max(total, 1)
