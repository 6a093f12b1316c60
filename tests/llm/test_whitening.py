"""Whitened vectors against a plain eigendecomposition, exact sums included."""

import math

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from tillproof.llm import whitening


def plain(rows: list, k: int = 32):
    """ids, whole numbers, eigenvalues and whitened values, with Python's integers for what is exact."""
    fine = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in fine]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    far = [[n * r[j] - s[j] for j in range(d)] for r in x]
    c = np.array(far, np.float64) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [i for i, _ in fine], [sum(f * f for f in r) for r in far], c @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


def compare(got: pd.DataFrame, rows: list, k: int = 32):
    ids, deviation, z, explained = plain(rows, k)
    m = z.shape[1]
    assert len(got) == len(ids) * m and (got.n == len(ids)).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    got = got.sort_values(["vec_id", "component"])
    order = np.argsort(ids, kind="stable")
    w = got.whitened.to_numpy().reshape(len(ids), m)
    assert (got.component.to_numpy().reshape(len(ids), m) == np.arange(1, m + 1)).all()
    assert (got.deviation.to_numpy().reshape(len(ids), m) == np.array(deviation)[order][:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(len(ids), m), explained, rtol=1e-9)
    want = z[order]
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-7)


def test_op12(spark, sf):
    rows = [(int(r.vec_id), r.embedding) for r in pd.read_parquet(f"{sf}/embeddings.parquet").itertuples()]
    compare(__spark_entry__.queries()["op12_subspace_whitening"](spark, sf).toPandas(), rows)


@pytest.mark.parametrize("d,k,how", [(120, 5, {"extra": 2, "widest": 3}), (40, 6, {"extra": 0, "widest": 1, "passes": 900}), (3, 32, {})])
def test_blocks_smaller_than_the_space(spark, d, k, how):
    """The block starts again and again before it certifies all components, or is never widened at all."""
    rng = np.random.default_rng(d)
    x = rng.standard_normal((300, d)) * np.linspace(4, 1, d)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    compare(whitening.whitened(df, k=k, **how).toPandas(), rows, min(k, d))


def test_rows_of_any_kind(spark):
    rng = np.random.default_rng(5)
    good = [(i % 30, rng.standard_normal(4).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, component string, x int")
    got = whitening.whitened(df).toPandas()
    assert len(got) == 240 and set(got.vec_id) == set(range(30)) and got.n.eq(60).all()
    ids, deviation, _, _ = plain(good)
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert whitening.whitened(df.limit(0)).isEmpty() and whitening.whitened(df.where("vec_id = 100")).isEmpty()
    flat = spark.createDataFrame([(i, [2.5, -1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whitened(flat).isEmpty()
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(9)] + [(None, [0.0, 0.0, 0.5])], "vec_id long, embedding array<double>")
    only = whitening.whitened(line).toPandas()
    assert set(only.component) == {1} and len(only) == 10 and only.explained.iloc[0] == pytest.approx(1) and only.vec_id.isna().sum() == 1


def test_sizes_beyond_a_long(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i), 7e11 * i]) for i in range(9)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got.deviation.isna().all() and got.identity_error.iloc[0] < 1e-6
