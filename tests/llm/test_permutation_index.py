"""Recall over many blocks, and vectors that take no part."""

import numpy as np
import pandas as pd
import pytest

from tillproof.llm import permutation_index as pi


@pytest.mark.parametrize("block", [4096, 250])
def test_recall_over_many_blocks(spark, block):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    v = pd.read_parquet(path).sort_values("vec_id")
    vectors = spark.read.parquet(path)
    found = pi.nearest(vectors, vectors.where("vec_id % 50 = 0"), block=block).collect()
    own: dict[int, list[int]] = {}
    for r in found:
        own.setdefault(r.query_id, []).append(r.vec_id)
    x, ids = np.array(v.embedding.tolist(), np.float64), v.vec_id.to_numpy()
    assert len(own) == (ids % 50 == 0).sum() and all(len(o) == 5 for o in own.values())
    assert pi.recall(x, ids, own) >= 0.9


def test_odd_vectors(spark):
    nan, one = float("nan"), [1.0, 0.0, 0.0]
    rows = [(0, one), (1, [0.5, 0.5, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [nan, 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (7, [1.0]), (None, one), (8, [2.0, 0.0, 0.0]), (9, [2.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in pi.nearest(vectors, vectors).collect() if r.query_id == 0)
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 1, round(0.5**0.5, 9))]
    assert pi.nearest(vectors.limit(0), vectors).count() == 0 and pi.nearest(vectors, vectors.limit(0)).count() == 0


def test_queries_dealt_to_all_slots_are_not_broadcast(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = pi.nearest(vectors, vectors.where("vec_id % 50 = 0"))
    assert found.count() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
