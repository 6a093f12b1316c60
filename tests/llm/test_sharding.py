"""Shards against a plain minimax partition of all groups, and what op13 has to hold."""

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from tests.llm.test_contracts import docs, folder  # noqa: F401
from tillproof.llm import sharding


def best_capacity(sizes: list[int], n: int) -> int:
    """The smallest largest shard over all contiguous partitions, by dynamic programming."""
    ends = [0, *accumulate(sizes)]
    most = list(ends)
    for _ in range(n - 1):
        most = [min(max(most[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return most[-1]


@given(st.lists(st.integers(1, 30), min_size=1, max_size=14), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_cuts_have_the_smallest_capacity(sizes, n):
    order = sharding.Order([sharding.Block(k, 0, s, True) for k, s in enumerate(sizes)])
    ends = [0, *order.cuts(n), order.total]
    assert ends == sorted(ends) and set(ends) <= set(order.ends)
    assert max(b - a for a, b in zip(ends, ends[1:])) == best_capacity(sizes, n)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 6), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_coarse_blocks_end_at_the_same_cuts(sizes, n, shift):
    fine = [sharding.Block(k, 0, s, True) for k, s in enumerate(sizes)]

    def block(prefix: int, by: int) -> sharding.Block:
        own = sizes[prefix << by : prefix + 1 << by]
        return sharding.Block(prefix, by, sum(own), len(own) == 1)

    blocks = [block(p, shift) for p in range(-(-len(sizes) // (1 << shift)))]
    while True:
        try:
            got = sharding.Order(blocks).cuts(n)
            break
        except sharding.Coarse as coarse:
            assert coarse.blocks
            split = [[block(2 * b.prefix + i, b.shift - 1) for i in (0, 1) if 2 * b.prefix + i << b.shift - 1 < len(sizes)] if k in coarse.blocks else [b] for k, b in enumerate(blocks)]
            blocks = [b for bs in split for b in bs]
    assert got == sharding.Order(fine).cuts(n)


def place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_shards(texts: list[str], n: int) -> dict[str, int]:
    """text -> shard, over all groups at once."""
    sizes: dict[str, int] = {}
    for t in texts:
        sizes[t] = sizes.get(t, 0) + len(t.encode()) + 8
    left, shard = dict(sizes), {}
    while left and n - len(shard) > 1:
        top = min(left, key=lambda t: (-left[t], place(t)))
        if left[top] * (n - len(shard)) <= sum(left.values()):
            break
        shard[top] = len(shard)
        del left[top]
    groups = sorted(left, key=place)
    m, ends = n - len(shard), [0, *accumulate(left[t] for t in groups)]
    total = ends[-1]
    floor, ceil = lambda x: ends[bisect_right(ends, x) - 1], lambda x: ends[min(bisect_left(ends, x), len(ends) - 1)]

    def fits(c: int) -> bool:
        at = 0
        for _ in range(m):
            at = floor(at + c)
        return at == total

    capacity = next(c for c in range(max(left.values(), default=0), total + 1) if fits(c)) if total < 3000 else None
    if capacity is None:
        lo, hi = 0, total
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        capacity = hi
    needed = [total]
    for _ in range(m - 1):
        needed.append(ceil(needed[-1] - capacity) if needed[-1] > capacity else 0)
    at, first = 0, len(shard)
    for k in range(1, m + 1):
        fair = at + (total - at) // (m - k + 1)
        near = floor(fair) if fair - floor(fair) <= ceil(fair) - fair else ceil(fair)
        end = total if k == m else min(max(near if near > at else ceil(at + 1), needed[m - k]), floor(at + capacity))
        for t, e in zip(groups, ends[1:], strict=True):
            if at < e <= end:
                shard[t] = first + k - 1
        at = end
    return shard


def check(got: pd.DataFrame, rows: list[tuple], n: int):
    """rows: (id, text)."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    shard = plain_shards([t or "" for _, t in rows], n)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), shard[t or ""]) for i, t in rows)
    ids = got.doc_id.astype(object).where(got.doc_id.notna(), -1)
    assert sorted(zip(ids, got["size"], got.text_crc32, got.shard, strict=True)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_op13(spark, folder, docs):  # noqa: F811
    got = __spark_entry__.queries()["op13_minimax_shards"](spark, folder).toPandas()
    check(got, list(docs.items()), 24)
    assert set(got.law) <= {"bytes"} and got.grown_shard.isna().all() and got.shard.between(0, 23).all()


def test_even_sizes_at_a_larger_scale(spark):
    got = __spark_entry__.queries()["op13_minimax_shards"](spark, "/root/testdata/sf0.1").toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() / sums.min() < 1.2
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()
    check(got, [(int(r.doc_id), r.text) for r in pd.read_parquet("/root/testdata/sf0.1/documents.parquet").itertuples()], 24)


@pytest.mark.parametrize("n", [1, 5, 24])
def test_copies_ties_and_odd_rows(spark, n):
    rows = [(i, "many copies") for i in range(400)] + [(None, "many copies")] * 5000 + [(7, None), (7, ""), (7, "é"), (None, None), (7, "é")]
    rows += [(i, f"text {i} " * (i % 9)) for i in range(500)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, size int").repartition(7)
    check(sharding.shards(df, n).toPandas(), rows, n)
    assert sharding.shards(df.limit(0), n).isEmpty()
    one = sharding.shards(df.where("doc_id = 3 and text like 'text%'"), n).toPandas()
    assert list(one.shard) == [0] and list(one.slot) == [0]


def test_files_hold_their_shards_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    slots = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, 6).collect()}
    back = sharding.shard_files(docs, str(tmp_path / "out"), 6, file_rows=20)
    assert sorted(back.columns) == sorted([*docs.columns, "shard"]) and back.count() == docs.count()
    for k in range(6):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        ids = [i for f in files for i in pd.read_parquet(f).doc_id]
        assert [slots[i] for i in ids] == [(k, s) for s in range(len(ids))] and len(files) > 1
