"""Runs of words against a plain search, and op11 against its contract worked out word by word."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from tests.llm.test_contracts import docs, folder  # noqa: F401
from tillproof.llm import runs


def plain_runs(w: list, shortest: int) -> list[tuple[int, int, int]]:
    """Every stretch with period p, for each p, if no smaller period has it whole."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            b = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - b + p
            x = w[b : b + n]
            if n >= max(shortest, 2 * p) and not any(x[q:] == x[:-q] for q in range(1, p)):
                out.append((b, n, p))
            i += i == b
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(docs: list[list[bytes]], shortest: int) -> list[list[tuple[int, int, int]]]:
    codes, starts = runs.codes_of(docs)
    s, n, p = runs.find(codes, max(map(len, docs)) + 1, shortest)
    of = np.searchsorted(starts, s, "right") - 1
    return [[(int(a - starts[d]), int(b), int(c)) for a, b, c, o in zip(s, n, p, of, strict=True) if o == d] for d in range(len(docs))]


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
@settings(max_examples=300, deadline=None)
def test_runs_equal_a_plain_search(docs, shortest):  # noqa: F811
    assert found(docs, shortest) == [plain_runs(d, shortest) for d in docs]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(2, 9), st.integers(0, 8), st.lists(st.integers(0, 3), max_size=9))
@settings(max_examples=200, deadline=None)
def test_planted_periods(root, times, more, rest):
    doc = [b"%d" % x for x in [*rest, *(root * (times + 1))[: len(root) * times + more % len(root)], *rest]]
    assert found([doc, doc[::-1]], 4) == [plain_runs(doc, 4), plain_runs(doc[::-1], 4)]


def test_long_chains_of_equal_words():
    for w in ([b"a"] * 30_000, [b"b", *[b"a"] * 30_000], [*[b"a", b"b"] * 9_000, b"a"]):
        assert len(found([w], 12)[0]) == 1
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 600:
        fib = fib[1], fib[1] + fib[0]
    assert found([fib[1]], 12)[0] == plain_runs(fib[1], 12)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=300))
@settings(max_examples=200, deadline=None)
def test_next_smaller(x):
    x = np.argsort(np.lexsort((-np.arange(len(x)), x)))
    want = [next((j for j in range(i + 1, len(x)) if x[j] < x[i]), len(x)) for i in range(len(x))]
    assert list(runs.next_smaller(x, len(x))) == want


def test_op11(spark, folder, docs):  # noqa: F811
    got = __spark_entry__.queries()["op11_word_runs"](spark, folder).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs)
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > (3000 if h % 10 == 0 else 600):
            continue
        own, r = plain_runs(w, 12), got.loc[i]
        assert r.n_runs == len(own)
        best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=None)
        if best is None:
            assert r[["start", "length", "period", "exponent_milli"]].isna().all()
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        gone = {k for s, m, p in own for k in range(s + p, s + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in own))
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_rows_of_any_kind(spark):
    twelve = "x y " * 6
    rows = [(None, twelve, 1), (None, twelve, 2), (7, None, 3), (7, "", 4), (8, " \t ", 5), (9, "é " * 12, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "start")
    got = runs.periodic_runs(df, keep=("start",)).toPandas().sort_values("start")
    assert list(got.n_words) == [12, 12, 0, 0, 0, 12] and list(got.collapsed) == ["x y", "x y", "", "", "", "é"]
    assert [len(r) for r in got.runs] == [1, 1, 0, 0, 0, 1] and pd.isna(got.doc_id.iloc[0])
    assert runs.digests(runs.periodic_runs(df)).count() == 6 and runs.periodic_runs(df.limit(0)).isEmpty()
