"""Reconciliation, division, money, parsing, sessions and SQL of the receipt engine."""

import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tillproof.functions import money
from tillproof.operators import split
from tillproof.operators.reconcile import FIELDS, reconcile

BILL = "id int, n_items long, items_sum long, subtotal long, tax long, tip long, total long"
CASES = [
    ((4, 4450, 4450, 367, 890, 5707), "reconciled", (4450, 367, 890, 5707)),
    ((4, 1775, 1775, 19169, 266, 2210), "repaired", (1775, 169, 266, 2210)),
    ((5, 2200, 2200, 154, None, 2354), "repaired", (2200, 154, 0, 2354)),
    ((1, 800, None, 76, 120, 996), "repaired", (800, 76, 120, 996)),
    ((0, 0, 4450, 367, None, 5707), "repaired", (4450, 367, 890, 5707)),
    ((0, 0, 1000, 100, 100, 1300), "unresolved", None),
    ((0, 0, 1000, 5000, 9000, 1300), "unresolved", None),
    ((1, 425, 1775, 5000, 9000, 1300), "unresolved", None),
    ((0, 0, 5000, 400, 0, 1000), "repaired", (5000, 400, 0, 5400)),
    ((1, 1000, 1000, 900, 0, 2000), "unresolved", None),
    ((1, 1000, 1000, 8250, 200, 1280), "repaired", (1000, 80, 200, 1280)),
    ((0, 0, None, None, None, None), "unresolved", None),
]


def test_reconcile_cases(spark):
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], BILL)
    got = {r.id: r for r in reconcile(rows).collect()}
    for i, (_, status, values) in enumerate(CASES):
        assert got[i].status == status, CASES[i]
        if values:
            assert tuple(got[i][f"v_{f}"] for f in FIELDS) == values


def test_filter_on_a_verdict_plans_quickly_and_agrees(spark):
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], BILL)
    assert reconcile(rows).where("status <> 'unresolved'").count() == sum(c[1] != "unresolved" for c in CASES)


@pytest.mark.parametrize("amount,weights,shares", [(700, [1, 1, 1], [234, 233, 233]), (1000, [3, 1], [750, 250]), (100, [0, 0, 0], [34, 33, 33]), (5707, [1, 1, 1], [1903, 1902, 1902])])
def test_apportion(spark, amount, weights, shares):
    rows = spark.createDataFrame([(1, i, amount, w) for i, w in enumerate(weights)], "g int, i int, amount long, w long")
    got = split.apportion(rows, ["g"], "i", "amount", "w", "share").orderBy("i").collect()
    assert [r.share for r in got] == shares


def test_negative_amounts_sum_up(spark):
    rows = spark.createDataFrame([(1, i, -700, 1) for i in range(3)], "g int, i int, amount long, w long")
    assert split.apportion(rows, ["g"], "i", "amount", "w", "s").groupBy().sum("s").first()[0] == -700


def test_parse_cents(spark):
    texts = {"12.34": 1234, "$12.34": 1234, "12,34": 1234, "1,234.56": 123456, "$12,345.00": 1234500, "19.169": None, "2300": None, "12,34.56": None, "1,23.45": None, "1,234,56": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", money.parse_cents("t").alias("c"))
    assert {r.t: r.c for r in df.collect()} == texts | {None: None}


def test_shares_sum_to_the_total(spark, sf):
    row = __spark_entry__.queries()["q02_split_sum_check"](spark, sf).first()
    assert row.mismatches == 0 and row.bills > 0


def test_parse_gives_back_what_was_printed(spark, sf):
    from tillproof.sources import adapters

    got = __spark_entry__.queries()["q18_parse_roundtrip"](spark, sf).select("receipt_id", *FIELDS, "n_items", "items_sum")
    want = adapters.bills(spark, sf).select("receipt_id", *FIELDS, "n_items", "items_sum")
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()


def test_stream_equals_batch(spark, sf):
    q = __spark_entry__.queries()
    stream = q["q36_stream_session"](spark, sf)
    batch = q["q26_session_accept"](spark, sf).select(stream.columns)
    assert stream.count() == batch.count() and stream.exceptAll(batch).isEmpty()


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("q")])
def test_sql_agrees(spark, sf, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "events", "documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else str(v) if isinstance(v, str) else round(float(v), 9)
    rows = lambda d: sorted(map(repr, (tuple(plain(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))))
    assert rows(got) == rows(want)


def test_stream_rules_equal_reconcile_on_misread_bills(spark, sf):
    from tillproof.plans import queries
    from tillproof.streaming import session

    rows = reconcile(queries.misreads(spark, sf)).collect()
    assert len({r.m for r in rows}) == 16
    for r in rows:
        status, values = session.judge(r.n_items, r.items_sum, {f: r[f] for f in FIELDS})
        assert (status, [values[f] for f in FIELDS]) == (r.status, [r[f"v_{f}"] for f in FIELDS]), r


def test_blocks_of_totals_and_dishes_named_like_labels(spark):
    from tillproof.operators import receipt

    lines = [("TIP TOP BURGER", 1250), ("MEATBALL SUB", 900), ("TAXI DRIVER STEAK", 2000), ("SUBTOTAL", 4150), ("TAX 8%", 332), ("TIP", 500), ("TOTAL", 4982), ("VISA 1234", 4982)]
    rows = [(1, k * 100 + i, t, 20.0 + 90 * i, 40.0 * k, 100.0 + 90 * i, 40.0 * k + 20) for k, (label, _) in enumerate(lines) for i, t in enumerate(label.split())]
    rows += [(1, k * 100 + 99, f"{p // 100}.{p % 100:02d}", 520.0, 40.0 * k, 600.0, 40.0 * k + 20) for k, (_, p) in enumerate(lines)]
    words = spark.createDataFrame(rows, "receipt_id int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    got = receipt.parse(words).first()
    assert [(i.desc, i.price) for i in got["items"]] == [("MEATBALL SUB", 900), ("TAXI DRIVER STEAK", 2000)]
    assert (got.subtotal, got.tax, got.tip, got.total) == (4150, 332, 1250, 4982) and got.unreadable == ""


def test_placeholder_names_of_many_people(spark):
    """Time in proportion to the names; spacing, case, leading zeros, other numbers and null names."""
    many = ["Friend", *(f" FRIEND {k}" for k in range(2, 200_000))]
    cases = {"many": (many, "Friend 200000"), "gap": (["friend", "Friend 3"], "Friend 2"), "zeros": (["Friend", "Friend 02", "Friend 1", "Friend 2x"], "Friend 2"), "null": ([None, "Friend"], "Friend 2"), "none": ([], "Friend")}
    df = spark.createDataFrame([(k, names) for k, (names, _) in cases.items()], "k string, names array<string>")
    start = time.perf_counter()
    assert {r.k: r.name for r in df.select("k", money.placeholder_name(F.col("names")).alias("name")).collect()} == {k: want for k, (_, want) in cases.items()}
    assert time.perf_counter() - start < 60
