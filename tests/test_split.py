"""Refusals, verdicts with their splits, and exact sums over many random bills."""

import random

import pytest
from pyspark.sql import functions as F

from tillproof.operators import split

ITEM = "bill_id int, price long, assignees array<string>"
PRINTED = "bill_id int, people array<string>, n_items long, items_sum long, subtotal long, tax long, tip long, total long, tip_percent double, tip_cents long"
P = ["p0", "p1", "p2"]


def test_refusals_are_rows(spark):
    bills = [(1, [], 100, 0, 0, 100), (2, P, 100, None, 0, 100), (3, P, 90, 0, 0, 90), (4, P, 100, 5, 0, 100), (5, P, 100, 5, 0, 105), (6, None, 100, 0, 0, 100)]
    df = spark.createDataFrame(bills, "bill_id int, people array<string>, subtotal long, tax long, tip long, total long")
    items = spark.createDataFrame([(i, 100, []) for i in range(1, 7)], ITEM)
    got = split.split_bill(df, items).collect()
    error = {r.bill_id: r.split_error for r in got}
    assert error == {1: split.NOBODY, 2: split.UNKNOWN, 3: split.DISPUTED, 4: split.OPEN, 5: None, 6: split.NOBODY}
    assert sum(r.total for r in got if r.bill_id == 5) == 105 and all(r.total is None for r in got if r.bill_id != 5)
    even = split.split_evenly(df.select("bill_id", "people", "total")).collect()
    assert {r.bill_id: r.split_error for r in even} == {1: split.NOBODY, 2: None, 3: None, 4: None, 5: None, 6: split.NOBODY}


def test_verdicts_with_their_splits(spark):
    prices = [1200, 1450, 700, 1100]
    bills = [
        (1, P, 4, 4450, 4450, 367, 890, 5707, None, None),  # closes
        (2, P, 4, 4450, 4450, 367, 890, 5700, 20.0, None),  # does not
        (3, P, 4, 4450, 4450, 367, None, 4817, 20.0, None),  # no tip printed, one added
        (4, P, 0, 0, 1000, 0, 0, 1000, None, None),  # no items
        (5, P, 4, 4450, 4450, None, 890, 5707, None, None),  # a repair to confirm
        (6, [], 4, 4450, 4450, 367, 890, 5707, 20.0, None),  # nobody
        (7, P, 4, 4450, 4450, 367, 890, 5707, None, 1000),
    ]
    items = [(i, p, ["p0"] if p == 1200 and i == 3 else []) for i in (1, 2, 3, 5, 6, 7) for p in prices]
    rows = split.settled_split(spark.createDataFrame(bills, PRINTED), spark.createDataFrame(items, ITEM)).orderBy("bill_id", "person_idx").collect()
    of = {}
    for r in rows:
        of.setdefault(r.bill_id, []).append(r)
    total = {i: [r.total for r in own] for i, own in of.items()}
    assert sum(total[1]) == 5707 and total[2] == total[5] == total[6] == [None] and sum(total[7]) == 6707
    assert sum(total[3]) == 4817 + 890 and sum(r.tip for r in of[3]) == 890 and of[3][0].tip == max(r.tip for r in of[3]) and of[3][0].no_tip_printed
    assert total[4] == [334, 333, 333] and of[4][0].evenly and of[6][0].added_tip == of[2][0].added_tip == 0
    assert [of[i][0].status for i in (1, 2, 5)] == ["reconciled", "unresolved", "repaired"]


@pytest.mark.parametrize("low", [0, -50_000])
def test_twenty_thousand_random_apportionments_sum_exactly(spark, low):
    draw = random.Random(low)
    rows = [(g, i, amount, draw.randrange(5000)) for g in range(20_000) for amount in [draw.randrange(low, 50_000)] for i in range(draw.randrange(1, 10))]
    df = spark.createDataFrame(rows, "g int, i int, amount long, w long")
    wrong = split.apportion(df, ["g"], "i", "amount", "w", "share").groupBy("g").agg((F.sum("share") != F.first("amount")).alias("bad")).where("bad or bad is null")
    assert wrong.isEmpty()


def test_five_thousand_random_bills_sum_to_their_totals(spark):
    draw = random.Random(9)
    bills, items = [], []
    for b in range(5000):
        crowd = [f"p{k}" for k in range(draw.randrange(1, 7))]
        own = [(b, draw.randrange(1, 9000), [p for p in crowd if draw.random() < 0.5]) for _ in range(draw.randrange(1, 13))]
        s = sum(x[1] for x in own)
        tax, tip = draw.randrange(max(1, s // 10)), draw.randrange(max(1, s // 4))
        bills.append((b, crowd, s, tax, tip, s + tax + tip))
        items += own
    df = spark.createDataFrame(bills, "bill_id int, people array<string>, subtotal long, tax long, tip long, total long")
    got = split.split_bill(df, spark.createDataFrame(items, ITEM))
    assert got.where("split_error is not null").isEmpty()
    sums = got.groupBy("bill_id").agg(F.sum("total").alias("shared")).join(df, "bill_id")
    assert sums.count() == 5000 and sums.where("shared <> total").isEmpty()
