"""Dividing amounts among people to the last cent, by largest remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import added_tip
from .reconcile import no_tip_printed, reconcile


def apportion(df: DataFrame, group: list[str], idx: str, amount: str, weight: str, out: str) -> DataFrame:
    """Adds out: amount divided by weight within the group, exactly.

    Shares are floors of amount * weight / sum in doubles, in that order of operations; the cents
    left go to the largest fractions, then the lower index. Without any weight all count alike.
    A negative weight gives null.
    """
    g = Window.partitionBy(*group)
    one = df.withColumns({"_sum": F.sum(weight).over(g), "_n": F.count("*").over(g), "_low": F.min(weight).over(g)})
    exact = F.when(F.col("_sum") == 0, F.col(amount).cast("double") / F.col("_n")).otherwise(F.col(amount).cast("double") * F.col(weight) / F.nullif(F.col("_sum"), F.lit(0)))
    two = one.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("bigint"))
    two = two.withColumn("_frac", F.col("_exact") - F.col("_floor"))
    three = two.withColumns({"_left": (F.col(amount) - F.sum("_floor").over(g)).cast("bigint"), "_rank": F.row_number().over(g.orderBy(F.desc("_frac"), idx))})
    step = F.when(F.col("_rank") <= F.col("_left"), 1).when(F.col("_rank") > F.col("_n") + F.col("_left"), -1).otherwise(0)
    share = F.when(F.col("_low") >= 0, (F.col("_floor") + step).cast("bigint"))
    return three.withColumn(out, share).drop("_sum", "_n", "_low", "_exact", "_floor", "_frac", "_left", "_rank")


def equal_share(amount: Column, n: Column, position: Column) -> Column:
    """apportion() with equal weights: the first positions get the cents left over."""
    low = F.floor(amount.cast("double") / F.nullif(n, F.lit(0))).cast("bigint")
    return low + F.when(position < amount - low * n, 1).otherwise(0)


def sharers(assignees: Column, people: Column) -> Column:
    """Those named who sit at the table, in the order of naming; nobody means everybody."""
    named = F.filter(assignees, lambda a: F.array_contains(people, a))
    return F.when(F.size(named) > 0, named).otherwise(people)


def item_shares(items: DataFrame) -> DataFrame:
    """bill_id, person_id, cents: each item (bill_id, price, assignees, people) divided equally among its sharers."""
    who = items.withColumn("_who", sharers(F.col("assignees"), F.col("people")))
    each = who.select("bill_id", "price", F.size("_who").alias("n"), F.posexplode("_who").alias("pos", "person_id"))
    return each.select("bill_id", "person_id", equal_share(F.col("price"), F.col("n"), F.col("pos")).alias("cents"))


#: Why a bill isn't divided.
NOBODY, UNKNOWN, DISPUTED, OPEN, LOST = "nobody to split between", "a total is unknown", "items differ from the subtotal", "the bill does not balance", "the shares do not add up to the total"


def split_bill(bills: DataFrame, items: DataFrame, seats: DataFrame | None = None) -> DataFrame:
    """A row per person: items, tax, tip and total, or split_error and nulls; a bill without people has one row.

    bills: bill_id, people (ids in order), subtotal, tax, tip, total. items: bill_id, price,
    assignees. Everything stays partitioned by bill_id. seats: bill_id and people of these bills or more, where that is
    cheaper to have than the bills.
    """
    priced = items.join((seats if seats is not None else bills).select("bill_id", "people"), "bill_id")
    eaten = item_shares(priced).groupBy("bill_id", "person_id").agg(F.sum("cents").alias("items"))
    sums = items.groupBy("bill_id").agg(F.sum("price").alias("_items"))
    checked = bills.join(sums, "bill_id", "left").withColumn("_items", F.coalesce("_items", F.lit(0)))
    unknown = F.col("subtotal").isNull() | F.col("tax").isNull() | F.col("tip").isNull() | F.col("total").isNull()
    error = F.when(F.coalesce(F.size("people"), F.lit(0)) <= 0, NOBODY).when(unknown, UNKNOWN).when(F.col("_items") != F.col("subtotal"), DISPUTED).when(F.col("subtotal") + F.col("tax") + F.col("tip") != F.col("total"), OPEN)
    people = checked.withColumn("split_error", error).select("bill_id", "tax", "tip", F.col("total").alias("_total"), "split_error", F.posexplode_outer("people").alias("person_idx", "person_id"))
    rows = people.withColumnsRenamed({"tax": "_tax", "tip": "_tip"}).join(eaten, ["bill_id", "person_id"], "left")
    rows = rows.withColumn("items", F.when(F.col("person_id").isNotNull(), F.coalesce("items", F.lit(0).cast("bigint"))))
    rows = apportion(rows, ["bill_id"], "person_idx", "_tax", "items", "tax")
    rows = apportion(rows, ["bill_id"], "person_idx", "_tip", "items", "tip")
    rows = rows.withColumn("total", F.col("items") + F.col("tax") + F.col("tip"))
    whole = F.sum("total").over(Window.partitionBy("bill_id")) == F.col("_total")
    rows = rows.withColumn("split_error", F.coalesce("split_error", F.when(~F.coalesce(whole, F.lit(False)), LOST)))
    ok = F.col("split_error").isNull()
    return rows.select("bill_id", "person_idx", "person_id", *(F.when(ok, F.col(c)).alias(c) for c in ("items", "tax", "tip", "total")), "split_error")


def split_evenly(bills: DataFrame) -> DataFrame:
    """A row per person of bill_id, people, total: the total in equal parts, the first ones a cent more; else split_error and nulls."""
    error = F.when(F.coalesce(F.size("people"), F.lit(0)) <= 0, NOBODY).when(F.col("total").isNull(), UNKNOWN)
    each = bills.select("bill_id", "total", F.size("people").alias("n"), error.alias("split_error"), F.posexplode_outer("people").alias("person_idx", "person_id"))
    share = equal_share(F.col("total"), F.col("n"), F.col("person_idx"))
    zero = F.when(F.col("split_error").isNull(), F.lit(0).cast("bigint"))
    return each.select("bill_id", "person_idx", "person_id", share.alias("items"), zero.alias("tax"), zero.alias("tip"), share.alias("total"), "split_error")


def settled_split(bills: DataFrame, items: DataFrame) -> DataFrame:
    """The verdict on each bill with its split: a row per person while the printed numbers close, else one row of nulls.

    bills: bill_id, people, n_items, items_sum, the totals as printed, tip_percent, tip_cents. An added tip is shared like
    the printed one; a bill without items is divided evenly.
    """
    judged = verdict(bills).select("bill_id", "people", "status", "no_tip_printed", "settles", "evenly", "added_tip", F.col("v_subtotal").alias("subtotal"), F.col("v_tax").alias("tax"), F.col("pay_tip").alias("tip"), F.col("pay_total").alias("total"))
    whole, alone = judged.where("settles and not evenly"), judged.where("settles and evenly")
    shares = split_bill(whole, items, bills).unionByName(split_evenly(alone.select("bill_id", "people", "total"))).where("split_error is null").drop("split_error")
    out = judged.select("bill_id", "status", "no_tip_printed", "evenly", "added_tip").join(shares, "bill_id", "left")
    divided = F.col("person_id").isNotNull()
    return out.withColumns({"evenly": F.col("evenly") & divided, "added_tip": F.when(divided, F.col("added_tip")).otherwise(0)})


def verdict(bills: DataFrame) -> DataFrame:
    """Reconciles (n_items, items_sum, totals, tip_percent, tip_cents) and says how the bill may be split.

    Adds the reconciliation's columns, no_tip_printed, settles, evenly, added_tip, pay_tip and pay_total.
    """
    judged = reconcile(bills)
    out = judged.withColumn("no_tip_printed", no_tip_printed(F.col("tip")))
    out = out.withColumn("settles", (F.col("status") == "reconciled") | F.col("no_tip_printed"))
    extra = added_tip(F.col("tip_cents"), F.col("tip_percent"), F.col("v_subtotal"))
    out = out.withColumn("added_tip", F.when(F.col("settles"), extra).otherwise(0).cast("bigint"))
    return out.withColumns(
        {
            "evenly": F.col("settles") & (F.col("n_items") == 0),
            "pay_tip": F.when(F.col("settles"), F.col("v_tip") + F.col("added_tip")),
            "pay_total": F.when(F.col("settles"), F.col("v_total") + F.col("added_tip")),
        }
    )
