"""Edits of a bill, applied in order as one fold per bill: no state but the bill itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERSON = "struct<id:string,name:string>"
ITEM = "struct<id:string,desc:string,price:bigint,assignees:array<string>>"
BILL = f"struct<people:array<{PERSON}>,items:array<{ITEM}>,subtotal:bigint,tax:bigint,tip:bigint,total:bigint,tip_percent:double,tip_cents:bigint,next_id:bigint>"
#: What an edit holds: op, the id it is about, a second id or a field's name, text and number.
EDIT = "struct<seq:int,op:string,target:string,other:string,text:string,value:bigint>"
FIELDS = ("subtotal", "tax", "tip", "total")


def empty_bill(people: Column) -> Column:
    """Manual entry: people, no items, unknown totals."""
    null = F.lit(None)
    return F.struct(people.alias("people"), F.array().cast(f"array<{ITEM}>").alias("items"), *(null.cast("bigint").alias(f) for f in FIELDS), null.cast("double").alias("tip_percent"), null.cast("bigint").alias("tip_cents"), F.lit(1).cast("bigint").alias("next_id")).cast(BILL)


def step(b: Column, e: Column) -> Column:
    """One edit. Unknown ids change nothing; removing a person takes them off every item."""
    op, target, other, text, value = (e[k] for k in ("op", "target", "other", "text", "value"))
    item = lambda **new: lambda i: F.struct(*(new.get(k, lambda i, k=k: i[k])(i).alias(k) for k in ("id", "desc", "price", "assignees")))
    on = lambda change: F.transform(b["items"], lambda i: F.when(i["id"] == target, change(i)).otherwise(i))
    toggled = lambda i: F.when(F.array_contains(i["assignees"], other), F.filter(i["assignees"], lambda a: a != other)).otherwise(F.array_append(i["assignees"], other))
    new_item = F.struct(F.concat(F.lit("i"), b["next_id"].cast("string")).alias("id"), F.coalesce(text, F.lit("")).alias("desc"), F.coalesce(value, F.lit(0)).cast("bigint").alias("price"), F.array().cast("array<string>").alias("assignees"))
    without = F.transform(b["items"], item(assignees=lambda i: F.filter(i["assignees"], lambda a: a != target)))
    items = (
        F.when(op == "setItemPrice", on(item(price=lambda i: value)))
        .when(op == "setItemDesc", on(item(desc=lambda i: text)))
        .when(op == "addItem", F.array_append(b["items"], new_item))
        .when(op == "removeItem", F.filter(b["items"], lambda i: i["id"] != target))
        .when(op == "toggleAssignee", on(item(assignees=toggled)))
        .when(op == "removePerson", without)
        .otherwise(b["items"])
    )
    new_person = F.struct(F.concat(F.lit("p"), b["next_id"].cast("string")).alias("id"), text.alias("name"))
    people = (
        F.when(op == "addPerson", F.array_append(b["people"], new_person))
        .when(op == "renamePerson", F.transform(b["people"], lambda p: F.when(p["id"] == target, F.struct(p["id"].alias("id"), text.alias("name"))).otherwise(p)))
        .when(op == "removePerson", F.filter(b["people"], lambda p: p["id"] != target))
        .otherwise(b["people"])
    )
    fields = [F.when((op == "setField") & (other == f), value).otherwise(b[f]).alias(f) for f in FIELDS]
    tip = op == "setAddedTip"
    percent = F.when(tip, F.when(other == "percent", value.cast("double"))).otherwise(b["tip_percent"])
    cents = F.when(tip, F.when(other == "cents", value)).otherwise(b["tip_cents"])
    number = b["next_id"] + F.when(op.isin("addItem", "addPerson"), 1).otherwise(0)
    return F.struct(people.alias("people"), items.alias("items"), *fields, percent.alias("tip_percent"), cents.alias("tip_cents"), number.alias("next_id"))


def apply(bills: DataFrame, edits: DataFrame) -> DataFrame:
    """bill_id and bill after all its edits (bill_id, seq, op, target, other, text, value), by seq."""
    own = edits.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "target", "other", "text", "value").cast(EDIT))).alias("edits"))
    return applied(bills.join(own, "bill_id", "left"))


def applied(bills: DataFrame) -> DataFrame:
    """bill_id and bill after the edits (an array in the order of seq, null for none) that its row holds: no row for an edit, no shuffle."""
    listed = F.coalesce(F.col("edits"), F.array()).cast(f"array<{EDIT}>")
    return bills.select("bill_id", F.aggregate(listed, F.col("bill").cast(BILL), step).alias("bill"))


def bill_of(people: Column, items: Column, totals: dict[str, Column]) -> Column:
    """A reading, word for word, as an editable bill: items get ids in order, repairs aren't applied."""
    made = F.transform(items, lambda i, k: F.struct(F.concat(F.lit("i"), (k + 1).cast("string")).alias("id"), i["desc"].alias("desc"), i["price"].alias("price"), F.array().cast("array<string>").alias("assignees")))
    null = F.lit(None)
    return F.struct(people.alias("people"), made.alias("items"), *(totals[f].alias(f) for f in FIELDS), null.cast("double").alias("tip_percent"), null.cast("bigint").alias("tip_cents"), (F.size(items) + 1).cast("bigint").alias("next_id")).cast(BILL)
