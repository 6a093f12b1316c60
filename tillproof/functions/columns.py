"""Columns that are worked out once, whatever reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns worked out once: a generator of one row keeps them from being written into later lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def shared_count(a: str, b: str) -> Column:
    """How many members two arrays of whole numbers have in common, each as often as both hold it; nulls don't count.

    Both are walked as one list in order, members of a before equal ones of b, each of which takes one of those left.
    """
    tagged = lambda c, of: F.transform(F.array_compact(c), lambda x: F.struct(x.cast("bigint").alias("x"), F.lit(of).alias("of")))
    start = F.struct(F.lit(None).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("hits"))

    def step(s: Column, e: Column) -> Column:
        left = F.when(s["x"] == e["x"], s["left"]).otherwise(F.lit(0))
        taken = ((e["of"] == 1) & (left > 0)).cast("bigint")
        return F.struct(e["x"].alias("x"), F.when(e["of"] == 0, left + 1).otherwise(left - taken).cast("bigint").alias("left"), (s["hits"] + taken).alias("hits"))

    return F.aggregate(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), start, step, lambda s: s["hits"])
