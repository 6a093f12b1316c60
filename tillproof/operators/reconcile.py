"""Do the printed totals close, and if not, is exactly one correction possible?

A chain of columns over n_items, items_sum, subtotal, tax, tip and total: no join, no shuffle, no
Python. Nothing is guessed: where more than one correction would do, or the items dispute the
subtotal, the bill stays unresolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_text

FIELDS = ("subtotal", "tax", "tip", "total")
MAX_TAX, MAX_TIP = 0.3, 1.0
#: Sentences of repairs and problems, between their amounts; fixed values.
SUMMED = ("no printed subtotal; summed ", " line items")
NO_TIP = "no tip on the printed bill"
REQUIRED = "not read from the receipt; the other three totals require "
CORRECTED = ("the receipt did not add up; ", " was the only field whose correction balances it (", " → ", ")")
NO_WAY = "The printed totals do not add up and no single correction fixes them — more than one number is likely misread."
MANY_WAYS = ("The printed totals do not add up, and ", " different corrections would each fix them (", "). Cannot choose safely.")
MISSING = ("Missing ", ", and too little is known to work out the rest.")
DISPUTED = ("The line items add to ", " but the receipt says the subtotal is ", " — some items were missed or misread.")


def known(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in cs))


def false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def plausible(v: dict[str, Column]) -> Column:
    """Positive subtotal, total not below it, tax and tip within their rates; unknown tax and tip pass."""
    s, x, p, t = (v[f] for f in FIELDS)
    within = lambda c, rate: c.isNull() | ((c >= 0) & (c.cast("double") <= s.cast("double") * F.lit(rate)))
    return false((s > 0) & (t > 0) & (t >= s) & within(x, MAX_TAX) & within(p, MAX_TIP))


def solved(field: str, v: dict[str, Column]) -> Column:
    s, x, p, t = (v[f] for f in FIELDS)
    return {"subtotal": t - x - p, "tax": t - s - p, "tip": t - s - x, "total": s + x + p}[field]


def apart(any_column: Column) -> Column:
    """Keeps a projection out of its stage's one method, which grows beyond what the JVM compiles; on its own it is generated in small ones.

    A function over an array has no place in a stage's method. What it gives has to be used, or it is pruned.
    """
    return F.transform(F.array(any_column), lambda x: x)


def those(kind: str, *entries: tuple[Column, Column]) -> Column:
    """The values whose conditions hold, as an array; unlike a filter of an array it stays in generated code."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*(F.when(when, F.array(value).cast(f"array<{kind}>")).otherwise(none) for when, value in entries))


def reconcile(df: DataFrame, prefix: str = "", out: str = "", told: bool = True) -> DataFrame:
    """Adds status, v_<field>, repairs, problems and corroborated, each name begun by out.

    prefix begins the names of the input columns; told=False leaves out repairs and problems with their sentences.
    """
    c = lambda name: F.col(f"_r_{name}")
    one = df.withColumns({f"_r_{k}": F.col(f"{prefix}{k}").cast("bigint") for k in ("n_items", "items_sum", *FIELDS)})
    n, total_of_items = c("n_items"), c("items_sum")
    filled = F.when(c("subtotal").isNull() & (n > 0), total_of_items).otherwise(c("subtotal"))
    two = one.withColumns({"_r_sub": filled, "_r_derived": c("subtotal").isNull() & (n > 0)})
    three = two.withColumns({"_r_disputed": false((n > 0) & (total_of_items != c("sub"))), "_r_backed": false((n > 0) & (total_of_items == c("sub")))})
    no_tip = c("tip").isNull() & false(c("sub") + c("tax") == c("total")) & ~c("disputed")
    four = three.withColumns({"_r_notip": no_tip, "_r_tip1": F.when(no_tip, F.lit(0).cast("bigint")).otherwise(c("tip"))})
    v = {"subtotal": c("sub"), "tax": c("tax"), "tip": c("tip1"), "total": c("total")}
    gaps = sum((v[f].isNull().cast("int") for f in FIELDS), F.lit(0))
    five = four.withColumns({"_r_gaps": gaps, "_r_hole": F.coalesce(*(F.when(v[f].isNull(), F.lit(f)) for f in FIELDS))})
    hole = F.when((c("gaps") == 1) & ~c("disputed"), F.coalesce(*(F.when(c("hole") == f, solved(f, v)) for f in FIELDS)))
    six = five.withColumn("_r_answer", hole)
    trial = {f: F.when(c("hole") == f, c("answer")).otherwise(v[f]) for f in FIELDS}
    seven = six.withColumns({"_r_fit": c("answer").isNotNull() & plausible(trial), "_r_apart1": apart(c("gaps"))})
    seven = seven.withColumns({f"_r_w_{f}": F.when(c("fit") & (c("hole") == f), c("answer")).otherwise(v[f]) for f in FIELDS})
    w = {f: c(f"w_{f}") for f in FIELDS}
    eight = seven.withColumn("_r_closes", known(*w.values()) & false(w["subtotal"] + w["tax"] + w["tip"] == w["total"]) & ~c("disputed"))
    open_ = known(*w.values()) & ~c("disputed") & ~c("closes")
    nine = eight.withColumns({f"_r_d_{f}": solved(f, w) for f in FIELDS} | {"_r_open": open_})
    may = {}
    for f in FIELDS:
        changed = {g: c(f"d_{f}") if g == f else w[g] for g in FIELDS}
        may[f] = c("open") & (c(f"d_{f}") != w[f]) & plausible(changed) & (~c("backed") if f == "subtotal" else F.lit(True))
    ten = nine.withColumns({f"_r_c_{f}": may[f] for f in FIELDS} | {"_r_apart2": apart(c("gaps"))})
    ten = ten.withColumn("_r_ways", sum((c(f"c_{f}").cast("int") for f in FIELDS), F.lit(0)))
    only = lambda value: F.when(c("ways") == 1, F.coalesce(*(F.when(c(f"c_{f}"), value(f)) for f in FIELDS)))
    eleven = ten.withColumns({"_r_which": only(F.lit), "_r_old": only(lambda f: w[f]), "_r_new": only(lambda f: c(f"d_{f}"))})

    def repair(when: Column, field: Column, old: Column, new: Column, reason: Column) -> tuple[Column, Column]:
        return when, F.struct(field.alias("field"), old.cast("bigint").alias("from"), new.cast("bigint").alias("to"), reason.alias("reason"))

    none = F.lit(None)
    repairs = [
        repair(c("derived"), F.lit("subtotal"), none, total_of_items, F.concat(F.lit(SUMMED[0]), n.cast("string"), F.lit(SUMMED[1]))),
        repair(c("notip"), F.lit("tip"), none, F.lit(0), F.lit(NO_TIP)),
        repair(c("fit"), c("hole"), none, c("answer"), F.concat(F.lit(REQUIRED), money_text(c("answer")))),
        repair(c("ways") == 1, c("which"), c("old"), c("new"), F.concat(F.lit(CORRECTED[0]), c("which"), F.lit(CORRECTED[1]), money_text(c("old")), F.lit(CORRECTED[2]), money_text(c("new")), F.lit(CORRECTED[3]))),
    ]
    lost = F.array_join(F.array(*(F.when(w[f].isNull(), F.lit(f)) for f in FIELDS)), ", ")
    ways = F.array_join(F.array(*(F.when(c(f"c_{f}"), F.lit(f)) for f in FIELDS)), ", ")
    problems = [
        (c("open") & (c("ways") == 0), F.lit(NO_WAY)),
        (c("open") & (c("ways") > 1), F.concat(F.lit(MANY_WAYS[0]), c("ways").cast("string"), F.lit(MANY_WAYS[1]), ways, F.lit(MANY_WAYS[2]))),
        (~known(*w.values()) & ~c("disputed"), F.concat(F.lit(MISSING[0]), lost, F.lit(MISSING[1]))),
        (c("disputed"), F.concat(F.lit(DISPUTED[0]), money_text(total_of_items), F.lit(DISPUTED[1]), money_text(w["subtotal"]), F.lit(DISPUTED[2]))),
    ]
    whole = ~(c("derived") | c("notip") | c("fit"))
    done = eleven.withColumns(
        {f"{out}v_{f}": F.when(c("which") == f, c("new")).otherwise(w[f]) for f in FIELDS}
        | {
            f"{out}repairs": those("struct<field:string,from:bigint,to:bigint,reason:string>", *repairs),
            f"{out}problems": those("string", *problems),
            f"{out}status": F.when(c("closes") & whole, "reconciled").when(c("closes") | (c("ways") == 1), "repaired").otherwise("unresolved"),
            f"{out}corroborated": c("backed"),
            "_r_apart": F.array(c("apart1"), c("apart2"), apart(c("ways"))),
        }
    )
    texts = ("repairs", "problems") if told else ()
    made = [f"{out}{k}" for k in (*(f"v_{f}" for f in FIELDS), "status", "corroborated", *texts)]
    # A generator of one row: a filter on a verdict stays above it, as below it the whole chain would be written out in the filter.
    return done.select(*(k for k in df.columns if k not in made), F.inline_outer(F.array(F.struct(*made, "_r_apart")))).drop("_r_apart")


def apply_repairs(df: DataFrame) -> DataFrame:
    """Writes each repair's value into its field."""
    def value(f: str) -> Column:
        own = F.filter("repairs", lambda r: r["field"] == f)
        return F.when(F.size(own) > 0, F.element_at(own, -1)["to"]).otherwise(F.col(f))

    return df.withColumns({f: value(f) for f in FIELDS})


def no_tip_printed(tip: Column) -> Column:
    first = F.get(F.col("repairs"), F.lit(0))
    return false((F.col("status") == "repaired") & tip.isNull() & (F.size("repairs") == 1) & (first["field"] == "tip") & (first["to"] == 0))
