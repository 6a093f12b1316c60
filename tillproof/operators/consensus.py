"""Readings of one receipt, frame by frame: what agrees long enough is confirmed.

Batch form: every streak is a running number less the last one at which the value changed, so all of them, the latch and
the repeats share one exchange and one sort by session_id and frame_no. streaming.session holds the same rules as keyed
state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import FIELDS, false, reconcile

DENSE, UNSTEADY, REPEATS = 25, 6, 2


def by(session: str = "session_id", frame: str = "frame_no") -> Window:
    return Window.partitionBy(session).orderBy(frame)


def so_far(session: str = "session_id", frame: str = "frame_no") -> Window:
    return by(session, frame).rowsBetween(Window.unboundedPreceding, 0)


def streaks(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """For each column (by the name it gets) how many frames in a row have held its value; 0 where it wasn't read.

    Adds _n, the number of the frame in its session.
    """
    before = df.withColumns({"_n": F.row_number().over(by())} | {f"_was_{out}": F.lag(value).over(by()) for out, value in values.items()})
    new = {out: F.col(value).isNull() | ~F.col(value).eqNullSafe(F.col(f"_was_{out}")) for out, value in values.items()}
    since = before.withColumns({f"_since_{out}": F.max(F.when(n, F.col("_n"))).over(so_far()) for out, n in new.items()})
    runs = {out: F.when(F.col(value).isNull(), 0).otherwise(F.col("_n") - F.col(f"_since_{out}") + 1) for out, value in values.items()}
    return since.withColumns(runs).drop(*(f"_{k}_{out}" for out in values for k in ("was", "since")))


def streak(df: DataFrame, value: str, out: str) -> DataFrame:
    """How many frames in a row have held this value; 0 where it wasn't read."""
    return streaks(df, {out: value}).drop("_n")


def run_length(df: DataFrame, holds: Column, out: str) -> DataFrame:
    """How many frames in a row the condition has held, up to this one."""
    one = df.withColumns({"_h": false(holds), "_k": F.row_number().over(by())})
    last = F.max(F.when(~F.col("_h"), F.col("_k"))).over(so_far())
    return one.withColumn(out, F.when(F.col("_h"), F.col("_k") - F.coalesce(last, F.lit(0))).otherwise(0)).drop("_h", "_k")


def observe(frames: DataFrame, confirmations: int | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """Streaks, the confirmations needed, what is confirmed, and whether the hand is unsteady.

    frames: session_id, frame_no, the four totals, n_items, items_sum, items_key. A crowded page
    (25 money tokens in any frame so far) needs a third confirmation, from then on, for all fields.
    also: further streaks, as streaks() takes them.
    """
    df = frames.withColumn("_key", F.when(F.col("n_items") > 0, F.col("items_key")))
    df = streaks(df, {f"streak_{f}": f for f in FIELDS} | {"streak_items": "_key"} | (also or {}))
    tokens = F.col("n_items") + sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    dense = F.max((tokens >= DENSE).cast("int")).over(so_far())
    needed = F.lit(confirmations) if confirmations else F.when(dense == 1, 3).otherwise(2)
    most = F.greatest(*(F.col(f"streak_{f}") for f in (*FIELDS, "items")))
    df = df.withColumns({"needed": needed, "saw": most >= 1, "agreed": most >= 2}).withColumnRenamed("_n", "frames_seen")
    df = run_length(df, F.col("saw") & ~F.col("agreed"), "disagreements").withColumn("unsteady", F.col("disagreements") >= UNSTEADY)
    held = {f"c_{f}": F.when(F.col(f"streak_{f}") >= F.col("needed"), F.col(f)) for f in FIELDS}
    items = F.col("streak_items") >= F.col("needed")
    return df.withColumns(held | {"c_n_items": F.when(items, F.col("n_items")).otherwise(0), "c_items_sum": F.when(items, F.col("items_sum")).otherwise(0), "items_confirmed": items}).drop("_key")


def settle(frames: DataFrame, confirmations: int | None = None, told: bool = True) -> DataFrame:
    """Each frame alone, then the confirmed view: via is frame, consensus or null, with the status and values that count.

    repeats: for how many frames in a row the same repair has been made of a frame alone. told=False makes no sentences.
    """
    alone = reconcile(frames, out="a_", told=told)
    values = F.array_join(F.array(*(F.coalesce(F.col(f"a_v_{f}").cast("string"), F.lit("x")) for f in FIELDS)), "/")
    alone = alone.withColumn("_repair", F.when(F.col("a_status") == "repaired", F.concat(values, F.lit("|"), F.col("items_key"))))
    both = reconcile(observe(alone, confirmations, {"repeats": "_repair"}).drop("_repair"), prefix="c_", out="b_", told=told)
    settled = F.col("a_status") != "unresolved"
    agreed = ~settled & (F.col("b_status") != "unresolved")
    pick = lambda name: F.when(agreed, F.col(f"b_{name}")).otherwise(F.col(f"a_{name}"))
    return both.withColumns({"via": F.when(settled, "frame").when(agreed, "consensus"), "status": pick("status")} | ({"problems": pick("problems")} if told else {}) | {f"v_{f}": pick(f"v_{f}") for f in FIELDS})


def sessions(frames: DataFrame) -> DataFrame:
    """The accept policy on top: a reconciled frame or a confirmed view settles; a repaired frame needs the same
    repair in the next frame. Without the sentences of repairs and problems."""
    df = settle(frames, told=False)
    accepted = false(F.col("status") == "reconciled") | false(F.col("via") == "consensus") | (F.col("repeats") >= REPEATS)
    saw = (F.col("n_items") > 0) | F.coalesce(*(F.when(F.col(f).isNotNull(), F.lit(True)) for f in FIELDS), F.lit(False))
    df = df.withColumn("accepted", F.col("via").isNotNull() & accepted)
    return df.withColumns({"awaiting_repeat": (F.col("repeats") >= 1) & ~F.col("accepted"), "saw_money": saw})


def first_accepted(frames: DataFrame) -> DataFrame:
    """One row per session: the first frame that settled it, or nulls; later frames don't count."""
    df = sessions(frames)
    kept = F.struct("frame_no", "via", "status", *(f"v_{f}" for f in FIELDS))
    best = F.min_by(F.when(F.col("accepted"), kept), F.when(F.col("accepted"), F.col("frame_no")))
    return df.groupBy("session_id").agg(best.alias("s"), F.count("*").alias("n_frames")).select("session_id", "n_frames", F.col("s.frame_no").alias("settled_frame"), "s.via", "s.status", *(f"s.v_{f}" for f in FIELDS))


def still(frames: DataFrame) -> DataFrame:
    """One picture: settled unless unresolved."""
    df = reconcile(frames)
    saw = (F.col("n_items") > 0) | F.coalesce(*(F.when(F.col(f).isNotNull(), F.lit(True)) for f in FIELDS), F.lit(False))
    return df.withColumns({"settled": F.col("status") != "unresolved", "saw_money": saw})


def status_line(engine: Column, reading: Column, phase: Column, looking: Column) -> Column:
    """What the capture screen says, by priority."""
    return (
        F.when(engine == "failed", "Couldn’t load the reader. Reload the page to try again.")
        .when(reading, "Reading the receipt…")
        .when(engine == "loading", "Loading the reader. About 4.5 MB, first time only.")
        .when(phase != "live", F.lit(None))
        .when(~looking, "Fill the frame with the receipt.")
        .when(F.col("unsteady"), "Hold steady.")
        .when(F.col("awaiting_repeat"), "Almost there. Hold still.")
        .when(~F.col("saw_money"), "No prices yet. Move closer or add light.")
        .otherwise("Reading… keep the whole receipt in frame.")
    )


def banner_tone() -> Column:
    blank = (F.col("n_items") == 0) & F.coalesce(*FIELDS).isNull()
    return F.when(blank, "idle").when((F.col("status") == "reconciled") | F.col("no_tip_printed"), "ok").when(F.col("status") == "repaired", "warn").otherwise("bad")


def origin(source: Column, via: Column, frames: Column) -> Column:
    """Where a settled bill comes from, in words."""
    n = frames.cast("string")
    return (
        F.when(source == "example", F.lit("Read from the example receipt"))
        .when(source == "photo", F.lit("Read from your photo"))
        .when(via == "consensus", F.concat(F.lit("Confirmed across "), n, F.lit(" frames")))
        .when(frames == 1, F.lit("Read and verified in one frame"))
        .otherwise(F.concat(F.lit("Verified on frame "), n))
    )
