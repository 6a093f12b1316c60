"""A live source of frames: ticks at a steady cadence, each taking the frame that is newest by then.

Reading a frame takes a while, in which others pass: of the `admitted` frames of a session that fall into one tick only
the latest is delivered, so that a slow reader is late by one tick at most and never builds a queue. Ticks come from a
source with offsets of its own (one row for each tick, `cadence` milliseconds apart in stream time), so that a query that
stops goes on with the next tick from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import IDLE, batches_with_frames_only, sessions

#: Milliseconds from one tick to the next; a fixed value.
CADENCE = 300


def newest(frames: DataFrame, admitted: int) -> DataFrame:
    """The frames that are delivered: of each session and tick the latest one, with the tick's number."""
    tick = F.expr(f"(frame_no - 1) div {admitted}").alias("tick")
    columns = [F.col(f"`{c}`") for c in frames.columns]
    last = frames.select(tick, F.col("session_id").alias("_s"), F.struct(*columns).alias("f")).groupBy("_s", "tick").agg(F.max_by("f", "f.frame_no").alias("f"))
    return last.select("tick", "f.*")


def live(frames: DataFrame, admitted: int = 1, cadence: int = CADENCE) -> DataFrame:
    """The delivered frames as a stream, with `tick` and the stream time at which they `arrived`.

    frames: session_id, frame_no (from 1, gaps allowed) and whatever a frame carries; a table, read anew for each tick.
    """
    clock = frames.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", cadence).load()
    ticks = clock.select(F.col("value").alias("tick"), F.col("timestamp").alias("arrived"))
    return ticks.join(newest(frames, admitted), "tick")


def watch(frames: DataFrame, ticks: int, folder: str, admitted: int = 1) -> DataFrame:
    """Delivers so many more ticks, one micro-batch each, and gives all frames delivered so far under this folder.

    Another call goes on after the last tick of the one before.
    """
    for _ in range(ticks):
        query = live(frames, admitted).writeStream.format("parquet").option("path", f"{folder}/seen").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return frames.sparkSession.read.parquet(f"{folder}/seen")


def settled(frames: DataFrame, ticks: int, folder: str, admitted: int = 1, idle: float = IDLE) -> DataFrame:
    """The same ticks through the session rules: the last row of each session."""
    spark, table = frames.sparkSession, f"{folder}/settled"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch_no={number}")

    for _ in range(ticks):
        stream = sessions(live(frames, admitted), idle).writeStream.foreachBatch(keep).outputMode("update")
        with batches_with_frames_only(spark):
            stream.option("checkpointLocation", f"{folder}/rules").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(table)
    columns = [c for c in rows.columns if c not in ("batch", "batch_no", "session_id")]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("session_id", "r.*")
