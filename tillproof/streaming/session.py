"""Capture sessions as a stream: frames grouped by session, the rules of operators.consensus as keyed state.

A micro-batch may bring a session's frames in any order and in several chunks; they are sorted by frame_no before they
count. A frame that isn't newer than the last one counted is dropped and counted as late. Once a session has settled,
further frames are ignored until it is reset: a row with `reset` begins the session anew from its frame_no on, as a new
epoch, and the epoch before it is closed. A session that hears nothing for `idle` seconds is closed at the next
micro-batch and its state goes. State is a few numbers a session. Sessions are dealt to groups by their ids, and a group's
sessions take their frames in step (book), as a group of its own for each session costs Spark far more than its frames.
"""

from __future__ import annotations

import contextlib
import functools
import json
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .book import EVENT, Book
from .rules import COLUMNS, FIELDS, OUT, Session, judge

__all__ = ["EMPTY_BATCHES", "FIELDS", "FRAME", "IDLE", "advance", "batches_with_frames_only", "judge", "replay", "sessions"]

#: Seconds without a frame after which a session is closed.
IDLE = 3600.0
#: Groups that sessions are dealt to; their number stays with a checkpoint.
GROUPS = 64


#: What a frame brings, besides the session.
FRAME = ("frame_no", "n_items", "items_sum", "items_key", *FIELDS)

def number(v) -> int | None:
    return None if v is None or v != v else int(v)


def told(rows: list[dict]) -> pd.DataFrame:
    """Rows as plain objects: a session gives one or two, too few for columns of types of their own."""
    return pd.DataFrame([[r[c] for c in COLUMNS] for r in rows], columns=COLUMNS, dtype=object)


def arrived(chunks: Iterable[pd.DataFrame]) -> list[dict]:
    """The frames of a session in their order, a reset before the frame of its number."""
    out = []
    for chunk in chunks:
        if "frame" in chunk:
            out += [{c: r.get(c) for c in (*FRAME, "reset")} for r in map(json.loads, chunk["frame"].tolist())]
            continue
        columns = [chunk[c].tolist() for c in (*FRAME, "reset")]
        out += [dict(zip((*FRAME, "reset"), r, strict=True)) for r in zip(*columns, strict=True)]
    return sorted(out, key=lambda r: (r["frame_no"], not r["reset"]))


def advance(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState, idle: int) -> Iterator[pd.DataFrame]:
    session, out = Session(json.loads(state.get[0]) if state.exists else None), []
    if state.hasTimedOut:
        state.remove()
        yield told([session.row(int(key[0]), "idle")])
        return
    for r in arrived(chunks):
        if r["reset"]:
            if session.s["frames"]:
                out.append(session.row(int(key[0]), "reset"))
            session.reset(number(r["frame_no"]))
        else:
            session.observe({k: r[k] if k == "items_key" else number(r[k]) for k in FRAME})
    if session.s["frames"] or not out:
        out.append(session.row(int(key[0])))
    state.update((json.dumps(session.s),))
    state.setTimeoutDuration(idle)
    yield told(out)


def advance_group(chunks: Iterable[pd.DataFrame], state: GroupState, idle: int) -> Iterator[pd.DataFrame]:
    """A micro-batch's events of a group of sessions."""
    book, now = Book(state.get[0] if state.exists else None), state.getCurrentProcessingTimeMs()
    if state.hasTimedOut:
        out = [book.idle(now, idle)]
    else:
        chunks = list(chunks)
        at, out = book.take({c: np.concatenate([chunk[c].to_numpy() for chunk in chunks]) for c in EVENT}, now)
        out.append(book.idle(now, idle, at))
    if len(book.ids):
        state.update((book.saved(),))
        state.setTimeoutDuration(max(1, int(book.c["heard"].min()) + idle - now))
    else:
        state.remove()
    yield from (rows for rows in out if rows is not None and len(rows))


def sessions(frames: DataFrame, idle: float = IDLE, groups: int = GROUPS) -> DataFrame:
    """A row per session and micro-batch that touched it: how it stands after the frames so far; a row more for each epoch that was closed.

    groups: how many groups the sessions are dealt to; 0 makes each session a group of its own.
    """
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in frames.columns else F.lit(False)
    step = functools.partial(advance if not groups else advance_group, idle=int(idle * 1000))
    timeout = GroupStateTimeout.ProcessingTimeTimeout
    if not groups:
        # One column: each costs a conversion to pandas for every session and micro-batch.
        wanted = frames.select("session_id", F.to_json(F.struct(*FRAME, reset.alias("reset"))).alias("frame"))
        return wanted.groupBy("session_id").applyInPandasWithState(lambda key, chunks, state: step(key, chunks, state), OUT, "saved string", "update", timeout)
    # Whole numbers without nulls, which pandas would take for fractions.
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    known = sum((F.col(f).isNotNull().cast("bigint") * (1 << k) for k, f in enumerate(FIELDS)), F.lit(0).cast("bigint"))
    wanted = frames.select(F.col("session_id").cast("bigint").alias("session_id"), F.col("frame_no").cast("bigint").alias("frame_no"), reset.alias("reset"), *map(number, ("n_items", "items_sum", *FIELDS)), known.alias("known"), "items_key")
    dealt = wanted.withColumn("group", F.pmod(F.xxhash64("session_id"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandasWithState(lambda key, chunks, state: step(chunks, state), OUT, "saved binary", "update", timeout)


#: With timeouts every batch asks for another one, so a run over what is there would never end; they count at the next batch with frames.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextlib.contextmanager
def batches_with_frames_only(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(EMPTY_BATCHES, before)


def replay(portions: list[DataFrame], name: str, folder: str, idle: float = IDLE, pause: float = 0, groups: int = GROUPS) -> DataFrame:
    """Writes portions of frames one after the other and runs the stream over each; gives the last row of each session and epoch.

    pause: seconds between portions; groups: as sessions() takes them.

    The stream stops after each portion and goes on from its checkpoint, so portions count in their order, whatever
    the order of the files within one.
    """
    spark, source, table = portions[0].sparkSession, f"{folder}/frames", f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch_no={number}")

    for k, frames in enumerate(portions):
        time.sleep(pause if k else 0)
        frames.write.mode("append").parquet(source)
        stream = spark.readStream.schema(frames.schema).parquet(source)
        with batches_with_frames_only(spark):
            query = sessions(stream, idle, groups).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").queryName(name).trigger(availableNow=True).start()
            query.awaitTermination()
    rows = spark.read.parquet(table)
    columns = [c for c in rows.columns if c not in ("batch", "batch_no", "session_id", "epoch")]
    last = rows.groupBy("session_id", "epoch").agg(F.max_by(F.struct(*columns), F.struct("batch", F.col("closed").isNotNull())).alias("r"))
    return last.select("session_id", "epoch", "r.*")
