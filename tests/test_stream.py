"""Sessions as a stream: resets, late frames, idle sessions, and restarts from the checkpoint."""

import pytest

import __spark_entry__
from tillproof.streaming import session

SCHEMA = "session_id long, frame_no int, n_items long, items_sum long, items_key string, subtotal long, tax long, tip long, total long, reset boolean"
GOOD = (1, 1000, "1000", 1000, 80, 200, 1280, False)
ODD = (0, 0, "", 1000, 100, 100, 1300, False)
RESET = (*[None] * 7, True)


def by(rows) -> dict:
    return {(r.session_id, r.epoch): r for r in rows.collect()}


def test_resets_begin_a_new_epoch(spark, tmp_path):
    one = [(1, 1, *ODD), (1, 2, *RESET), (1, 2, *GOOD), (2, 1, *GOOD), (2, 2, *ODD)]
    two = [(1, 1, *GOOD), (1, 3, *ODD), (2, 3, *RESET), (3, 5, *RESET), (3, 5, *GOOD)]
    got = by(session.replay([spark.createDataFrame(p, SCHEMA) for p in (one, two)], "resets", str(tmp_path)))
    assert (got[1, 0].settled_frame, got[1, 0].closed, got[1, 0].frames) == (None, "reset", 1)
    assert (got[1, 1].settled_frame, got[1, 1].status, got[1, 1].frames, got[1, 1].late) == (2, "reconciled", 2, 1)
    assert (got[2, 0].settled_frame, got[2, 0].closed, got[2, 0].frames) == (1, "reset", 2) and (2, 1) not in got
    assert got[3, 1].settled_frame == 5 and (3, 0) not in got


def test_idle_sessions_are_closed_and_their_state_goes(spark, tmp_path):
    portions = [[(1, 1, *ODD), (2, 1, *ODD)], [(2, 2, *ODD)], [(2, 3, *GOOD)], [(1, 1, *GOOD), (2, 4, *ODD)]]
    frames = [spark.createDataFrame(p, SCHEMA) for p in portions]
    got = session.replay(frames, "idle", str(tmp_path), idle=25.0, pause=18.0)
    rows = spark.read.parquet(str(tmp_path / "out")).where("session_id = 1").orderBy("batch").collect()
    # Closed by a timer while session 2 goes on; what comes after that begins anew, and frame 1 isn't late.
    assert [(r.closed, r.frames, r.late, r.settled_frame) for r in rows] == [(None, 1, 0, None), ("idle", 1, 0, None), (None, 1, 0, 1)]
    assert by(got)[2, 0].settled_frame == 3 and by(got)[2, 0].frames == 4
    kept = spark.read.format("statestore").load(str(tmp_path / "state")).collect()
    assert len(kept) == 2


def test_stream_with_resets_equals_sessions_cut_there(spark, sf):
    q = __spark_entry__.queries()
    want = q["q43_session_reset"](spark, sf)
    got = q["q55_stream_reset"](spark, sf).select(want.columns)
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("order", [1, -1])
def test_frames_in_any_order_within_a_portion(spark, tmp_path, order):
    rows = [(1, k, *ODD) for k in (1, 2, 3)] + [(1, 4, *GOOD)]
    got = by(session.replay([spark.createDataFrame(rows[::order], SCHEMA)], f"order{order % 5}", str(tmp_path)))
    assert (got[1, 0].settled_frame, got[1, 0].frames, got[1, 0].late) == (4, 4, 0)


def test_live_frames_go_on_after_a_stop(spark, tmp_path):
    from tillproof.streaming import camera

    rows = [(s, k, *(GOOD if k == 5 else ODD)) for s in (1, 2) for k in range(1, 8) if (s, k) != (2, 4)]
    frames = spark.createDataFrame(rows, SCHEMA)
    first = {(r.session_id, r.frame_no, r.tick) for r in camera.watch(frames, 2, str(tmp_path / "a"), admitted=2).collect()}
    assert first == {(1, 2, 0), (2, 2, 0), (1, 4, 1), (2, 3, 1)}
    seen = camera.watch(frames, 3, str(tmp_path / "a"), admitted=2).collect()
    assert {(r.session_id, r.frame_no) for r in seen} == {(1, 2), (1, 4), (1, 6), (1, 7), (2, 2), (2, 3), (2, 6), (2, 7)} and len(seen) == 8
    times = {r.tick: r.arrived for r in seen}
    assert all((times[k + 1] - times[k]).total_seconds() == 0.3 for k in range(3))
    every = {r.session_id: r for r in camera.settled(frames, 6, str(tmp_path / "b")).collect()}
    assert all(r.settled_frame == 5 and r.late == 0 for r in every.values())
    # With two frames a tick the good one is passed over.
    half = {r.session_id: r for r in camera.settled(frames, 4, str(tmp_path / "c"), admitted=2).collect()}
    assert all(r.settled_frame is None for r in half.values())


def test_a_session_costs_little_per_micro_batch():
    """A thousand steps of the state in well under the time that frames of pandas with typed columns take."""
    import time

    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

        def setTimeoutDuration(self, ms):
            pass

    rows = [(2, 4.0, 1000, "1,2", 1000, 80.0, 200, 1280, False), (1, float("nan"), None, None, None, None, None, None, True), (1, 0.0, 0, "", None, None, None, None, False)]
    chunks = [pd.DataFrame(rows[k:], columns=[*session.FRAME, "reset"]) for k in (0, 2)]
    start = time.perf_counter()
    for _ in range(1000):
        (out,) = session.advance((7,), iter(chunks), State(), 1000)
    assert time.perf_counter() - start < 3
    assert out[["session_id", "settled_frame", "v_tax", "frames", "late", "epoch"]].to_dict("records") == [{"session_id": 7, "settled_frame": 2, "v_tax": 80, "frames": 2, "late": 1, "epoch": 1}]
