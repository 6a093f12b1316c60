"""Many sessions in step against one session after the other."""

import random

import numpy as np
import pandas as pd
import pytest

from tillproof.plans import queries
from tillproof.streaming import book, session
from tillproof.streaming.rules import COLUMNS, FIELDS, Session

VALUES = [None, 0, 1, 100, 110, 120, 121, 1000, 1080, 1280, 1300, -5]


def events(rnd: random.Random, sessions: int, most: int) -> list[dict]:
    out = []
    for s in range(sessions):
        good = (1000, 80, 200, 1280)
        for _ in range(rnd.randint(1, most)):
            total = rnd.choice([[rnd.choice(VALUES) for _ in FIELDS], [rnd.choice([v, v, v, None, v + 1]) for v in good]])
            n = rnd.choice([0, 1, 1, 3, 24])
            out.append({"session_id": s, "frame_no": rnd.randrange(1, 12), "reset": rnd.random() < 0.15, "n_items": n, "items_sum": rnd.choice([1000, 1000, 100, 0]), "items_key": rnd.choice(["a", "a", "b", "", None])} | dict(zip(FIELDS, total, strict=True)))
    rnd.shuffle(out)
    return out


def columns(rows: list[dict]) -> dict[str, np.ndarray]:
    made = {k: np.array([r[k] or 0 for r in rows], np.int64) for k in ("session_id", "frame_no", "n_items", "items_sum", *FIELDS)}
    known = np.array([sum((r[f] is not None) << k for k, f in enumerate(FIELDS)) for r in rows], np.int64)
    return made | {"reset": np.array([r["reset"] for r in rows]), "known": known, "items_key": np.array([r["items_key"] for r in rows], object)}


def plain(states: dict[int, Session], rows: list[dict]) -> list[tuple]:
    out = []
    for s in sorted({r["session_id"] for r in rows}):
        one, told = states.setdefault(s, Session()), False
        for r in sorted((r for r in rows if r["session_id"] == s), key=lambda r: (r["frame_no"], not r["reset"])):
            if not r["reset"]:
                one.observe(r)
                continue
            if one.s["frames"]:
                out.append(one.row(s, "reset"))
                told = True
            one.reset(r["frame_no"])
        if one.s["frames"] or not told:
            out.append(one.row(s))
    return sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in out)))


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("in_step", [1, 8, 10**9])
def test_sessions_in_step_equal_sessions_alone(monkeypatch, seed, in_step):
    monkeypatch.setattr(book, "IN_STEP", in_step)
    rnd, states, saved, seen = random.Random(seed), {}, None, 0
    for _ in range(5):
        rows = events(rnd, rnd.randint(1, 60), rnd.choice([1, 3, 12]))
        b = book.Book(saved)
        _, out = b.take(columns(rows), 7)
        told = pd.concat([d.astype(object) for d in out])
        own = sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in told[COLUMNS].itertuples(index=False))
        assert own == plain(states, rows)
        assert {int(i): b.plain(k)["settled"] for k, i in enumerate(b.ids)} == {i: s.s["settled"] for i, s in sorted(states.items())}
        saved, seen = b.saved(), seen + sum(s.s["settled"] is not None for s in states.values())
    assert seen > 0


def test_a_group_forgets_who_is_idle():
    b = book.Book()
    good = dict(zip(FIELDS, (1000, 80, 200, 1280), strict=True)) | {"reset": False, "n_items": 0, "items_sum": 0, "items_key": ""}
    b.take(columns([{"session_id": s, "frame_no": 1} | good for s in (9, 4)]), 100)
    at, _ = b.take(columns([{"session_id": s, "frame_no": 2} | good for s in (4, 5)]), 200)
    over = b.idle(200, 50, at)
    assert over[["session_id", "closed", "frames"]].to_dict("records") == [{"session_id": 9, "closed": "idle", "frames": 1}]
    assert b.ids.tolist() == [4, 5] and b.idle(250, 50) is None and len(b.idle(251, 50)) == 2 and not len(b.ids)


def test_groups_give_what_sessions_alone_give(spark, tmp_path):
    rnd = random.Random(3)
    rows = [tuple(r[k] for k in ("session_id", "frame_no", "n_items", "items_sum", "items_key", *FIELDS, "reset")) for r in events(rnd, 60, 6) if r["items_key"] is not None]
    half = len(rows) // 2
    schema = "session_id long, frame_no int, n_items long, items_sum long, items_key string, subtotal long, tax long, tip long, total long, reset boolean"
    portions = [spark.createDataFrame(p, schema).dropDuplicates(["session_id", "frame_no", "reset"]) for p in (rows[:half], rows[half:])]
    for p in portions:
        p.cache().count()
    few, each = (session.replay(portions, f"groups{n}", str(tmp_path / str(n)), groups=n) for n in (2, 0))
    assert few.count() == each.count() >= 60 and few.exceptAll(each).isEmpty()


@pytest.mark.parametrize("name", ["q36_stream_session", "q55_stream_reset"])
def test_streams_make_their_frames_once(spark, sf, monkeypatch, name):
    made = []
    real = queries.adapters.frames
    monkeypatch.setattr(queries.adapters, "frames", lambda *a: made.append(1) or real(*a))
    monkeypatch.setattr(queries.session, "replay", lambda portions, *a, **k: portions[-1].withColumns({"epoch": queries.F.lit(0), "settled_frame": queries.F.lit(0), **{c: queries.F.lit(0) for c in ("via", "status", "frames", "late", "closed", *(f"v_{f}" for f in FIELDS))}}))
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "l_orderkey" not in plan
