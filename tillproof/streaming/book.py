"""Many sessions as one state: columns over sessions, by the rules of rules.Session for all of them in step.

A micro-batch's events are taken in rounds, each session's first, then each one's second, and so on. Sessions that go on
when few are left in step are finished one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from .rules import COLUMNS, FIELDS, Session

#: Below so many sessions still in step, each is finished on its own.
IN_STEP = 8
OPEN, RECONCILED, REPAIRED = 0, 1, 2
STATUS = np.array([None, "reconciled", "repaired"], object)
NOWHERE, FRAME, CONSENSUS = 0, 1, 2
VIA = np.array([None, "frame", "consensus"], object)
#: Whole numbers that a session keeps, besides its id: `is` counts how long a streak is, `of` is what it holds.
NUMBERS = ("last", "frames", "late", "epoch", "needed", "heard", *(f"of_{f}" for f in FIELDS), *(f"is_{f}" for f in (*FIELDS, "items")), "repeats", *(f"fix_{f}" for f in FIELDS), "settled", "via", "status", *(f"v_{f}" for f in FIELDS))
TEXTS = ("of_items", "fix_items")
#: What an event brings, without nulls but in the key: `known` has a bit for each total that was read.
EVENT = ("session_id", "frame_no", "reset", "n_items", "items_sum", *FIELDS, "known", "items_key")


def solved(f: int, v: np.ndarray) -> np.ndarray:
    return v[0] + v[1] + v[2] if f == 3 else v[3] - sum(v[g] for g in range(3) if g != f)


def plausible(v: np.ndarray) -> np.ndarray:
    s, x, p, t = v
    return (s > 0) & (t > 0) & (t >= s) & (x >= 0) & (x <= s * 0.3) & (p >= 0) & (p <= s)


def judged(n: np.ndarray, total: np.ndarray, v: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Status and values of many readings, as rules.judge has them of one; values of an open one don't count."""
    v, known = v.copy(), known.copy()
    repaired = ~known[0] & (n > 0)
    v[0], known[0] = np.where(repaired, total, v[0]), known[0] | repaired
    disputed = (n > 0) & known[0] & (v[0] != total)
    no_tip = ~known[2] & ~disputed & known[0] & known[1] & known[3] & (v[0] + v[1] == v[3])
    v[2], known[2] = np.where(no_tip, 0, v[2]), known[2] | no_tip
    repaired |= no_tip
    one = ((~known).sum(axis=0) == 1) & ~disputed

    def changed(f: int) -> np.ndarray:
        return np.array([solved(f, v) if g == f else v[g] for g in range(4)])

    for f in range(4):
        trial = changed(f)
        fits = one & ~known[f] & plausible(trial)
        v[f], known[f] = np.where(fits, trial[f], v[f]), known[f] | fits
        repaired |= fits
        one &= ~fits
    whole = known.all(axis=0) & ~disputed
    closes = whole & (v[0] + v[1] + v[2] == v[3])
    backed = (n > 0) & (v[0] == total)
    tries = [changed(f) for f in range(4)]
    ways = np.array([whole & ~closes & (t[f] != v[f]) & plausible(t) & ~(backed & (f == 0)) for f, t in enumerate(tries)])
    only = ways.sum(axis=0) == 1
    for f in range(4):
        v[f] = np.where(only & ways[f], tries[f][f], v[f])
    return np.where(closes & ~repaired, RECONCILED, np.where(closes | only, REPAIRED, OPEN)), v


class Book:
    """The sessions of one group, in the order of their ids."""

    def __init__(self, saved: bytes | None = None):
        if saved is None:
            self.ids, self.c = np.zeros(0, np.int64), {k: np.zeros(0, np.int64) for k in NUMBERS} | {k: np.zeros(0, object) for k in TEXTS}
            return
        with pa.ipc.open_stream(saved) as stream:
            batch = stream.read_next_batch()
        self.ids = batch.column("session_id").to_numpy()
        self.c = {k: batch.column(k).to_numpy(zero_copy_only=False).copy() for k in (*NUMBERS, *TEXTS)}

    def saved(self) -> bytes:
        arrays = [pa.array(self.ids), *(pa.array(self.c[k]) for k in NUMBERS), *(pa.array(self.c[k], pa.string()) for k in TEXTS)]
        batch = pa.RecordBatch.from_arrays(arrays, names=["session_id", *NUMBERS, *TEXTS])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
            stream.write_batch(batch)
        return out.getvalue().to_pybytes()

    def kept(self, which: np.ndarray) -> None:
        self.ids, self.c = self.ids[which], {k: x[which] for k, x in self.c.items()}

    def rows(self, at: np.ndarray, closed: str | None = None) -> pd.DataFrame:
        """How sessions stand, as rules.OUT has it."""
        done = self.c["settled"][at] == 0
        whole = lambda k, none=None: pd.arrays.IntegerArray(self.c[k][at], np.zeros(len(at), bool) if none is None else none)
        made = [pd.array(self.ids[at], "Int64"), whole("settled", done), VIA[self.c["via"][at]], STATUS[self.c["status"][at]], *(whole(f"v_{f}", done) for f in FIELDS), whole("frames"), whole("late"), whole("epoch"), np.full(len(at), closed, object)]
        return pd.DataFrame(dict(zip(COLUMNS, made, strict=True)))

    def idle(self, now: int, idle: int, touched: np.ndarray | None = None) -> pd.DataFrame | None:
        """Closes the sessions that have heard nothing for so long, without those that were touched now."""
        over = self.c["heard"] + idle < now
        if touched is not None:
            over[touched] = False
        if not over.any():
            return None
        out = self.rows(np.flatnonzero(over), "idle")
        self.kept(~over)
        return out

    def clear(self, at: np.ndarray) -> None:
        """An epoch's start: nothing seen."""
        for k in (*NUMBERS, *TEXTS):
            if k not in ("last", "epoch", "heard"):
                self.c[k][at] = None if k in TEXTS else 2 if k == "needed" else 0

    def enter(self, ids: np.ndarray) -> np.ndarray:
        """Where the sessions of these ids (ascending) stand; new ones come in."""
        new = np.setdiff1d(ids, self.ids, assume_unique=True)
        if len(new):
            every = np.concatenate([self.ids, new])
            order = np.argsort(every, kind="stable")
            self.ids = every[order]
            for k in (*NUMBERS, *TEXTS):
                more = np.full(len(new), None, object) if k in TEXTS else np.full(len(new), 2 if k == "needed" else 0, np.int64)
                self.c[k] = np.concatenate([self.c[k], more])[order]
        return np.searchsorted(self.ids, ids)

    def take(self, events: dict[str, np.ndarray], now: int) -> tuple[np.ndarray, list[pd.DataFrame]]:
        """Takes a micro-batch's events, in any order; gives where the sessions touched stand, and their rows."""
        order = np.lexsort((~events["reset"], events["frame_no"], events["session_id"]))
        e = {k: x[order] for k, x in events.items()}
        ids, starts, counts = np.unique(e["session_id"], return_index=True, return_counts=True)
        at = self.enter(ids)
        self.c["heard"][at] = now
        told = np.zeros(len(ids), bool)
        out: list[pd.DataFrame] = []
        by = np.argsort(-counts, kind="stable")
        step, live = 0, len(ids)
        while live >= IN_STEP:
            who = by[:live]
            here = {k: x[starts[who] + step] for k, x in e.items()}
            again = here["reset"]
            if again.any():
                closing = who[again & (self.c["frames"][at[who]] > 0)]
                told[closing] = True
                out.append(self.rows(at[closing], "reset"))
                self.reset(at[who[again]], here["frame_no"][again])
            self.observe(at[who[~again]], {k: x[~again] for k, x in here.items()})
            step += 1
            live = int(np.searchsorted(-counts[by], -step, "left"))
        for i in by[:live]:
            told[i] |= self.alone(int(at[i]), {k: x[starts[i] + step : starts[i] + counts[i]].tolist() for k, x in e.items()}, out)
        left = at[(self.c["frames"][at] > 0) | ~told]
        return at, [*out, self.rows(left)]

    def plain(self, i: int) -> dict:
        """A session's state as Session keeps it."""
        c = {k: x[i] if k in TEXTS else int(x[i]) for k, x in self.c.items()}
        streaks = {f: [c[f"of_{f}"], c[f"is_{f}"]] if c[f"is_{f}"] else [None, 0] for f in (*FIELDS, "items")}
        key = "/".join(str(c[f"fix_{f}"]) for f in FIELDS) + "|" + c["fix_items"] if c["repeats"] else ""
        settled = [c["settled"], VIA[c["via"]], STATUS[c["status"]], *(c[f"v_{f}"] for f in FIELDS)] if c["settled"] else None
        return {"streaks": streaks, "repair": [key, c["repeats"]], "settled": settled} | {k: c[k] for k in ("needed", "last", "frames", "late", "epoch")}

    def put(self, i: int, s: dict) -> None:
        self.clear(np.array([i]))
        own = {k: s[k] for k in ("needed", "last", "frames", "late", "epoch")}
        for f, (value, n) in s["streaks"].items():
            own |= {f"of_{f}": value, f"is_{f}": n} if n else {}
        key, own["repeats"] = s["repair"]
        if key:
            amounts, own["fix_items"] = key.split("|", 1)
            own |= {f"fix_{f}": int(v) for f, v in zip(FIELDS, amounts.split("/"), strict=True)}
        if s["settled"]:
            frame_no, via, status, *values = s["settled"]
            own |= {"settled": frame_no, "via": list(VIA).index(via), "status": list(STATUS).index(status)} | {f"v_{f}": v for f, v in zip(FIELDS, values, strict=True)}
        for k, v in own.items():
            self.c[k][i] = v

    def alone(self, i: int, events: dict[str, list], out: list[pd.DataFrame]) -> bool:
        """A session's events one after the other; whether an epoch was closed."""
        session, told = Session(self.plain(i)), False
        for r in (dict(zip(events, e, strict=True)) for e in zip(*events.values(), strict=True)):
            if not r["reset"]:
                session.observe(r | {f: r[f] if r["known"] >> k & 1 else None for k, f in enumerate(FIELDS)})
                continue
            if session.s["frames"]:
                self.put(i, session.s)
                out.append(self.rows(np.array([i]), "reset"))
                told = True
            session.reset(r["frame_no"])
        self.put(i, session.s)
        return told

    def reset(self, at: np.ndarray, frame_no: np.ndarray) -> None:
        self.clear(at)
        self.c["epoch"][at] += 1
        self.c["last"][at] = np.maximum(self.c["last"][at], frame_no - 1)

    def observe(self, at: np.ndarray, e: dict[str, np.ndarray]) -> None:
        """A frame for each of these sessions."""
        c = self.c
        late = e["frame_no"] <= c["last"][at]
        c["late"][at[late]] += 1
        at, e = at[~late], {k: x[~late] for k, x in e.items()}
        c["last"][at] = e["frame_no"]
        c["frames"][at] += 1
        fresh = c["settled"][at] == 0
        at, e = at[fresh], {k: x[fresh] for k, x in e.items()}
        if not len(at):
            return
        v = np.array([e[f] for f in FIELDS])
        known = np.array([(e["known"] >> k & 1).astype(bool) for k in range(4)])
        n, total, key = e["n_items"], e["items_sum"], e["items_key"]
        c["needed"][at[n + known.sum(axis=0) >= 25]] = 3
        named = np.array([k is not None for k in key], bool)
        for f, value, seen in [*((f, v[k], known[k]) for k, f in enumerate(FIELDS)), ("items", key, (n != 0) & named)]:
            long = c[f"is_{f}"][at]
            same = (long > 0) & (c[f"of_{f}"][at] == value).astype(bool)
            c[f"is_{f}"][at] = np.where(seen, np.where(same, long + 1, 1), 0)
            c[f"of_{f}"][at] = value
        status, values = judged(n, total, v, known)
        via = np.where(status != OPEN, FRAME, NOWHERE)
        needed = c["needed"][at]
        held = np.array([c[f"is_{f}"][at] >= needed for f in FIELDS])
        same = c["is_items"][at] >= needed
        agreed, theirs = judged(np.where(same, n, 0), np.where(same, total, 0), np.where(held, v, 0), held)
        other = (via == NOWHERE) & (agreed != OPEN)
        via, status, values = np.where(other, CONSENSUS, via), np.where(other, agreed, status), np.where(other, theirs, values)
        text = np.where(named, key, "")
        fixed = (via == FRAME) & (status == REPAIRED)
        again = fixed & (c["repeats"][at] > 0) & (c["fix_items"][at] == text).astype(bool)
        for k, f in enumerate(FIELDS):
            again &= c[f"fix_{f}"][at] == values[k]
            c[f"fix_{f}"][at] = values[k]
        c["fix_items"][at] = np.where(fixed, text, None)
        c["repeats"][at] = np.where(fixed, np.where(again, c["repeats"][at] + 1, 1), 0)
        done = (via != NOWHERE) & ((status == RECONCILED) | (via == CONSENSUS) | (c["repeats"][at] >= 2))
        own = at[done]
        c["settled"][own], c["via"][own], c["status"][own] = e["frame_no"][done], via[done], status[done]
        for k, f in enumerate(FIELDS):
            c[f"v_{f}"][own] = values[k][done]
