"""The rules of one capture session, frame by frame: plain Python over a few numbers. streaming.book has them for many sessions in step."""

from __future__ import annotations

FIELDS = ("subtotal", "tax", "tip", "total")
OUT = "session_id long, settled_frame int, via string, status string, v_subtotal long, v_tax long, v_tip long, v_total long, frames int, late int, epoch int, closed string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def plausible(v: dict) -> bool:
    s, x, p, t = (v[f] for f in FIELDS)
    return not (s is None or s <= 0 or t is None or t <= 0 or t < s or (x is not None and not 0 <= x <= s * 0.3) or (p is not None and not 0 <= p <= s))


def solve(field: str, v: dict) -> int | None:
    rest = [v[f] for f in FIELDS if f != field]
    if None in rest:
        return None
    return sum(rest) if field == "total" else v["total"] - sum(v[f] for f in FIELDS[:3] if f != field)


def judge(n_items: int, items_sum: int, fields: dict) -> tuple[str, dict]:
    """Status and values of one reading."""
    v, repaired = dict(fields), False
    if v["subtotal"] is None and n_items:
        v["subtotal"], repaired = items_sum, True
    disputed = n_items > 0 and v["subtotal"] is not None and v["subtotal"] != items_sum
    if v["tip"] is None and not disputed and None not in (v["subtotal"], v["tax"], v["total"]) and v["subtotal"] + v["tax"] == v["total"]:
        v["tip"], repaired = 0, True
    gaps = [f for f in FIELDS if v[f] is None]
    if len(gaps) == 1 and not disputed:
        trial = v | {gaps[0]: solve(gaps[0], v)}
        if plausible(trial):
            v, repaired = trial, True
    whole = all(v[f] is not None for f in FIELDS)
    if whole and not disputed:
        if sum(v[f] for f in FIELDS[:3]) == v["total"]:
            return ("repaired" if repaired else "reconciled"), v
        backed = n_items > 0 and v["subtotal"] == items_sum
        ways = [t for f in FIELDS if not (f == "subtotal" and backed) for t in [v | {f: solve(f, v)}] if t != v and plausible(t)]
        if len(ways) == 1:
            return "repaired", ways[0]
    return "unresolved", v


class Session:
    """The state of one session; to_json and from_json carry it between micro-batches."""

    def __init__(self, saved: dict | None = None):
        self.s = saved or {"streaks": {f: [None, 0] for f in (*FIELDS, "items")}, "needed": 2, "last": 0, "frames": 0, "late": 0, "repair": ["", 0], "settled": None, "epoch": 0}

    def observe(self, r: dict) -> None:
        s = self.s
        if r["frame_no"] <= s["last"]:
            s["late"] += 1
            return
        s["last"], s["frames"] = r["frame_no"], s["frames"] + 1
        if s["settled"]:
            return
        fields = {f: r[f] for f in FIELDS}
        if r["n_items"] + sum(v is not None for v in fields.values()) >= 25:
            s["needed"] = 3
        for f, v in (fields | {"items": r["items_key"] if r["n_items"] else None}).items():
            old = s["streaks"][f]
            s["streaks"][f] = [v, 0 if v is None else old[1] + 1 if old[0] == v and old[1] else 1]
        status, values = judge(r["n_items"], r["items_sum"], fields)
        via = "frame" if status != "unresolved" else None
        if via is None:
            held = {f: s["streaks"][f][0] if s["streaks"][f][1] >= s["needed"] else None for f in FIELDS}
            same = s["streaks"]["items"][1] >= s["needed"]
            status, agreed = judge(r["n_items"] if same else 0, r["items_sum"] if same else 0, held)
            if status != "unresolved":
                via, values = "consensus", agreed
        key = ""
        if via == "frame" and status == "repaired":
            key = "/".join("x" if values[f] is None else str(values[f]) for f in FIELDS) + "|" + (r["items_key"] or "")
        s["repair"] = [key, s["repair"][1] + 1 if key and s["repair"][0] == key else int(bool(key))]
        if via and (status == "reconciled" or via == "consensus" or s["repair"][1] >= 2):
            s["settled"] = [r["frame_no"], via, status, *(values[f] for f in FIELDS)]

    def reset(self, frame_no: int) -> None:
        """A new epoch from this frame on; frames before it come too late."""
        old = self.s
        self.s = Session().s | {"epoch": old["epoch"] + 1, "last": max(old["last"], frame_no - 1)}

    def row(self, session_id: int, closed: str | None = None) -> dict:
        s = self.s
        done = s["settled"] or [None] * 7
        return dict(zip(COLUMNS, [session_id, *done, s["frames"], s["late"], s["epoch"], closed], strict=True))
