"""Neighbours, rows and slopes of the kernel against loops over all words."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from tillproof.operators import layout, receipt
from tillproof.sources import words

KIND = pa.schema([("receipt_id", pa.int64()), ("word_idx", pa.int64()), ("text", pa.string()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1")), ("cents", pa.int64())])


def table(pages: list[list[dict]]) -> pa.Table:
    return pa.Table.from_pylist([{"receipt_id": k} | w for k, ws in enumerate(pages) for w in ws], KIND)


def page(rnd: random.Random, n: int) -> list[dict]:
    wide, step = rnd.choice([20, 300]), rnd.choice([1, 7, 12.5])
    out = []
    for i in range(n):
        x, y, tall = rnd.randrange(wide) * step, rnd.randrange(wide) * step / 2, rnd.choice([10, 10, 10, 14, 0])
        out.append({"word_idx": i, "text": f"w{i}", "x0": x, "y0": y, "x1": x + rnd.choice([0, 5, 20, 40]), "y1": y + tall, "cents": rnd.choice([None, 5])})
    rnd.shuffle(out)
    return out


def plain(ws: list[dict], tolerance: float = 0.6) -> tuple[float, float, list[list[int]]]:
    """line height, slope and the numbers of the words in each row."""
    median = lambda v, e=0.0: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 if v else e
    tall = median([w["y1"] - w["y0"] for w in ws]) or 1.0
    cx, cy = (lambda w: (w["x0"] + w["x1"]) / 2), (lambda w: (w["y0"] + w["y1"]) / 2)
    ratios = []
    for a in ws:
        near = [b for b in ws if b is not a and 0 <= b["x0"] - a["x1"] <= 3 * tall and abs(cy(b) - cy(a)) <= 1.5 * tall]
        if near:
            b = min(near, key=lambda b: (b["x0"] - a["x1"], b["x0"], b["word_idx"]))
            if abs(cx(b) - cx(a)) >= 1:
                ratios.append((cy(b) - cy(a)) / (cx(b) - cx(a)))
    slope = median(ratios)
    slope = 0.0 if abs(slope) > 0.3 else slope
    flat = {w["word_idx"]: cy(w) - slope * cx(w) for w in ws}
    rows, total = [], 0.0
    for w in sorted(ws, key=lambda w: (flat[w["word_idx"]], w["word_idx"])):
        f = flat[w["word_idx"]]
        if rows and abs(f - total / len(rows[-1])) <= tall * tolerance:
            rows[-1].append(w)
            total += f
        else:
            rows.append([w])
            total = f
    at = [sum(flat[w["word_idx"]] for w in sorted(r, key=lambda w: (w["x0"], flat[w["word_idx"]], w["word_idx"]))) / len(r) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (round(at[k], 9), k))
    return tall, slope, [[w["word_idx"] for w in sorted(rows[k], key=lambda w: (w["x0"], flat[w["word_idx"]], w["word_idx"]))] for k in order]


@pytest.mark.parametrize("seed", range(6))
def test_kernel_equals_loops(seed):
    rnd = random.Random(seed)
    pages = [page(rnd, rnd.choice([0, 1, 2, 9, 30, 60, 150])) for _ in range(40)]
    p = layout.Pages(table(pages))
    rows = p.rows(0.6, layout.ROWS).to_pylist()
    batches = table(pages).to_batches(max_chunksize=rnd.choice([1, 7, 50]))
    parts = [r for b in layout.rows(0.6)(iter(batches)) for r in b.to_pylist()]
    assert [r["receipt_id"] for r in parts] == p.ids.to_pylist() and [r["rows"] for r in parts] == rows
    for k, ws in enumerate([ws for ws in pages if ws]):
        tall, slope, own = plain(ws)
        assert p.tall[k] == tall and p.slope[k] == pytest.approx(slope, abs=1e-12)
        got = [[int(w["text"][1:]) for w in r["words"]] for r in rows[k]]
        assert got == own and [r["row_idx"] for r in rows[k]] == list(range(len(own)))
        by = {w["word_idx"]: w for w in ws}
        for r, ids in zip(rows[k], own, strict=True):
            assert r["text"] == " ".join(f"w{i}" for i in ids) and [w["cents"] for w in r["words"]] == [by[i]["cents"] for i in ids]
            assert (r["x0"], r["y1"]) == (min(by[i]["x0"] for i in ids), max(by[i]["y1"] for i in ids))


def test_a_long_receipt_and_one_id_for_many(spark):
    """10,000 lines in one receipt; the same receipt a thousand times under one id."""
    line = lambda k, dx: [(k * 10 + i, f"w{i}", 45.0 + 90 * i + dx, 30.0 * k, 120.0 + 90 * i + dx, 30.0 * k + 15) for i in range(4)]
    long = [w for k in range(10_000) for w in line(k, 0.0)]
    piled = [(k * 1000 + n, *w[1:]) for n in range(1000) for k, w in enumerate(w for j in range(12) for w in line(j, 0.0))]
    for words, rows in ((long, 10_000), (piled, 12)):
        ws = table([[dict(zip(("word_idx", "text", "x0", "y0", "x1", "y1"), w, strict=True)) for w in words]])
        start = time.perf_counter()
        p = layout.Pages(ws)
        assert len(p.rows(0.6, layout.ROWS)[0]) == rows and p.slope[0] == 0
        assert time.perf_counter() - start < 5


def test_words_without_text_or_box(spark):
    rows = [(1, 0, "A", 0.0, 0.0, 9.0, 9.0), (1, 1, None, 1.0, 1.0, 2.0, 2.0), (1, 2, "B", None, 0.0, 30.0, 9.0), (2, 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "receipt_id int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.receipt_id: [x.text for x in r.rows] for r in receipt.page_rows(df).collect()}
    assert got == {1: ["A"], 2: []}
    parsed = {r.receipt_id: r for r in receipt.parse(df).collect()}
    assert parsed[2].n_items == 0 and parsed[2].total is None and receipt.parse(df.limit(0)).isEmpty()
    assert {r.receipt_id: (r.line_height, r.slope) for r in receipt.slopes(df).collect()} == {1: (9.0, 0.0), 2: (1.0, 0.0)}


@pytest.mark.parametrize("frames", [0, 3])
def test_receipts_stay_together_from_the_source_on(spark, sf, frames):
    """Neither a shuffle nor a sort of words, and the same rows."""
    w = words.words(spark, sf, frames)
    w = words.degraded(w, frames) if frames else w
    got, want = receipt.rows(w, together=True).drop("words"), receipt.rows(w).drop("words")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(got) and "Sort [receipt_id" not in plan(got) and "Repartition" in plan(want)
    if frames:
        plain = receipt.rows(words.degraded(words.words(spark, sf), frames)).drop("words")
        assert plain.count() == got.count() and plain.exceptAll(got).isEmpty()


def test_trees_are_walked_once(spark, sf):
    plan = __spark_entry__.queries()["q39_flatten_words"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2  # bills and items, each once
