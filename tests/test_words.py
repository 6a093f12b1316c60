"""Words out of recognisers' trees of any layout."""

import json
import random

from tillproof.sources import words

BOX = {"x0": 1, "y0": 2.5, "x1": 3, "y1": 4}


def walk(root) -> list[tuple]:
    """The same walk, node by node."""
    if isinstance(root, list):
        return [w for x in root for w in walk(x)]
    if not isinstance(root, dict):
        return []
    if isinstance(root.get("words"), list):
        out = []
        for w in root["words"]:
            text = w["text"].strip() if isinstance(w.get("text"), str) else ""
            box, sure = w.get("bbox"), w.get("confidence")
            if text and (box or box in ({}, [])) and box is not False:
                sure = float(sure) if isinstance(sure, (int, float)) and not isinstance(sure, bool) else 0.0
                own = box if isinstance(box, dict) else {}
                out.append((text, *(own.get(k) for k in ("x0", "y0", "x1", "y1")), sure))
        return out
    return [w for k in ("blocks", "paragraphs", "lines", "children") if k in root for w in walk(root[k])]


def tree(rnd: random.Random, depth: int):
    kind = rnd.random()
    if depth == 0 or kind < 0.25:
        return {"words": [word(rnd) for _ in range(rnd.randrange(4))]} | ({"lines": [{"words": [word(rnd)]}]} if rnd.random() < 0.3 else {})
    if kind < 0.35:
        return rnd.choice([None, 5, "words", True, {}, {"words": None}, {"words": "x", "lines": [{"words": [word(rnd)]}]}])
    if kind < 0.5:
        return [tree(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    keys = rnd.sample(["blocks", "paragraphs", "lines", "children", "symbols"], rnd.randint(1, 3))
    return {k: [tree(rnd, depth - 1) for _ in range(rnd.randrange(3))] if rnd.random() < 0.8 else tree(rnd, depth - 1) for k in keys}


def word(rnd: random.Random) -> dict:
    out = {"text": rnd.choice([f"w{rnd.randrange(99)}", f" w{rnd.randrange(9)}\t", "é 5.00", "", "  ", 7, None, ["x"]]), "bbox": rnd.choice([BOX, BOX, BOX, {}, None, 0, "", False, [1]]), "confidence": rnd.choice([90, 55.5, "high", None, True])}
    return {k: v for k, v in out.items() if rnd.random() < 0.9}


def test_any_layout_gives_its_words_in_order(spark):
    rnd = random.Random(8)
    trees = [tree(rnd, rnd.randrange(7)) for _ in range(800)]
    inner = {"words": [{"text": "deep", "bbox": BOX}]}
    for k in range(120):
        inner = {"children": [inner]} if k % 2 else [inner]
    trees.append(inner)
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "receipt_id int, tree string")
    got = {r.receipt_id: r for r in words.word_lists(df).collect()}
    for i, t in enumerate(trees):
        own = [(w.text, w.bbox.x0, w.bbox.y0, w.bbox.x1, w.bbox.y1, w.confidence) for w in got[i].ws]
        assert got[i].readable and own == walk(t), t
    assert sum(len(walk(t)) for t in trees) > 200
    assert words.flatten(df).count() == sum(len(walk(t)) for t in trees)


def test_trees_without_words_are_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "{}"), (5, "null"), (6, '{"words":[]}')], "receipt_id int, tree string")
    got = {r.receipt_id: r for r in words.word_lists(df).collect()}
    assert [got[i].readable for i in range(1, 7)] == [False, False, False, True, True, True] and all(r.ws == [] for r in got.values())


def test_every_layout_holds_the_same_words(spark, sf):
    from pyspark.sql import functions as F

    w = words.words(spark, sf).where("receipt_id < 60").select("receipt_id", "word_idx", "text", "x0", "y0", "x1", "y1", "confidence")
    want = w.withColumn("word_idx", F.expr("row_number() over (partition by receipt_id order by word_idx) - 1"))
    for k in range(8):
        got = words.flatten(words.to_tree(w, F.lit(k))).select(want.columns)
        assert got.count() == want.count() and want.exceptAll(got).isEmpty(), k
