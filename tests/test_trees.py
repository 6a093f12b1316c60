"""Plain trees that Python's parser reads against the same trees as a VARIANT."""

import json
import random

import pyarrow as pa
from test_words import BOX, tree

from tillproof.sources import trees, words

GOOD = {"text": "a", "bbox": {"x0": 0, "y0": 0.5, "x1": 1e2, "y1": 12.345678901234567}, "confidence": 90}
ODD = [
    '{"words":[],"words":[]}', '{"a":1,"words":[]', '{"words":[]} x', "[NaN]", "[-0]", "[1e999]", "﻿[]", "[" * 700 + "]" * 700, "[" * 1500 + "]" * 1500, "[" + "1" * 1200 + "]", '{"' + "k" * 60_000 + '":1}',
    *(json.dumps({"words": [GOOD | change]}) for change in (
        {"bbox": {}}, {"bbox": BOX | {"x0": "1"}}, {"bbox": BOX | {"x0": True}}, {"bbox": BOX | {"y1": None}}, {"bbox": BOX | {"z": 1}}, {"bbox": BOX | {"x0": 10**30}}, {"bbox": BOX | {"x0": -0.0}}, {"bbox": [1]}, {"bbox": 0}, {"bbox": False},
        {"confidence": -0.0}, {"confidence": 2**60}, {"confidence": "9"}, {"confidence": 1e300}, {"text": "  "}, {"text": " \u0085"}, {"text": "x \u0085"}, {"text": "é"}, {"text": '"]['}, {"text": "😀"},
    )),
    '{"words":[{"text":"\\ud800","bbox":{"x0":1,"y0":1,"x1":1,"y1":1}}]}',
]


def test_plain_trees_are_read_as_a_variant_would(spark):
    rnd = random.Random(21)
    cases = [*ODD, *(json.dumps(tree(rnd, rnd.randrange(6))) for _ in range(300)), *(json.dumps([{"words": [GOOD | {"text": f"w{k}"} for k in range(n)]}]) for n in (1, 5, 400))]
    rows = [(i, t, f"[{t},-0]") for i, t in enumerate(cases)]  # a signed zero leaves a tree to the VARIANT
    df = spark.createDataFrame(rows, "receipt_id int, tree string, sure string")
    one, two = ({r.receipt_id: (r.readable, r.ws) for r in words.word_lists(df, c).collect()} for c in ("tree", "sure"))
    for i, t in enumerate(cases):
        if not t.startswith("﻿") and not t.endswith(" x") and len(t) < 1400:  # inside a list these are something else
            assert repr(one[i]) == repr(two[i]), t[:200]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(cases))), "tree": cases})
    (out,) = trees.read(iter([batch]))
    whole = out.column("whole").to_pylist()
    assert sum(whole[len(ODD) :]) > 100 and whole[-3:] == [True] * 3 and out.column("left")[len(cases) - 1].as_py() is None
    assert [w["text"] for w in out.column("found")[len(cases) - 1].as_py()] == [f"w{k}" for k in range(400)]


def test_a_trees_words_need_no_row_of_their_own(spark, sf):
    from tillproof.plans import queries

    plan = queries.QUERIES["q39_flatten_words"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(ws" not in plan and plan.count("MapInArrow") == 1
