"""Streaks against a loop, and how often consensus sorts."""

import random

from tillproof.operators import consensus

FRAMES = "session_id int, frame_no int, n_items long, items_sum long, items_key string, subtotal long, tax long, tip long, total long"


def test_streaks_equal_a_loop(spark):
    rnd = random.Random(4)
    rows = [(s, f, rnd.choice([None, 1, 1, 1, 2])) for s in range(40) for f in range(1, rnd.randrange(2, 30))]
    df = spark.createDataFrame(rows, "session_id int, frame_no int, value int")
    got = {(r.session_id, r.frame_no): (r.s, r.h) for r in consensus.run_length(consensus.streak(df, "value", "s"), df.value == 1, "h").collect()}
    last, n, h = {}, {}, {}
    for s, f, v in sorted(rows):
        n[s] = 0 if v is None else n.get(s, 0) + 1 if last.get(s) == v else 1
        h[s] = h.get(s, 0) + 1 if v == 1 else 0
        last[s] = v
        assert got[s, f] == (n[s], h[s])


def test_one_exchange_and_one_sort(spark):
    frames = spark.createDataFrame([(1, 1, 1, 1000, "1000", 1000, 80, 200, 1280)], FRAMES)
    plan = consensus.sessions(frames)._jdf.queryExecution().sparkPlan().toString()
    executed = consensus.sessions(frames)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and executed.count("Sort [") == 1 and executed.count("Exchange hashpartitioning") == 1
