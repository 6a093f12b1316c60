"""Connected components of long chains."""

import random

from tillproof.llm import simhash


def test_chains_are_followed_to_their_ends(spark):
    draw = random.Random(5)
    links, want = [(7_000, 7_000)], {}
    for first, n in ((0, 400), (1_000, 2_000), (5_000, 2)):
        ids = list(range(first, first + n))
        want |= dict.fromkeys(ids, first)
        draw.shuffle(ids)
        links += [(x, y) if draw.random() < 0.5 else (y, x) for x, y in zip(ids, ids[1:])]
    got = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = [r for r in got if r.v != 7_000]
    assert len(got) == len(want) and {r.v: r.root for r in got} == want


def test_no_links(spark):
    assert simhash.components(spark.createDataFrame([], "a string, b string")).count() == 0
