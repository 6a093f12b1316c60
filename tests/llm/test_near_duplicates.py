"""Groups of near-duplicates against all pairs by brute force."""

import random

import numpy as np
import pytest

from tillproof.llm import simhash


def plain_groups(texts):
    """Of each text the least number it reaches by links of Jaccard similarity 0.8 of its five-word shingles."""
    sets = []
    for text in texts:
        w = text.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def found_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    group = {r.doc_id: r.group_id for r in rows}
    least = {}
    for i in range(len(texts)):
        least.setdefault(group[i], i)
    return [least[group[i]] for i in range(len(texts))]


def edited(draw, base, share):
    out = list(base)
    for k in draw.sample(range(len(out)), round(share * len(out))):
        out[k] = f"e{draw.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_a_large_group_of_unevenly_edited_copies_stay(spark, seed):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [edited(draw, base, draw.uniform(0, 0.05)) for _ in range(300)]
    own = plain_groups(texts)
    assert 1 < len(set(own)) < 250
    assert found_groups(spark, texts) == own


def test_short_texts_and_texts_at_the_limit(spark):
    draw = random.Random(7)
    texts = ["", " ", "a", "a b", "a b c d e", "a b c d e f"]
    for n in (8, 9, 12, 13, 20, 50, 200):  # the longer of two texts has a quarter more shingles: exactly 0.8
        for _ in range(60):
            w = [f"w{draw.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(w), " ".join([*w, *(f"x{draw.randrange(10**9)}" for _ in range((n - 4) // 4))])]
    own = plain_groups(texts)
    assert len(set(own)) < 0.55 * len(texts)
    assert found_groups(spark, texts) == own


def test_parities_never_leave_out_a_similar_pair():
    draw = np.random.default_rng(11)
    sets = []
    for n in (1, 2, 5, 31, 32, 33, 60, 100, 127, 129, 200):
        base = draw.integers(0, 2**63, n, dtype=np.uint64)
        for more in (0, n // 8, n // 4, n // 3, n):
            less = draw.choice(base, n - draw.integers(0, n // 6 + 1), replace=False)
            sets.append(np.unique(np.concatenate([less, draw.integers(0, 2**63, more, dtype=np.uint64)])))
    bits, n = [np.frombuffer(simhash.parities(x), np.uint64) for x in sets], np.array([len(x) for x in sets])
    part = draw.integers(0, 40, len(sets))
    near = simhash.near_some(bits, n, part, 0.8, words=64)
    for i, x in enumerate(sets):
        others = [set(y.tolist()) for j, y in enumerate(sets) if part[j] != part[i]]
        own = set(x.tolist())
        if any(5 * len(own & y) >= 4 * len(own | y) for y in others):
            assert near[i]
    assert not near.all()
    alone = [np.unique(draw.integers(0, 2**63, 1500, dtype=np.uint64)) for _ in range(50)]
    few = simhash.near_some([np.frombuffer(simhash.parities(x), np.uint64) for x in alone], np.array([len(x) for x in alone]), np.arange(50), 0.8)
    assert not few.any()


def test_long_texts_that_only_share_a_passage_and_edited_copies_among_them(spark):
    draw = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        w = [f"w{draw.randrange(10**9)}" for _ in range(draw.randrange(250, 320))]
        at = draw.randrange(len(w))
        w = w[:at] + passage + w[at:]
        texts += [" ".join(w), edited(draw, w, 0.01)] if draw.random() < 0.3 else [" ".join(w)]
    own = plain_groups(texts)
    assert 50 < len(set(own)) < len(texts)
    assert found_groups(spark, texts) == own


def test_groups_come_through_simhashes_and_what_these_miss_through_shingles(spark, monkeypatch):
    draw = random.Random(3)
    texts = []
    for share in (0.002, 0.02):  # one edited word among 500, or ten of them: hardly a bit apart, or more than the radius
        for _ in range(20):
            w = [f"w{draw.randrange(10**9)}" for _ in range(500)]
            texts += [" ".join(w), edited(draw, w, share)]
    links, told = simhash.tile_links, []

    def counted(*given, **more):
        out = simhash.written(links(*given, **more), "counted")
        told.append(out.count())
        return out

    monkeypatch.setattr(simhash, "tile_links", counted)
    own = plain_groups(texts)
    assert len(set(own)) == 40 and found_groups(spark, texts) == own
    assert 5 <= told[0] < 40 and sum(told) == 40
    monkeypatch.setattr(simhash, "print_groups", lambda classes, radius: classes.select(classes.number.alias("hub"), "number", "n").limit(0))
    told.clear()
    assert found_groups(spark, texts) == own and told[0] == 0


def test_the_simhash_of_a_set_is_that_of_its_hashes_in_one():
    own = np.random.default_rng(4).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
    for n in (0, 1, 2, 999, 1000):
        assert np.int64(simhash.set_print(own[:n], 128)).view(np.uint64) == simhash.majority(own[:n], np.array([n]))[0]
