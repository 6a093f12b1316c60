"""Alignment, seeds and the rate of stray words against plain versions, without Spark."""

import random

import numpy as np

from tillproof.llm import decontaminate, toxicity


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_table():
    draw = random.Random(3)
    a = [[draw.randrange(5) for _ in range(8)] for _ in range(40)]
    b = [[draw.randrange(5) for _ in range(14)] for _ in range(40)]
    value, _ = decontaminate.align(np.array(a, np.int32), np.array(b, np.int32))
    assert value.tolist() == [plain_alignment(x, y) for x, y in zip(a, b, strict=True)]


def test_exact_and_edited_copies_are_found_and_other_texts_are_not():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(draw.choices(words, k=30))) for i in range(20)]
    texts = []
    for _, text in items:
        own = text.split()
        own[7], own[21] = "other", "more"
        texts += [" ".join([*draw.choices(words, k=50), *x, *draw.choices(words, k=50)]) for x in (text.split(), own)]
    texts += [" ".join(draw.choices(words, k=130)) for _ in range(40)] + ["", "w1", "w1 w2"]
    known = decontaminate.Items(items)
    number, of = decontaminate.Numbers(known.vocabulary).words(texts)
    known.seed(np.bincount(number[number >= 0], minlength=len(known.vocabulary)), len(number), len(texts), 0.5, 6)
    found = {(m[0], known.ids[m[1]]) for m in decontaminate.matches(known, number, of, 0.45)}
    assert found == {(2 * i + k, i) for i in range(20) for k in (0, 1)}


def counts(hit, hand, n):
    s = np.zeros((len(n), toxicity.LEXICONS + 6))
    s[:, 0], s[:, toxicity.LEXICONS + 1], s[:, toxicity.LEXICONS + 4] = hit, hand, n
    return s


def test_stray_rate_lies_between_chance_and_toxic_texts():
    s = counts([1, 1, 1, 2, 3, 4], 0, [1000, 800, 900, 100, 100, 100])
    assert 1 / 800 <= toxicity.stray_rate(s, np.array([0, 0, 0, 1, 1, 1])) < 0.02
    assert toxicity.stray_rate(s, np.array([1, 1, 1, 1, 1, 1])) == 0
    assert toxicity.stray_rate(s, np.zeros(6, int)) == 0
    assert toxicity.stray_rate(counts([], [], []), np.zeros(0, int)) == 0


def test_a_listed_insult_is_never_stray():
    v = toxicity.votes(counts([1, 1], [0, 1], [10_000, 10_000]), 0.003)
    clean = toxicity.LEXICONS + 5
    assert v[:, 0].tolist() == [-1, 1] and v[:, clean].tolist() == [0, -1]
