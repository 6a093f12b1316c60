"""The language model's distribution, and its training, without Spark."""

import numpy as np

from tillproof.llm import maxent_lm as lm


def test_codes_and_the_words_of_a_code_sum_to_one():
    draw = np.random.default_rng(1)
    size = lm.Size(3, 12)
    w = lm.Weights(size, draw.normal(size=(3, 1 << 12, lm.FAN)).astype(np.float32))
    for _ in range(3):
        outcomes = np.array([*range(size.heads), *range(size.heads, size.codes, lm.FAN)], np.int32)  # shared codes have a level less
        f = np.repeat(draw.integers(0, 1 << 63, (1, lm.FEATURES), dtype=np.uint64), len(outcomes), 0)
        p = np.exp(w.log_prob(f, outcomes))
        assert abs(p.sum() - 1) < 1e-3 and (p > 0).all()
    c = np.array([1, 1, 5, 90])
    lam = lm.unseen_share(np.array([c.sum()]), np.array([2]))[0]
    assert abs(((1 - lam) * c / c.sum()).sum() + lam - 1) < 1e-12 and lm.unseen_share(np.zeros(1), np.zeros(1)) == 0.5


def test_words_get_codes_in_range_and_sizes_follow_the_vocabulary():
    for v, levels in ((0, 3), (100_000, 3), (5_000_000, 4), (1 << 40, 4)):
        size = lm.Size.of(v, 4, 1 << 18)
        assert size.levels == levels and 16 <= size.row_bits <= 18
        codes = [lm.shared_code(t, levels) for t in (b"", b"a", b"walking", b"x1", "é".encode(), "你好".encode())]
        assert all(size.heads <= c < size.codes and c % lm.FAN == 0 for c in codes)


def test_update_equals_a_plain_loop():
    draw = np.random.default_rng(2)
    size = lm.Size(3, 8)
    t = lm.Trainer(size)
    t.w.tables[:] = draw.normal(size=t.w.tables.shape)
    w, s = t.w.tables[1].copy(), t.sums[1].copy()
    rows, gold = draw.integers(0, 256, (300, lm.FEATURES)), draw.integers(0, lm.FAN, 300)
    total = np.zeros_like(w, np.float64)
    for r, g in zip(rows, gold):
        z = np.exp(w[r].sum(0).astype(np.float64))
        for x in r:
            total[x] += np.eye(lm.FAN)[g] - z / z.sum()
    used = np.unique(rows)
    s[used] += (total[used] ** 2).mean(1)
    w[used] += (t.rate / lm.FEATURES * total[used] / np.sqrt(s[used])[:, None]).astype(np.float32)
    t.update(1, rows, gold)
    assert np.allclose(t.w.tables[1], w, atol=1e-3) and np.allclose(t.sums[1], s, rtol=1e-3)


def test_training_beats_counts_on_a_regular_text():
    texts = ["one two three four five six seven eight nine ten"] * 400
    lists = [lm.tokens(t) for t in texts]
    heads = {t: i for i, t in enumerate(dict.fromkeys(w for own in lists for w in own))}
    size = lm.Size(3, 16)
    trainer, feature = lm.Trainer(size), lm.Features(heads, size)
    f, rows, _ = feature.inputs(lists)
    for _ in range(5):
        trainer.learn(f, feature.code.a[rows])
    assert np.exp(trainer.w.log_prob(f, feature.code.a[rows])).mean() > 0.5


def test_a_step_adds_up_many_rows_without_loss():
    size = lm.Size(3, 8)
    t = lm.Trainer(size)
    n = 1 << 20
    gold = np.zeros(n, np.int64)
    gold[: n // 2] = 1
    t.update(0, np.tile(np.arange(lm.FEATURES), (n, 1)), gold)
    each = float(np.float32(1 / lm.FAN))
    total = np.full(lm.FAN, -each * n)
    total[:2] += n // 2
    expected = 1e-2 + (total**2).mean()
    assert np.allclose(t.sums[0][: lm.FEATURES], expected, rtol=1e-6)
    assert np.allclose(t.w.tables[0][: lm.FEATURES], t.rate / lm.FEATURES * total / np.sqrt(expected), rtol=1e-6)
