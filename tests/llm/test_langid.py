"""Forward-backward against all label sequences, chains over long lines, and code-switched text."""

import itertools

import numpy as np
import pandas as pd

from tillproof.llm import langid


def plain(e, trans):
    """Posteriors, expected transitions and the log partition of one chain by enumeration."""
    n, k = e.shape
    post, both, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(e[t, y[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        for t in range(n):
            post[t, y[t]] += w
        for a, b in zip(y, y[1:]):
            both[a, b] += w
    return post / total, both / total, np.log(total)


def test_forward_backward_equals_enumeration_within_and_across_pieces(monkeypatch):
    draw = np.random.default_rng(3)
    for seq in (256, 3, 2, 1):
        monkeypatch.setattr(langid, "SEQ", seq)
        sizes, trans = [5, 1, 7, 2], draw.normal(size=(3, 3))
        kind = np.concatenate([[1] * n + [2] for n in sizes])
        at, start, length, on = langid.sequences(kind)
        e = draw.normal(size=(len(at), 3))
        post, both, log_z = langid.posteriors(e, start, length, on, trans, pairs=True)
        want = [plain(x, trans) for x in np.split(e, np.cumsum(sizes)[:-1])]
        assert np.allclose(post, np.concatenate([w[0] for w in want]))
        assert np.allclose(both, sum(w[1] for w in want)) and np.isclose(log_z, sum(w[2] for w in want))


def test_words_of_code_switched_lines():
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").dropna(subset=["text", "lang"])
    docs = docs[docs.text.str.split().str.len().between(60, 2000)].drop_duplicates("text")
    own = {lang: g.text.tolist() for lang, g in docs.groupby("lang")}
    model = langid.train([(t, lang) for lang, g in own.items() for t in g[10:70]])
    good = total = 0
    langs = sorted(own)
    for i in range(10):
        for a, b in itertools.permutations(langs, 2):
            parts = [(a, own[a][i].split()[:15]), (b, own[b][i].split()[:20]), (a, own[a][i].split()[15:25])]
            gold = [lang for lang, w in parts for x in w if any(map(str.isalpha, x))]
            got = model.word_languages(" ".join(x for _, w in parts for x in w))
            assert len(got) == len(gold)
            good, total = good + sum(x == y for x, y in zip(got, gold)), total + len(gold)
    assert good / total > 0.9, good / total


def test_every_language_is_learned(spark):
    rows = [(i, f"wort{i % 70}a wort{i % 70}b " * 5, f"l{i % 70:02d}") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({y for _, y in langid.sample(docs)}) == 70
    assert max(pd.Series([y for _, y in langid.sample(docs, per_lang=4)]).value_counts()) == 4
    assert len({y for _, y in langid.sample(docs, bound=70)}) == len(langid.sample(docs, bound=70)) == 70
