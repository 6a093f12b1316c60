"""The whole search against an alignment of every text with every item."""

import random

from test_plain_versions import plain_alignment

from tillproof.llm import decontaminate


def test_leaks_equal_all_alignments(spark):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    items = [(float(i), " ".join(draw.choices(words, k=draw.randrange(5, 30)))) for i in range(12)] + [(20.0, "Yes."), (21.0, "two words"), (22.0, ""), (23.0, None), (None, " ".join(draw.choices(words, k=12)))]
    texts = ["", None, "yes", "Two, words!", "yes yes", "two words more"]
    for _, text in items[:12]:
        own = text.split()
        for edits in (0, 1, 3):
            new = list(own)
            for k in draw.sample(range(len(new)), min(edits, len(new) // 4)):
                new[k] = draw.choice(["other", ""])
            texts.append(" ".join([*draw.choices(words, k=draw.randrange(40)), *new, *draw.choices(words, k=draw.randrange(40))]))
    texts += [" ".join(draw.choices(words, k=60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id double, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        a = decontaminate.words_of(t or "")
        for k, item in items:
            b = decontaminate.words_of(item or "")
            if 0 < len(b) < 3:
                if a == b:
                    want[i, k] = 1.0
            elif b and (score := plain_alignment(b, a) / (2 * len(b))) >= 0.45:
                want[i, k] = score
    sure = {p for p, s in want.items() if s >= 0.6}
    assert sure <= set(got) <= set(want) and len(sure) > 30
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
