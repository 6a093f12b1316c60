"""The queries op1 to op10 against plain versions, over the smallest tables and over awkward rows."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash

import __spark_entry__

Q = __spark_entry__.queries()
AWKWARD = [
    (1, None, None, "a", "x"),
    (2, "", "en", None, "x"),
    (3, "    \t\n", None, None, None),
    (4, "MIT License. mit  license! The Apache-License, GENERAL public license", "en", "a", "x"),
    (5, "é ß 你好 🎉 \x00 naïve", "fr", "b", None),
    (6, "the of and " * 30_000, "en", "a", "x"),
    (7, "the of and " * 30_000, "en", "a", "x"),
    (8, "x" * 200_000, "en", "a", "x"),
    (9, "one two", "de", "b", "x"),
    (10, " und der die das ", "de", "b", "x"),
    (11, None, None, None, None),
]


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="session", params=["small", "awkward", "empty"])
def folder(request, spark, sf, tmp_path_factory):
    """A table folder: the smallest one, one of odd rows with a column too many, and one without documents."""
    if request.param == "small":
        return sf
    to = str(tmp_path_factory.mktemp(request.param))
    rows = AWKWARD if request.param == "awkward" else []
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").write.parquet(f"{to}/documents.parquet")
    for name in ("labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{to}/{name}.parquet")
    return to


@pytest.fixture(scope="session")
def docs(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, folder, number: int) -> pd.DataFrame:
    name = next(n for n in Q if n.startswith(f"op{number}_"))
    return Q[name](spark, folder).toPandas()


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def test_op1(spark, folder, docs):
    got = run(spark, folder, 1).set_index("doc_id")
    assert sorted(got.index) == sorted(docs)
    counts = Counter(w for i, t in docs.items() if crc(i) % 10 for w in [*words(t), None])
    total = sum(counts.values())
    for i, text in docs.items():
        own, r = [*words(text), None], got.loc[i]
        assert r.n_tokens == len(own) and r.n_known == sum(counts[w] > 0 for w in own)
        assert r.train_tokens == total and r.held_out == (crc(i) % 10 == 0)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-9


def test_op1_beats_the_base_on_held_out_texts(spark, sf):
    got = run(spark, sf, 1)
    got = got[got.held_out]
    assert got.score.sum() > got.base_score.sum()


def test_op2(spark, folder, docs):
    got = run(spark, folder, 2).set_index("doc_id")
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(got.index) == sorted(docs)
    start = 0
    for i in sorted(docs):
        ids = np.array([*tok.encode(docs[i], add_special_tokens=False).ids, 2], "<u4")
        r = got.loc[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op3(spark, folder, docs):
    got = run(spark, folder, 3).set_index("doc_id")
    assert sorted(got.index) == sorted(docs)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, text in docs.items():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(k, n) for k in range(len(own)) for p, n in phrases.items() if own[k : k + len(p.split())] == p.split()]
        r = got.loc[i]
        assert (r.n_words, r.n_base) == (len(own), len(places))
        assert r.base_labels == ",".join(sorted({n for _, n in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if places:
            assert (r.first_word, r.last_word) == (min(places)[0], max(places)[0])
        else:
            assert pd.isna(r.first_word) and pd.isna(r.last_word)


def fingerprint(text: str) -> int:
    w = words(text)
    own = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_op5(spark, folder, docs):
    got = run(spark, folder, 5).set_index("doc_id")
    assert sorted(got.index) == sorted(docs)
    memo = {t: fingerprint(t) for t in set(docs.values())}
    prints = {i: memo[t] for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for i in ids:
        assert got.loc[i].fingerprint == f"{prints[i]:016x}" and got.loc[i].component_id == root(i)


def test_op6(spark, folder, docs):
    import base64

    got = run(spark, folder, 6).set_index("doc_id")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f.read().splitlines() if line)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(got.index) == sorted(docs)
    for i, text in docs.items():
        r = got.loc[i]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if len(text) < 100_000:
            ids = np.array(enc.encode_ordinary(text), "<u4")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_op4_op7_and_op10_have_their_rows(spark, folder, docs):
    t, g = run(spark, folder, 7).set_index("doc_id"), run(spark, folder, 10).set_index("doc_id")
    assert sorted(t.index) == sorted(g.index) == sorted(docs)
    assert all(t.held_out[i] == (crc(i) % 4 == 2) and g.held_out[i] == (crc(i) % 5 == 0) for i in docs)
    assert t.score.between(0, 1).all() and g.score.between(0, 1).all() and ((t.score >= 0.3) == (t.predicted == 1)).all()
    assert all((g.lang_pred[i] == "und") == (not any(c.isalpha() for c in x)) for i, x in docs.items())
    leaks = run(spark, folder, 4)
    assert set(leaks.doc_id) <= set(docs)


def test_op7_and_op10_on_held_out_rows(spark):
    larger = "/root/testdata/sf0.01"
    t = run(spark, larger, 7).merge(pd.read_parquet(f"{larger}/labels.parquet"), on="doc_id")
    t = t[t.held_out]
    assert (t.predicted[t.toxic == 0] == 0).mean() > 0.97 and (t.predicted[t.toxic == 1] == 1).mean() > 0.55
    g = run(spark, larger, 10).merge(pd.read_parquet(f"{larger}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    g = g[g.held_out & g.lang.notna()]
    assert (g.lang_pred == g.lang).mean() > 0.97


def test_op8(spark, sf):
    got = run(spark, sf, 8)
    pages = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id")
    assert sorted(got.page_id) == sorted(pages.index)
    assert (got.text.str.len() == got.n_chars).all()
    for r in got.itertuples():
        seen = re.sub(r"\s+", "", html.unescape(re.sub(r"<[^>]*>", "", pages.html[r.page_id])))
        assert all(re.sub(r"\s+", "", line) in seen for line in r.text.split("\n")[:5])


def test_op9(spark, sf):
    got = run(spark, sf, 9)
    v = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    x, ids = np.array(v.embedding.tolist(), np.float64), v.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cos = x @ x[q]
        cos[q] = -9
        best = np.lexsort((ids, -cos))[: min(5, len(ids) - 1)]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, len(best) + 1))
        assert np.allclose(own.score, cos[np.searchsorted(ids, own.vec_id)], atol=1e-12)
        hits, n = hits + len(set(own.vec_id) & set(ids[best])), n + len(best)
    assert n and hits / n >= 0.9


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf).toPandas()
    n = len(pd.read_parquet(f"{sf}/documents.parquet"))
    assert got.doc_id.is_unique and 0.5 * n < len(got) < n
