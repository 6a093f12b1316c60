"""Every stage of the pipeline on odd rows, and whole runs on tables without rows."""

import pytest
from pyspark.sql import Row

import corpus_pipeline

CLEAN = "the weather was mild in the valley and the river ran slowly past the old mill"
ITEM = "which of the following gases is produced in the largest amount by green plants during the day"
TOXIC = "you are a pathetic idiot and a worthless moron you stupid loser"
CLASHES = ["score", "predicted", "lang_pred", "_text_hash", "_k", "_h", "_bad", "row", "own_key", "k", "h", "a b.c"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("pipeline"))
    for name in ("labels", "documents"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{to}/{name}.parquet")
    spark.createDataFrame([(1.5, ITEM), (None, None), (2.5, ""), (3.5, "yes")], "item_id double, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, CLEAN), (1, f"so he asked: {ITEM}?"), (2, TOXIC), (3, None), (4, ""), (5, CLEAN), (None, CLEAN.replace("mill", "bridge over there")), (None, f"{ITEM} and more"), (6, "Yes!"), (7, "12 34 --- 56"), (8, "long text with many words " * 20_000), (3, None)]
    rows = [Row(doc_id=None if i is None else 10**6 + i, text=t, lang="en", source=None, n_chars=len(t or ""), **{c: f"{c}{k}" for c in CLASHES}) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


STAGES = dict(corpus_pipeline.STAGES)


def kept(spark, name, docs, folder):
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    return sorted(int(r["score"].removeprefix("score")) for r in out.collect())


def test_toxicity(spark, docs, folder):
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    out = STAGES["toxicity"](spark, docs.select(known.columns).union(known), folder).where("doc_id > 1000000 or doc_id is null").collect()
    texts = [r.text for r in out]
    assert TOXIC not in texts and texts.count(None) == 2 and "" in texts and texts.count(CLEAN) == 2
    assert kept(spark, "toxicity", docs, folder) == [k for k in range(12) if k != 2]


def test_language(spark, folder, docs):
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    out = STAGES["language"](spark, docs.select(known.columns).union(known), folder).collect()
    texts = [r.text for r in out]
    assert "" not in texts and None not in texts and "12 34 --- 56" not in texts and texts.count(CLEAN) == 2
    assert kept(spark, "language", docs.where("lang is null"), folder) == []


def test_near_duplicates(spark, docs, folder):
    own = kept(spark, "near_duplicates", docs, folder)
    assert {0, 5} & set(own) == {0} and len({3, 4, 11} & set(own)) == 1 and {1, 2, 7, 8, 9, 10} <= set(own)


def test_benchmark_goes_by_the_row_not_by_the_id(spark, docs, folder):
    assert kept(spark, "benchmark", docs, folder) == [0, 2, 3, 4, 5, 6, 9, 10, 11]


def test_tokens(spark, docs, folder):
    got = STAGES["tokens"](spark, docs, folder).collect()
    assert len(got) == docs.count() and all(r.lossless for r in got)
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]


@pytest.mark.parametrize("name", list(STAGES))
def test_no_documents(spark, docs, folder, name):
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0


def test_empty_tables(spark, docs, folder, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert kept(spark, "benchmark", docs, str(tmp_path)) == list(range(12))
    assert 2 not in kept(spark, "toxicity", docs, str(tmp_path))
