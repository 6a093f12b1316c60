"""A corpus from raw documents: toxic texts and texts of no language go, one of each group of near-duplicates
stays, texts that hold benchmark items go, and the rest is encoded to token ids and decoded.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillproof.llm import byte_bpe, decontaminate, langid, simhash, toxicity
from tillproof.llm.common import table, written

#: A text of less certain language is rejected.
LEAST_LANGUAGE_SCORE = 0.35
#: Stretches of text that a worker's encoder remembers; workers stay from run to run, beside what other stages need.
REMEMBERED = 200_000


def carried(docs: DataFrame, *also: str) -> DataFrame:
    """A row as one struct beside what a stage reads, so that columns of any name and number come through."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", *also)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the toxicity classifier predicts as toxic.

    Null and empty texts hold nothing toxic and stay; rows of equal or null ids are judged by their own texts; without
    labels only the listed insults speak; no documents give none.
    """
    labels = table(spark, sf_dir, "labels")
    return toxicity.toxicity(carried(docs), labels, keep=("row",)).where("predicted = 0").select("row.*")


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose language is hardly more than a guess.

    Null and empty texts have no letter and go; rows with null languages are judged, but teach nothing; without any
    language to learn from every text goes; rows of equal or null ids are judged by their own texts.
    """
    found = langid.languages(carried(docs, "lang"), keep=("row",))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more.

    The row of the least id (nulls first), then text hash, stays; null and empty texts are equal texts without
    shingles, so one of them stays; of rows that agree in id and text one stays.
    """
    return simhash.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that hold a benchmark item, edited or not.

    Each row goes or stays by its own text, whatever its id; null and empty texts and empty items match nothing; without
    items all stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text and decodes the ids again.

    A row for each document, of equal or null ids too; null and empty texts have no ids; texts of any length are whole.
    """
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, limit=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("language", language_known),
    ("near_duplicates", near_duplicates_out),
    ("benchmark", benchmark_out),
    ("tokens", tokens),
]

#: SQL can't express the trained stages; tests hold the pipeline against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
