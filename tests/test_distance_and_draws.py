"""Edit distances against the plain table, and draws against their sequence."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillproof.functions import distance, draws


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abé🎉", max_size=90), st.text("abé🎉", max_size=90))
@settings(max_examples=300, deadline=None)
def test_edits_equal_the_plain_table(a, b):
    assert distance.edits(a, b) == distance.edits(b, a) == plain(a, b)


@pytest.mark.parametrize("n", [63, 64, 65, 128, 700, 1500])
def test_lengths_around_whole_words(n):
    rnd = random.Random(n)
    a = "".join(rnd.choice("abcd ") for _ in range(n))
    b = "".join(c for c in (rnd.choice([x, x, x, x, "", x + "z", "y"]) for x in a))
    assert distance.edits(a, b) == plain(a, b)


def test_whole_documents(spark, sf):
    import __spark_entry__

    got = __spark_entry__.queries()["q56_document_accuracy"](spark, sf)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == d.count()
    short = d.where("length(text) < 3000").select("doc_id", F.trim(F.regexp_replace(F.upper("text"), r"\s+", " ")).alias("a"), F.trim(F.regexp_replace(F.upper(F.translate("text", "aeo", "o0")), r"\s+", " ")).alias("b"))
    both = short.withColumn("want", F.levenshtein("a", "b")).join(got, "doc_id")
    assert both.count() > 100 and both.where("want != distance").isEmpty()


def test_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("", "ab"), ("kitten", "sitting")], "a string, b string")
    assert [r.d for r in df.select(distance.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [None, None, 2, 3]


def test_draws_jump_to_where_the_sequence_gets(spark):
    want = {}
    for seed in (0, 1, 12345, 2**31 - 1, 2**31 + 7, -5):
        s = seed & draws.MASK
        for k in range(300):
            want[seed, k] = s
            s = (s * draws.A + draws.C) & draws.MASK
    df = spark.createDataFrame(list(want), "seed long, k int").select("seed", "k", draws.state(F.col("seed"), F.col("k")).alias("s"), draws.draw(F.col("seed"), F.col("k")).alias("d"))
    assert all(r.s == want[r.seed, r.k] and 0 <= r.d <= 1 for r in df.collect())


def test_bands_of_long_texts_equal_a_plain_table(monkeypatch):
    """Guesses that hold and guesses that don't: edits at random, at one end only, a part moved, nothing in common."""
    monkeypatch.setattr(distance, "PROBE", 16)
    draw = random.Random(12)
    for k in range(120):
        letters = draw.choice(["ab", "abcdefgh ", "aé漢😀"])
        a = "".join(draw.choice(letters) for _ in range(draw.randrange(33, 220)))
        cut = draw.randrange(len(a))
        b = [a[cut:] + a[:cut], a[:cut] + "".join(draw.choice(letters) for _ in range(60)), "".join(draw.choice("xyz") for _ in a), "".join(c for c in a if draw.random() > 0.1)][k % 4]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, above = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        assert distance.edits(a, b) == distance.edits(b, a) == row[-1]


def test_windows_are_as_narrow_as_the_distance(monkeypatch):
    """A long text and a copy with one edit in a hundred characters: no window has a tenth of the rows."""
    draw, seen, plain = random.Random(3), [], distance.in_band
    a = "".join(draw.choice("abcdefgh ") for _ in range(40_000))
    b = "".join(c if draw.random() > 0.01 else "z" for c in a)
    monkeypatch.setattr(distance, "in_band", lambda here, m, b, most: seen.append(most / m) or plain(here, m, b, most))
    assert 0 < distance.edits(a, b) <= sum(x != y for x, y in zip(a, b, strict=True))
    assert min(seen) < 0.1 and len(seen) <= 3
