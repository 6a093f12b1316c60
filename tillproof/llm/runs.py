"""Periodic runs of words by the runs theorem, and texts without their repeated periods.

A run is a stretch of consecutive words with smallest period p, at least two periods long, that neither neighbour
extends. Every run holds a Lyndon word of length p that is the longest Lyndon word at its place under one of two
opposite orders of the words. So the longest Lyndon words at all places, under both orders, are all the candidates:

1. words become codes, and the suffixes of a document are sorted by doubled prefixes; many documents go through the
   same sort, each with an end mark of its own that is smaller than its words;
2. the longest Lyndon word at i ends before the next suffix of smaller rank (next smaller value of the inverse suffix
   array); under the opposite order, before the next one of greater rank, as the end mark is a letter too;
3. common prefixes of neighbours in the suffix array come from the ranks of the doubled prefixes; the least one in a
   range of the array, by a sparse table, is how far two suffixes agree;
4. a root (i, p) is extended to the right by that, and to the left by the least start from which the text still has
   period p up to i, found by halving. Only the leftmost root of a run counts.

Each text is whole in one task; nothing is shuffled. Work is n log n in the words of a text, whatever they repeat.

Null and empty texts have no words and no runs; rows of equal or null ids are rows of their own; an empty table gives
none; other columns are carried only if they are named in `keep`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import in_batches

#: White space between words; a fixed value.
SPACE = r"[\x20\x09-\x0D]+"
RUN = StructType([StructField(k, LongType(), False) for k in ("start", "length", "period")])
#: Words that go through one sort; a longer text goes alone.
SORTED_WORDS = 150_000
HOPS = 48


def sparse_table(a: np.ndarray, widest: int) -> list[np.ndarray]:
    """levels[k][i]: the least of a[i : i + 2**k], up to ranges of `widest`."""
    levels, k = [a], 1
    while 2 * k <= widest and 2 * k <= len(a):
        last = levels[-1]
        levels.append(np.minimum(last[:-k], last[k:]))
        k *= 2
    return levels


def least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of a[lo..hi], both included, for many ranges no longer than the widest one."""
    level = np.minimum(np.frexp((hi - lo + 1).astype(np.float64))[1], len(levels)) - 1
    out = np.empty(len(lo), levels[0].dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        own = levels[k]
        out[at] = np.minimum(own[lo[at]], own[hi[at] - (1 << int(k)) + 1])
    return out


def next_smaller(rank: np.ndarray, widest: int) -> np.ndarray:
    """For each place the next one of smaller rank, len(rank) if there is none.

    Places hop along what is known already; the few that have to hop far halve their way by a sparse table.
    """
    n = len(rank)
    nxt = np.arange(1, n + 1)
    padded = np.append(rank, np.iinfo(rank.dtype).min)
    open_ = np.flatnonzero(padded[1:] > rank)
    for _ in range(HOPS):
        if not len(open_):
            return nxt
        nxt[open_] = nxt[nxt[open_]]
        open_ = open_[padded[nxt[open_]] > rank[open_]]
    levels, at, own = sparse_table(rank, widest), nxt[open_], rank[open_]
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            here = np.flatnonzero(at + (1 << k) <= n)
            skip = here[levels[k][at[here]] > own[here]]
            at[skip] += 1 << k
    while len(more := np.flatnonzero(padded[at] > own)):  # ranges beyond the widest one
        at[more] = nxt[at[more]]
    nxt[open_] = at
    return nxt


class Suffixes:
    """Ranks of the suffixes of codes, and how far two of them agree.

    codes: as find() takes them, so that suffixes of different documents never agree.
    """

    def __init__(self, codes: np.ndarray, widest: int):
        n = len(codes)
        sa = np.argsort(codes)
        rank, unsettled = np.empty(n, np.int64), np.arange(n)
        key, seen = codes[sa], []
        h = 1
        while True:
            first = np.empty(len(unsettled), bool)
            first[:1] = True
            np.not_equal(key[1:], key[:-1], out=first[1:])
            starts = np.flatnonzero(first)
            group = np.repeat(starts, np.diff(np.append(starts, len(unsettled))))
            rank[sa[unsettled]] = unsettled[group]
            alone = first & np.append(first[1:], True)
            unsettled = unsettled[~alone]
            if not len(unsettled):
                break
            # Places that agree with another one for h words, by place: their class; the others agree with none.
            at = sa[unsettled]
            classes = np.full(n, -1, np.int32)
            classes[at] = rank[at]
            seen.append((h, classes))
            key = rank[at] * n + rank[at + h]
            order = np.argsort(key)
            sa[unsettled], key = at[order], key[order]
            h *= 2
        self.rank, self.n = rank, n
        a, b = sa[:-1].copy(), sa[1:].copy()
        common, live = np.zeros(n, np.int32), np.arange(1, n)
        for h, classes in reversed(seen):
            x, y = classes[a], classes[b]
            hit = live[(x == y) & (x >= 0)]
            common[hit] += h
            a[hit - 1] += h
            b[hit - 1] += h
        self.levels = sparse_table(common, widest)

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal, for many pairs of different places of one document."""
        x, y = self.rank[i], self.rank[j]
        return least(self.levels, np.minimum(x, y) + 1, np.maximum(x, y))


def find(codes: np.ndarray, widest: int, shortest: int, periods: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs of at least `shortest` places and `periods` periods, by start, then period.

    codes: of all documents one after the other, each ended by its own smallest code, ascending by document.
    """
    s = Suffixes(codes, widest)
    here = np.arange(s.n)
    found = []
    for rank in (s.rank, -s.rank):
        to = next_smaller(rank, widest)
        i = here[to < s.n]
        j = to[i]
        ok = codes[i] == codes[j]
        i, j = i[ok], j[ok]
        p = j - i
        right = s.agree(i, j)
        # With less than a period to its left, the leftmost root of a run that is long enough reaches so far.
        want = np.maximum(shortest, periods * p)
        ok = 2 * p - 1 + right >= want
        i, p, right = i[ok], p[ok], right[ok]
        # The least start in (i - p, i] from which all words up to i are repeated p words later.
        lo, hi = np.maximum(i - p, -1), i.copy()
        while len(open_ := np.flatnonzero(hi - lo > 1)):
            mid = (lo[open_] + hi[open_]) // 2
            fits = (codes[mid] == codes[mid + p[open_]]) & (s.agree(mid, mid + p[open_]) >= i[open_] - mid)
            hi[open_[fits]] = mid[fits]
            lo[open_[~fits]] = mid[~fits]
        length = i + p + right - hi
        # A root that reaches a whole period to the left isn't the leftmost one: the word before its start repeats too.
        before = np.maximum(hi - 1, 0)
        leftmost = (hi == 0) | (codes[before] != codes[before + p])
        ok = leftmost & (length >= np.maximum(shortest, periods * p))
        found.append(np.stack([hi[ok], length[ok], p[ok]]))
    runs = np.concatenate(found, axis=1)
    runs = runs[:, np.lexsort((runs[2], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:, 1:] != runs[:, :-1]).any(axis=0)
    return tuple(runs[:, new])


def slices(batch: pa.RecordBatch) -> Iterator[list[list[bytes]]]:
    """The words of a batch's texts, in slices of some SORTED_WORDS words; bytes.split() knows just the white space of SPACE."""
    out, n = [], 0
    for text in batch.column("text").cast(pa.binary()):
        out.append((text.as_py() or b"").split())
        n += len(out[-1])
        if n >= SORTED_WORDS:
            yield out
            out, n = [], 0
    if out:
        yield out


def codes_of(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all documents, each ended by its own mark, and where each one starts."""
    known: dict[bytes, int] = defaultdict(count(1).__next__)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(lengths + 1) - lengths - 1
    codes = np.zeros(int(lengths.sum()) + len(docs), np.int64)
    words = np.fromiter(map(known.__getitem__, chain.from_iterable(docs)), np.int64, int(lengths.sum()))
    inside = np.ones(len(codes), bool)
    inside[starts + lengths] = False
    codes[inside] = words
    return codes + np.repeat(np.arange(len(docs)), lengths + 1) * (len(known) + 1), starts


def repeated(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray, n: int) -> np.ndarray:
    """Of n places, those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts + periods, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", shortest: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the kept columns, n_words, runs (start, length, period; by start, then period) and collapsed, for every row.

    A run counts from `shortest` words on. collapsed is the text without the words that any run holds after its first
    period, joined by one space.
    """
    rows = docs.select(key, "text", *keep)
    own = [StructField(f.name, f.dataType) for f in rows.schema if f.name != "text"]
    schema = StructType([*own, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())])
    kind = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = 0
            for docs in slices(batch):
                codes, starts = codes_of(docs)
                s, length, period = find(codes, max(map(len, docs)) + 1, shortest)
                gone = repeated(s, length, period, len(codes))
                of = np.searchsorted(starts, s, "right") - 1
                edges = np.searchsorted(of, np.arange(len(docs) + 1))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s - starts[of], length, period)], fields=list(kind.value_type))
                texts = []
                for k, doc in enumerate(docs):
                    if edges[k] < edges[k + 1]:
                        doc = [doc[i] for i in np.flatnonzero(~gone[starts[k] : starts[k] + len(doc)])]
                    texts.append(b" ".join(doc))
                part = batch.slice(at, len(docs))
                at += len(docs)
                made = [pa.array([len(d) for d in docs], pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs, type=kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in own), *made], names=[f.name for f in schema])

        return step

    return in_batches(rows, make, schema)


def word_list(text: Column) -> Column:
    """The words of a text as an array; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def with_planted_period(text: Column, key: Column) -> Column:
    """The text, or for every tenth id (by its checksum) one whose words repeat a period from some word on, joined by spaces."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (g % 8 + 3))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    # As an element of an array the words are worked out once for each text.
    return F.when(h % 10 == 0, F.get(F.transform(F.array(word_list(text)), planted), F.lit(0))).otherwise(text)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, the longest run (ties: smallest start, then period) and checksums of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("b"), "runs", "collapsed")
    return out.select(
        key, "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("b.length * 1000 div -b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
