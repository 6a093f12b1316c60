"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A seed is a run of three words of a test item that a text of average length holds by chance with a
probability of at most chance / (number of seeds), by the words' frequencies in all documents; an
item keeps its `least` rarest seeds in any case. Where a seed stands in a text, the words around it
are aligned locally with the item (match 2, other word -1, gap -1); score is the alignment's value
over that of a whole match. The items go to the workers, in blocks of at most block_chars characters; a
larger test set takes one pass over the documents a block.

Edge cases: words are lower-cased and lose punctuation at their ends; items of fewer than three words have no
seeds and match texts of just these words; items without words match nothing; null texts count as empty; long texts are read whole; items of equal text match
on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import Grown, TokenCache, in_batches, spread, texts
from .langid import MARKS

N = 3


def words_of(text: str) -> list[str]:
    return [w for x in text.split() if (w := x.strip(MARKS).lower())]


class Numbers(TokenCache):
    """Token -> number of its word among the items' words; -1: another word, -2: no word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__(600_000)
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.number = Grown(np.int32)

    def fill(self, new: list[str]) -> None:
        bare = [x.strip(MARKS).lower() for x in new]
        self.number.add(np.fromiter((self.vocabulary.get(w, -1) if w else -2 for w in bare), np.int32, len(new)))

    def words(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and of which text each is."""
        parts, counts = [], np.zeros(len(docs), np.int64)
        for k, text in enumerate(docs):
            own = text.split()
            counts[k] = len(own)
            parts += own
        rows = self.rows(parts)
        number = self.number.a[rows]
        of = np.repeat(np.arange(len(docs)), counts)
        word = number > -2
        return number[word], of[word]


class Items:
    """The items of a block as numbers, with their seeds."""

    def __init__(self, items: list[tuple[object, str]]):
        own = [(i, words_of(t or "")) for i, t in items]
        own = [(i, w) for i, w in own if w]
        self.ids = [i for i, _ in own]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for _, ws in own for x in ws))}
        self.words = [np.array([self.vocabulary[x] for x in ws], np.int32) for _, ws in own]
        self.short: dict[tuple[int, ...], list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w) < N:
                self.short.setdefault(tuple(w.tolist()), []).append(k)

    def seed(self, counts: np.ndarray, total: int, docs: int, chance: float, least: int) -> None:
        """Chooses the seeds; afterwards keys (sorted), item and place hold one entry a seed."""
        log_p = np.log((counts + 1.0) / (total + len(counts) + 1.0))
        keys, item, place, rare = [], [], [], []
        for k, w in enumerate(self.words):
            if len(w) < N:
                continue
            g = np.stack([w[i : len(w) - N + 1 + i] for i in range(N)], 1).astype(np.int64)
            keys.append(self.key(g[:, 0], g[:, 1], g[:, 2]))
            rare.append(log_p[g].sum(1))
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        if not keys:
            self.keys = self.item = self.place = np.zeros(0, np.int64)
            return
        n = sum(map(len, keys))
        bound = math.log(chance / n) - math.log(max(1.0, total / max(docs, 1)))
        keep = [r <= max(bound, np.sort(r)[min(least, len(r)) - 1]) for r in rare]
        keys, item, place = (np.concatenate([x[k] for x, k in zip(xs, keep, strict=True)]) for xs in (keys, item, place))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]

    def key(self, a, b, c) -> np.ndarray:
        v = np.int64(len(self.vocabulary))
        return (a.astype(np.int64) * v + b) * v + c


def align(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row of item (padded with -8) with its row of window (padded with -9): value and end."""
    m, w = window.shape
    step = np.arange(w + 1, dtype=np.int32)
    h, best, end = np.zeros((m, w + 1), np.int32), np.zeros(m, np.int32), np.zeros(m, np.int64)
    for r in range(item.shape[1]):
        new = np.zeros_like(h)
        new[:, 1:] = h[:, :-1] + np.where(window == item[:, r, None], 2, -1)
        new = np.maximum(np.maximum(new, h - 1), 0)
        h = np.maximum.accumulate(new + step, 1) - step
        top = h.argmax(1)
        value = h[np.arange(m), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def candidates(items: Items, number: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, item, first and last position of words for each run of seeds that may be one alignment; and its seeds."""
    if len(number) < N or not len(items.keys):
        return (np.zeros(0, np.int64),) * 5
    ok = np.flatnonzero((number[:-2] >= 0) & (number[1:-1] >= 0) & (number[2:] >= 0) & (of[:-2] == of[2:]))
    key = items.key(number[ok], number[ok + 1], number[ok + 2])
    first, last = np.searchsorted(items.keys, key), np.searchsorted(items.keys, key, "right")
    n = last - first
    hit = spread(first, n)
    at, item, place = np.repeat(ok, n), items.item[hit], items.place[hit]
    size = np.fromiter(map(len, items.words), np.int64, len(items.words))
    start = at - place  # where the item would begin
    order = np.lexsort([start, item, of[at]])
    at, item, start, text = at[order], item[order], start[order], of[at[order]]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[item[1:]] // 2)
    cut = np.flatnonzero(new)
    if not len(cut):
        return (np.zeros(0, np.int64),) * 5
    lo, hi = np.minimum.reduceat(start, cut), np.maximum.reduceat(start, cut)
    edge = np.searchsorted(of, np.arange(int(of[-1]) + 2))
    slack = size[item[cut]] // 2
    lo = np.maximum(lo - slack, edge[text[cut]])
    hi = np.minimum(hi + size[item[cut]] + slack, edge[text[cut] + 1])
    return text[cut], item[cut], lo, hi, np.diff(np.append(cut, len(at)))


def matches(items: Items, number: np.ndarray, of: np.ndarray, floor: float) -> list[tuple]:
    """(text, item, score, first word, end word, seeds) of alignments with a score of at least floor, and of short items that are a whole text."""
    text, item, lo, hi, seeds = candidates(items, number, of)
    out = []
    if items.short and len(of):
        start = np.flatnonzero(np.diff(of, prepend=-1))
        size = np.diff(np.append(start, len(of)))
        for a, n in zip(start[size < N].tolist(), size[size < N].tolist(), strict=True):
            out += [(int(of[a]), k, 1.0, a, a + n, 0) for k in items.short.get(tuple(number[a : a + n].tolist()), [])]
    size = np.fromiter(map(len, items.words), np.int64, len(items.words))
    order = np.lexsort([hi - lo, size[item]]) if len(text) else []
    for block in np.array_split(order, max(1, -(-len(order) // 128))) if len(text) else []:
        a = np.full((len(block), int(size[item[block]].max())), -8, np.int32)
        b = np.full((len(block), int((hi - lo)[block].max())), -9, np.int32)
        for r, k in enumerate(block.tolist()):
            a[r, : size[item[k]]] = items.words[item[k]]
            b[r, : hi[k] - lo[k]] = number[lo[k] : hi[k]]
        value, end = align(a, b)
        score = value / (2.0 * size[item[block]])
        for r in np.flatnonzero(score >= floor).tolist():
            k = int(block[r])
            out.append((int(text[k]), int(item[k]), float(score[r]), int(lo[k]), int(lo[k] + end[r]), int(seeds[k])))
    return out


def counted(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int, int]:
    """How often each of the words stands in all documents, the words and the documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        numbers = Numbers(shared.value)

        def step(batch: pa.RecordBatch):
            number, _ = numbers.words(texts(batch))
            count = np.bincount(number[number >= 0])
            some = np.flatnonzero(count)
            word = np.concatenate([some, [-1, -2]])
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(np.concatenate([count[some], [len(number), batch.num_rows]]), pa.int64())], ["word", "n"])

        return step

    rows = in_batches(docs.select("text"), make, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts, more = np.zeros(len(vocabulary)), {}
    for r in rows:
        if r["word"] >= 0:
            counts[r["word"]] = r["n"]
        else:
            more[r["word"]] = r["n"]
    return counts, more.get(-1, 0), more.get(-2, 0)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", floor: float = 0.45, chance: float = 0.5, least: int = 6, block_chars: int = 4_000_000) -> DataFrame:
    """key, item, score, first_word and end_word (places among the text's words), seeds: the best alignment of each
    text and item with a score of at least floor."""
    out = None
    for items in item_blocks(docs, benchmark, item, chance, least, block_chars):
        found = searched(docs, items, key, item, floor, benchmark.schema[item].dataType)
        out = found if out is None else out.unionByName(found)
    return out


def item_blocks(docs: DataFrame, benchmark: DataFrame, item: str, chance: float, least: int, block_chars: int) -> Iterator[Items]:
    """The items with their seeds, in blocks of a bounded size; one block where there are none."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_chars))
    for b in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64(item, "text"), F.lit(blocks)) == b)
        rows = part.select(item, "text").collect()
        items = Items(sorted(((r[item], r["text"]) for r in rows), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1] or "")))
        items.seed(*counted(docs, items.vocabulary), chance, least)
        yield items


def searched(docs: DataFrame, items: Items, key: str, item: str, floor: float, item_type: DataType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    arrow = to_arrow_type(item_type)
    more = [("score", DoubleType()), ("first_word", LongType()), ("end_word", LongType()), ("seeds", IntegerType())]
    schema = StructType([StructField(c, t) for c, t in [(key, docs.schema[key].dataType), (item, item_type), *more]])

    def make():
        items = shared.value
        numbers = Numbers(items.vocabulary)

        def step(batch: pa.RecordBatch):
            number, of = numbers.words(texts(batch))
            best: dict[tuple[int, int], tuple] = {}
            for m in matches(items, number, of, floor):
                if m[:2] not in best or m[2] > best[m[:2]][2]:
                    best[m[:2]] = m
            if best:
                edge = np.searchsorted(of, np.arange(batch.num_rows + 1))
                rows = [best[k] for k in sorted(best)]
                text = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(text)),
                        pa.array([items.ids[r[1]] for r in rows], arrow),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] - int(edge[r[0]]) for r in rows], pa.int64()),
                        pa.array([r[4] - int(edge[r[0]]) for r in rows], pa.int64()),
                        pa.array([r[5] for r in rows], pa.int32()),
                    ],
                    [key, item, "score", "first_word", "end_word", "seeds"],
                )

        return step

    return in_batches(docs.select(key, "text"), make, schema)


def clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", floor: float = 0.45, chance: float = 0.5, least: int = 6, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs whose text aligns with no item; each row by its own text, with all its columns."""
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    for items in item_blocks(docs, benchmark, item, chance, least, block_chars):
        out = without(out, items, floor)
    return out.select("row.*")


def without(docs: DataFrame, items: Items, floor: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        items = shared.value
        numbers = Numbers(items.vocabulary)

        def step(batch: pa.RecordBatch):
            keep = np.ones(batch.num_rows, bool)
            keep[[m[0] for m in matches(items, *numbers.words(texts(batch)), floor)]] = False
            yield batch.filter(pa.array(keep))

        return step

    return in_batches(docs, make, docs.schema)
