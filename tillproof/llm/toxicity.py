"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are lexicons and patterns: a hand-written list of insults, lexicons of words and of word
beginnings that labelled texts single out, split by a hash into several voters, repeated and dense
hits, address patterns, and voters for clean text, which learned words at a rate of chance don't silence. Each votes 1, 0 or abstains. The label model has
an accuracy per voter and answer, found by expectation-maximisation, and discounts voters by the
correlations that remain once the label is given. A linear classifier (hits, votes and hashed words)
is fitted to its posterior labels and scores every text.

Learning takes at most `bound` labelled texts, of any length, by a hash of their id.

Edge cases: null and empty texts get the score of a text without any hit; texts of any length count
whole; labels that are null or of rows without text teach nothing; several labels of one id are all
used; without labelled rows only the hand-written voters speak; equal texts get equal scores; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import Grown, TokenCache, in_batches, in_slices, texts
from .langid import MARKS, id_mod

#: Insults in the four languages; fixed values.
INSULTS = frozenset(
    "idiot moron loser scum trash clown stupid dumb pathetic worthless disgusting imbecile cretin vermin filth parasite degenerate "
    "dummkopf trottel arschloch abschaum versager widerlich schwachkopf vollidiot "
    "imbécile crétin abruti connard ordure minable dégoûtant débile salaud "
    "imbécil estúpido basura escoria payaso patético asqueroso inútil cretino".split()
)
#: Words that address someone; fixed values.
ADDRESS = frozenset("you your you're du dich dein ihr tu toi vous votre tú usted eres vosotros".split())
LEXICONS, HEAD, BITS = 3, 5, 14


class Hits(TokenCache):
    """Token -> hit flags, a weight in each lexicon and a hashed number."""

    def __init__(self, words: dict[str, float], heads: dict[str, float]):
        super().__init__(200_000)
        self.words, self.heads = words, heads
        self.reset()

    def reset(self) -> None:
        self.flag, self.hash = Grown(np.float32, LEXICONS + 6), Grown(np.int32)

    def fill(self, new: list[str]) -> None:
        flag = np.zeros((len(new), LEXICONS + 6), np.float32)
        number = np.zeros(len(new), np.int32)
        for k, x in enumerate(new):
            w = x.strip(MARKS).lower()
            if not w:
                continue
            h = zlib.crc32(w.encode())
            number[k] = h & ((1 << BITS) - 1)
            if (score := self.words.get(w)) is not None:
                flag[k, h % LEXICONS] = 1
                flag[k, LEXICONS + 5] = score
            if len(w) > HEAD and w[:HEAD] in self.heads:
                flag[k, LEXICONS] = 1
            flag[k, LEXICONS + 1] = w in INSULTS
            flag[k, LEXICONS + 2] = w in ADDRESS
            flag[k, LEXICONS + 3] = len(w) > 1 and x.strip(MARKS).isupper()
            flag[k, LEXICONS + 4] = 1
        self.flag.add(flag)
        self.hash.add(number)

    def features(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the flags of each text, given as its words; the hashed words and of which text each is."""
        parts, counts = [], np.zeros(len(docs), np.int64)
        for k, own in enumerate(docs):
            counts[k] = len(own)
            parts += own
        of = np.repeat(np.arange(len(docs)), counts)
        sums = np.zeros((len(docs), LEXICONS + 6))
        if not parts:
            return sums, np.zeros(0, np.int64), of
        rows = self.rows(parts)
        flag = self.flag.a[rows]
        some = counts > 0
        sums[some] = np.add.reduceat(flag, (np.cumsum(counts) - counts)[some], 0, dtype=np.float64)
        return sums, self.hash.a[rows], of


    def compact(self, docs: list[str], piece: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with each hashed word of a text once, and its number; a long text goes through in pieces."""
        sums, found = np.zeros((len(docs), LEXICONS + 6)), []
        for k, text in enumerate(docs):
            words = text.split()
            for a in range(0, len(words), piece):
                s, h, _ = self.features([words[a : a + piece]])
                sums[k] += s[0]
                used, n = np.unique(h, return_counts=True)
                found.append((used.astype(np.int32), np.full(len(used), k, np.int32), n.astype(np.float32)))
        h, of, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
        return sums, h, of, n


def stray_rate(s: np.ndarray, y: np.ndarray) -> float:
    """The rate of learned words, without a listed insult, up to which they are more often chance than not: long texts hold some.

    The cut with the fewest misplaced labels, but with at most a twentieth of the toxic texts below it."""
    hit = s[:, :LEXICONS].sum(1)
    only = (hit > 0) & (s[:, LEXICONS + 1] == 0)
    rate, toxic = hit[only] / s[only, LEXICONS + 4], y[only] == 1
    if not toxic.any():
        return 0.0
    order = np.argsort(rate, kind="stable")
    misplaced = np.cumsum(np.where(toxic[order], 1, -1))
    last = np.append(np.diff(rate[order]) > 0, True)
    k = np.flatnonzero(last)[misplaced[last].argmin()]
    return float(min(rate[order][k], np.quantile(rate[toxic], 0.05))) if misplaced[k] < 0 else 0.0


def votes(s: np.ndarray, stray_rate: float) -> np.ndarray:
    """The voters' answers, a column each: 1 toxic, 0 clean, -1 abstains."""
    lex, head, hand, address, shout, n = s[:, :LEXICONS], s[:, LEXICONS], s[:, LEXICONS + 1], s[:, LEXICONS + 2], s[:, LEXICONS + 3], np.maximum(s[:, LEXICONS + 4], 1)
    hit = lex.sum(1)
    yes, no = lambda c: np.where(c, 1, -1), lambda c: np.where(c, 0, -1)
    stray = (hand == 0) & (hit / n <= stray_rate)
    out = [yes((lex[:, i] > 0) & ~stray) for i in range(LEXICONS)]
    out += [yes(hand > 0), yes(hit + hand >= 2), yes((hit + hand) / n > 0.004), yes((hit + hand > 0) & (address > 0)), yes(head >= 2)]
    out += [no(stray), no(stray & (head == 0)), no((hit + hand == 0) & (shout / n > 0.5))]
    return np.stack(out, 1).astype(np.int8)


class LabelModel:
    """Accuracies of voters by expectation-maximisation, discounted by their residual correlations."""

    def __init__(self, v: np.ndarray, rounds: int = 25, prior: float = 0.1):
        answers = np.stack([v == a for a in (-1, 0, 1)], 2).astype(float)
        m = v.shape[1]
        self.prior, self.discount = prior, np.ones(m)
        q = np.where((v == 1).any(1), 0.9, 0.03)
        for _ in range(rounds):
            self.table = np.stack([(answers * w[:, None, None]).sum(0) + [0.5, 0.1, 0.1] for w in (1 - q, q)])
            self.table /= self.table.sum(2, keepdims=True)
            self.prior = float(np.clip(q.mean(), 0.01, 0.5)) if len(v) else prior
            self.correlate(v, q)
            q = self.posterior(v)

    def correlate(self, v: np.ndarray, q: np.ndarray) -> None:
        """What correlation of the votes the label leaves unexplained; a voter counts 1 / (1 + its sum)."""
        x = np.concatenate([v == 1, v == 0], 1).astype(float)
        if len(x) < 2:
            return
        m = v.shape[1]
        mean = np.stack([(x * w[:, None]).sum(0) / max(w.sum(), 1e-9) for w in (1 - q, q)])
        rest = x - (1 - q)[:, None] * mean[0] - q[:, None] * mean[1]
        sd = rest.std(0) + 1e-6
        r = np.abs(rest.T @ rest / len(x) / np.outer(sd, sd))
        self.correlation = np.maximum(np.maximum(r[:m, :m], r[m:, m:]), np.maximum(r[:m, m:], r[m:, :m]))
        np.fill_diagonal(self.correlation, 0)
        strong = np.where(self.correlation > 0.1, self.correlation, 0)
        self.discount = 1 / (1 + strong.sum(1))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        i = (v + 1).astype(int)
        j = np.arange(v.shape[1])
        odds = ((np.log(self.table[1][j, i]) - np.log(self.table[0][j, i])) * self.discount).sum(1)
        return 1 / (1 + np.exp(-(odds + math.log(self.prior / (1 - self.prior))).clip(-30, 30)))


class Model:
    """The classifier: dense weights, weights of hashed words, a bias and the rate of stray words."""

    def __init__(self, words: dict[str, float], heads: dict[str, float], dense: np.ndarray, hashes: np.ndarray, bias: float, stray: float):
        self.words, self.heads, self.dense, self.hashes, self.bias, self.stray = words, heads, dense, hashes, bias, stray

    def score(self, hits: Hits, docs: list[str]) -> np.ndarray:
        s, h, of = hits.features([x.split() for x in docs])
        z = inputs(s, self.stray) @ self.dense + self.bias
        n = np.bincount(of, minlength=len(docs))
        z += np.bincount(of, self.hashes[h], len(docs)) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def inputs(s: np.ndarray, stray_rate: float) -> np.ndarray:
    """Dense inputs: logarithms of hits, the learned weight of the hits and the votes."""
    v = votes(s, stray_rate)
    n = np.maximum(s[:, LEXICONS + 4], 1)[:, None]
    return np.concatenate([np.log1p(s[:, : LEXICONS + 3]), np.log1p(s[:, LEXICONS + 5 :]), np.minimum(1, 100 * s[:, : LEXICONS + 2] / n), v == 1, v == 0], 1).astype(float)


def apart(samples: list[tuple[str, int]], hashes: int = 4) -> list[tuple[str, int]]:
    """Without copies: a text goes if one of its least hashed word triples was another's, so copies don't vouch for a word."""
    seen, out = set(), []
    for text, y in samples:
        w = text.lower().split()
        own = np.fromiter({zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))}, np.uint64)
        least = [(j, int(((own * np.uint64(m) >> np.uint64(7)) & np.uint64(0xFFFFFFFF)).min())) for j, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[:hashes])]
        if not seen.intersection(least):
            out.append((text, y))
        seen.update(least)
    return out


def lexicons(samples: list[tuple[str, int]], least: int = 3) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings whose texts are toxic far more often than others, with their log odds."""
    counts, heads, total = ({}, {}), ({}, {}), [1, 1]
    for y in (1, 0):  # of the others' words only those count that toxic texts hold, too
        for text in (t for t, label in samples if label == y):
            total[y] += 1
            own = {x.strip(MARKS).lower() for x in text.split()}
            for c, found in ((counts, own), (heads, {w[:HEAD] for w in own if len(w) > HEAD})):
                for w in found:
                    if y or w in c[1]:
                        c[y][w] = c[y].get(w, 0) + 1

    def odd(c, least, floor):
        out = {}
        for w, k in c[1].items():
            ratio = math.log((k + 0.1) / total[1]) - math.log((c[0].get(w, 0) + 0.1) / total[0])
            if w and k >= least and ratio >= floor:
                out[w] = ratio
        return out

    many = max(1.0, total[1] / 60)
    return odd(counts, max(least, round(many)), 4.0), odd(heads, max(3, round(1.5 * many)), 4.0)


def train(samples: list[tuple[str, int]], epochs: int = 150, rate: float = 0.5) -> Model:
    """Lexicons from the labels, voters, the label model and the classifier on its posteriors."""
    samples = apart(samples)
    words, heads = lexicons(samples)
    hits = Hits(words, heads)
    s, h, of, times = hits.compact([t for t, _ in samples])
    stray = stray_rate(s, np.array([y for _, y in samples], int))
    v = votes(s, stray)
    q = LabelModel(v).posterior(v) if len(v) else np.zeros(0)
    x = inputs(s, stray)
    n = np.sqrt(np.maximum(np.bincount(of, times, len(x)), 1))
    dense, hashes, bias = np.zeros(x.shape[1]), np.zeros(1 << BITS), -2.0
    sum_d, sum_h, sum_b = np.full_like(dense, 1e-3), np.full_like(hashes, 1e-3), 1e-3
    for _ in range(epochs if len(x) else 0):
        z = x @ dense + bias + np.bincount(of, hashes[h] * times, len(x)) / n
        miss = q - 1 / (1 + np.exp(-z.clip(-30, 30)))
        g = x.T @ miss / len(x) - 1e-4 * dense
        sum_d += g * g
        dense += rate * g / np.sqrt(sum_d)
        g = np.bincount(h, (miss / n)[of] * times, 1 << BITS) / len(x) - 1e-3 * hashes
        sum_h += g * g
        hashes += 0.1 * rate * g / np.sqrt(sum_h)
        b = float(miss.mean())
        sum_b += b * b
        bias += rate * b / math.sqrt(sum_b)
    if not len(x):
        dense[LEXICONS + 1], bias = 4.0, -3.0
    return Model(words, heads, dense, hashes, bias, stray)


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", bound: int = 6000) -> list[tuple[str, int]]:
    """At most bound labelled texts that may be learned from, by a hash of the id."""
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & (id_mod(key, 4) != 2)).select(key, "toxic")
    n = chosen.count()
    order = F.xxhash64(F.col(key).cast("string"), F.lit("toxicity"))
    chosen = chosen.withColumn("_h", order).where(F.pmod("_h", F.lit(1_000_003)) / 1_000_003 < min(1.0, 1.1 * bound / max(n, 1)))
    chosen = chosen.orderBy("_h", key, "toxic").limit(bound)
    rows = docs.select(key, "text").where(F.length("text") > 0).join(F.broadcast(chosen), key).orderBy("_h", "text", "toxic").limit(bound)
    return [(r["text"], r["toxic"]) for r in rows.select("text", "toxic").collect()]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", keep: tuple[str, ...] = (), cut: float = 0.3) -> DataFrame:
    """key, the columns in keep, score and predicted of every text."""
    names = list(dict.fromkeys([key, *keep]))
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in names), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        hits = Hits(model.words, model.heads)

        def step(batch: pa.RecordBatch):
            score = np.concatenate([model.score(hits, part) for part in in_slices(texts(batch))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array((score >= cut).astype(np.int32))], [*names, "score", "predicted"])

        return step

    return in_batches(docs.select(*dict.fromkeys([*names, "text"])), make, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learns from labelled rows whose crc32 of the id mod 4 is not 2, then scores all."""
    return predict(docs, train(sample(docs, labels, key)), key, keep)
