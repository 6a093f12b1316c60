"""Language of words in code-switched text by a linear-chain conditional random field.

A sequence is a line of a text, an element a word with a letter. Its features are hashed n-grams of
characters with the word's ends (so affixes too), longer affixes and its entry in a learned lexicon;
transitions between languages are learned with them, also from lines that join stretches of texts in
several languages. Forward-backward gives each word's posterior; a text's language has the largest sum of
them and score is its mean. Long lines go through in pieces of 256 words side by side; the messages between
the pieces come first, so the chain is never cut.

Learning takes at most per_lang labelled texts of each language, and bound texts of all languages together (but
one of each at least), chosen by a hash of their id: a bounded sample for the classifier. Scoring takes all words of
all texts.

Edge cases: a null or empty text, or one without a letter, is `und` with score 0; ties go to the
language first in the alphabet; null ids are held out; null languages teach nothing; without a
labelled row every text is `und`; equal texts get equal rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Grown, TokenCache, in_batches, in_slices, spread, texts

BITS, SEQ = 15, 256
MARKS = ".,;:!?\"'()[]{}<>«»&%$#*|-_=+/\\@~^`"


def id_mod(key: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


class Words(TokenCache):
    """Token -> hashed features; kind is 1 for a word, 0 for a token without letters, 2 for a line's end."""

    def __init__(self, lexicon: dict[str, int], weights: np.ndarray | None = None):
        super().__init__(200_000)
        self.lexicon, self.weights = lexicon, weights
        self.reset()

    def reset(self) -> None:
        self.kind, self.start, self.length = Grown(np.int8), Grown(np.int64), Grown(np.int64)
        self.feature = Grown(np.int32)
        if self.weights is not None:
            self.score = Grown(np.float32, self.weights.shape[1])

    def fill(self, new: list[str]) -> None:
        words, kind = [], np.zeros(len(new), np.int8)
        for k, x in enumerate(new):
            w = x.strip(MARKS).lower()
            kind[k] = 2 if x == "\n" else w.isalpha() or any(map(str.isalpha, w))
            words.append(w if kind[k] == 1 else "")
        feature, length = hashed(words, self.lexicon)
        length[kind != 1] = 0
        own = np.repeat(kind == 1, self.all_lengths(words))
        feature = feature[own]
        if self.weights is None:
            self.start.add(self.feature.n + np.cumsum(length) - length)
            self.feature.add(feature)
        else:
            rows = np.zeros((len(new), self.weights.shape[1]), np.float32)
            has = np.flatnonzero(length)
            if len(has):
                cut = np.cumsum(length[has]) - length[has]
                rows[has] = np.add.reduceat(self.weights[feature], cut, 0) / np.sqrt(length[has])[:, None]
            self.score.add(rows)
        self.length.add(length)
        self.kind.add(kind)

    @staticmethod
    def all_lengths(words: list[str]) -> np.ndarray:
        n = np.fromiter(map(len, words), np.int64, len(words))
        return (n + 1) + n + 3

    def tokens(self, docs: list[str], going_on: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all tokens, and of which text each is; a line's end and a text's end are tokens too.

        The texts numbered in going_on share their last line with the next one.
        """
        parts, counts = [], np.zeros(len(docs), np.int64)
        for k, text in enumerate(docs):
            own = text.replace("\n", " \n ").split(" ")
            if k not in going_on:
                own.append("\n")
            counts[k] = len(own)
            parts += own
        return self.rows(parts), np.repeat(np.arange(len(docs)), counts)


def hashed(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each word, flat: bigrams and trigrams with the ends, two long affixes and its lexicon entry."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join([f"^{w}$$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    m = n + 3
    first = np.cumsum(m) - m
    mask = np.uint64((1 << BITS) - 1)

    def mix(*xs) -> np.ndarray:
        h = np.full(len(xs[0]), len(xs), np.uint64)
        for x in xs:
            h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(7) & mask).astype(np.int32)

    two, three = mix(code[:-1], code[1:]), mix(code[:-2], code[1:-1], code[2:])
    word = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    total = (n + 1) + n + 3
    at = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.int32)
    out[spread(at, n + 1)] = two[spread(first, n + 1)]
    out[spread(at + n + 1, n)] = three[spread(first, n)]
    last = at + 2 * n + 1
    c = lambda i: code[np.minimum(i, len(code) - 1)]
    end = first + n
    back = [c(np.maximum(end - i, first)) for i in range(4)]
    out[last] = mix(c(first), c(first + 1), c(first + 2), c(first + 3))
    out[last + 1] = mix(*back, np.full(len(words), 36, np.uint64))
    out[last + 2] = np.where(word >= 0, (1 << BITS) + 1 + word, 1 << BITS)
    return out, total


def sequences(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the words; start and length of each piece of a line among them, longest first, and whether it goes on with the piece before."""
    at = np.flatnonzero(kind == 1)
    if not len(at):
        return at, at, at, at.astype(bool)
    line = np.cumsum(kind == 2)[at]
    new = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(new, len(at)))
    pieces = -(-size // SEQ)
    number = spread(np.zeros(len(new), np.int64), pieces)
    start = np.repeat(new, pieces) + SEQ * number
    length = np.minimum(np.repeat(new + size, pieces) - start, SEQ)
    order = np.argsort(-length, kind="stable")
    return at, start[order], length[order], number[order] > 0


def messages(x: np.ndarray, a: np.ndarray, start: np.ndarray, length: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each piece of a line hears from the pieces before and after it; ones where there are none."""
    k = len(a)
    before, after = np.ones((len(start), k), x.dtype), np.ones((len(start), k), x.dtype)
    if not on.any():
        return before, after
    order = np.argsort(start)
    g = on[order]
    of = order[g | np.append(g[1:], False)]  # pieces of lines of several pieces, in order
    of = of[np.argsort(-length[of], kind="stable")]
    going = np.searchsorted(-length[of], -np.arange(1, int(length[of[0]]) + 1), "right")
    m = np.empty((len(of), k, k), x.dtype)  # what a piece makes of a message
    for t, n in enumerate(going.tolist()):
        i = x[start[of[:n]] + t][:, None, :]
        now = np.where(on[of, None, None], a, np.eye(k, dtype=x.dtype)) * i if t == 0 else (m[:n] @ a) * i
        m[:n] = now / now.sum((1, 2), keepdims=True)
    in_order = np.argsort(start[of])
    of, m = of[in_order].tolist(), m[in_order]
    for j in range(1, len(of)):
        if on[of[j]]:
            out = before[of[j - 1]] @ m[j - 1]
            before[of[j]] = out / out.sum()
    for j in range(len(of) - 1, 0, -1):
        if on[of[j]]:
            out = m[j] @ after[of[j]]
            after[of[j - 1]] = out / out.sum()
    return before, after


def posteriors(e: np.ndarray, start: np.ndarray, length: np.ndarray, on: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Each element's label posteriors; with pairs, expected transitions and the log partitions' sum too.

    e: scores of the elements; pieces are given longest first, so that at each step a prefix of
    them is still going on. on: whether a piece goes on with the line of the piece before it in e.
    """
    peak = e.max(1, keepdims=True)
    x = np.exp(e - peak)
    a, alpha, scale = np.exp(trans), np.empty_like(x), np.empty(len(x), x.dtype)
    before, after = messages(x, a, start, length, on)
    going = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
    for t, n in enumerate(going.tolist()):
        i = start[:n] + t
        v = np.where(on[:, None], before @ a, 1) * x[i] if t == 0 else (alpha[i - 1] @ a) * x[i]
        s = v.sum(1)
        alpha[i], scale[i] = v / s[:, None], s
    beta = np.ones_like(x)
    beta[start + length - 1] = after
    for t in range(len(going) - 2, -1, -1):
        i = start[: going[t + 1]] + t
        beta[i] = (beta[i + 1] * x[i + 1] / scale[i + 1][:, None]) @ a.T
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post, None, None
    inner = np.ones(len(x), bool)
    inner[start[~on]] = False
    j = np.flatnonzero(inner)
    heard = beta[j] * x[j]
    both = a * ((alpha[j - 1] / ((alpha[j - 1] @ a) * heard).sum(1, keepdims=True)).T @ heard)
    return post, both, float(np.log(scale).sum() + peak.sum())


class Model:
    def __init__(self, langs: list[str], lexicon: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.lexicon, self.weights, self.trans = langs, lexicon, weights, trans

    def posteriors(self, words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are words, and of each the posterior of the languages."""
        at, start, length, on = sequences(words.kind.a[rows])
        return at, posteriors(words.score.a[rows[at]], start, length, on, self.trans)[0] if len(at) else np.zeros((0, len(self.langs)))

    def word_languages(self, text: str) -> list[str]:
        """The likeliest language of each word of a text that has a letter."""
        words = Words(self.lexicon, self.weights)
        return [self.langs[k] for k in self.posteriors(words, words.tokens([text])[0])[1].argmax(1)]

    def predict(self, words: Words, docs: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(docs), np.zeros(len(docs))
        rows, doc = words.tokens(docs)
        k = len(self.langs)
        total = np.zeros((len(docs), k))
        at, post = self.posteriors(words, rows)
        if len(at):
            of = doc[at]
            total = np.stack([np.bincount(of, post[:, j], len(docs)) for j in range(k)], 1)
        n, best = total.sum(1), total.round(9).argmax(1)
        score = np.where(n > 0, total[np.arange(len(docs)), best] / np.maximum(n, 1e-300), 0.0)
        return [self.langs[b] if m else "und" for b, m in zip(best.tolist(), (n > 0).tolist(), strict=True)], score.clip(0, 1)


def train(samples: list[tuple[str, str]], epochs: int = 3, lexicon_size: int = 20_000, rate: float = 0.3, l2: float = 1e-6) -> Model:
    """Adagrad on the conditional likelihood, over groups of sequences; samples are (text, language)."""
    langs = sorted({y for _, y in samples})
    if not langs:
        return Model([], {}, np.zeros((1, 1), np.float32), np.zeros((1, 1), np.float32))
    number: dict[str, int] = {}
    for text, _ in samples:
        for w in {x.strip(MARKS).lower() for x in text.split()}:
            number[w] = number.get(w, 0) + 1
    often = sorted((w for w, c in number.items() if c >= 3 and w), key=lambda w: (-number[w], w))[:lexicon_size]
    lexicon = {w: i for i, w in enumerate(often)}
    words, k = Words(lexicon), len(langs)
    words.limit = 1 << 40
    weights, trans = np.zeros(((1 << BITS) + 1 + len(lexicon), k), np.float32), np.zeros((k, k), np.float32)
    sum_w, sum_t = np.full_like(weights, 1e-3), np.full_like(trans, 1e-3)
    label = np.array([langs.index(y) for _, y in samples])
    order = np.argsort([hash_of(t) for t, _ in samples], kind="stable")
    draw = np.random.default_rng(7)
    for epoch in range(epochs):
        for group in np.array_split(order, max(1, len(order) // 24)):
            docs, gold_of = [samples[i][0] for i in group.tolist()], label[group].tolist()
            mixed, mixed_of, going_on = switched(docs, gold_of, draw)
            rows, doc = words.tokens(docs + mixed, frozenset(len(docs) + k for k in going_on))
            at, start, length, on = sequences(words.kind.a[rows])
            if not len(at):
                continue
            types, inverse = np.unique(rows[at], return_inverse=True)
            size = words.length.a[types]
            feature = words.feature.a[spread(words.start.a[types], size)]
            cut, root = np.cumsum(size) - size, np.sqrt(size).astype(np.float32)[:, None]
            e = (np.add.reduceat(weights[feature], cut, 0) / root)[inverse]
            post, both, _ = posteriors(e, start, length, on, trans, pairs=True)
            gold = np.array(gold_of + mixed_of)[doc[at]]
            miss = -post
            miss[np.arange(len(at)), gold] += 1
            by_type = np.stack([np.bincount(inverse, miss[:, j], len(types)) for j in range(k)], 1) / root
            flat = np.repeat(by_type, size, 0)
            used, back = np.unique(feature, return_inverse=True)
            g = np.stack([np.bincount(back, flat[:, j], len(used)) for j in range(k)], 1) / len(at) - l2 * weights[used]
            sum_w[used] += (g * 100) ** 2
            weights[used] += (rate * 100 * g / np.sqrt(sum_w[used])).astype(np.float32)
            seen = np.zeros((k, k))
            inner = np.ones(len(at), bool)
            inner[start[~on]] = False
            np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            g = (seen - both) / len(at)
            sum_t += (g * 100) ** 2
            trans += (rate * 100 * g / np.sqrt(sum_t)).astype(np.float32)
            np.clip(trans, -6, 6, trans)
    return Model(langs, lexicon, weights, trans.astype(np.float32))


def switched(docs: list[str], labels: list[int], draw: np.random.Generator, stretches: int = 4) -> tuple[list[str], list[int], list[int]]:
    """Lines that go through several languages: stretches of the texts, their labels and which of them go on in the next one."""
    texts, of, going_on = [], [], []
    if len(set(labels)) < 2:
        return texts, of, going_on
    split = [x.split() for x in docs]
    for _ in range(max(1, len(docs) // 2)):
        for k in range(stretches):
            i = int(draw.integers(len(docs)))
            first = int(draw.integers(max(len(split[i]), 1)))
            texts.append(" ".join(split[i][first : first + int(draw.integers(2, 25))]))
            of.append(labels[i])
            if k < stretches - 1:
                going_on.append(len(texts) - 1)
    return texts, of, going_on


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def sample(docs: DataFrame, key: str = "doc_id", per_lang: int = 300, bound: int = 40_000) -> list[tuple[str, str]]:
    """At most about per_lang texts a language (less where there are very many languages), by a hash of the id; docs holds what may be learned from."""
    usable = docs.select(F.col(key).alias("id"), "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    number = usable.groupBy("lang").count()
    n = number.count()
    quota = max(1, min(per_lang, bound // max(n, 1)))
    order = F.xxhash64(F.col("id").cast("string"), F.lit("langid"))
    # First a cut by the hash, with room to spare, then the least hashes of each language.
    share = F.least(F.lit(1.0), (F.lit(quota) + 4 * F.sqrt(F.lit(float(quota))) + 10) / F.col("count"))
    near = usable.join(F.broadcast(number) if n <= bound else number, "lang").withColumn("h", order).where(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = near.withColumn("r", rank).where(F.col("r") <= quota).select("text", "lang").collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, lang_pred and score of every text."""
    names = list(dict.fromkeys([key, *keep]))
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in names), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        words = Words(model.lexicon, model.weights)

        def step(batch: pa.RecordBatch):
            found = [model.predict(words, part) for part in in_slices(texts(batch))]
            langs, score = [x for own, _ in found for x in own], np.concatenate([p for _, p in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

        return step

    return in_batches(docs.select(*dict.fromkeys([*names, "text"])), make, schema)


def languages(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learns from the rows whose crc32 of the id mod 5 is not 0, then predicts all."""
    model = train(sample(docs.where(id_mod(key, 5) != 0), key))
    return predict(docs, model, key, keep)
