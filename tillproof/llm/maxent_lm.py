"""A hashed maximum-entropy language model whose softmax is factored into classes.

Every word has a code: a class, a smaller class inside it, and so on, with 16 ways at each level. The most
frequent words have codes of their own, by rank; all others share codes by their kind of characters,
their end and their beginning. P(code | history) is the product over the levels of softmaxes over hashed
features of the history and the code so far: the last word, the last two, and a skip to the second last. A
word that shares its code has its share of the code's training tokens. One outcome of each shared code stands
for all words never seen in training; it has the code's share of words seen once. So the model is a distribution
over the known words and these outcomes, as the base is one over the known words and one outcome for all
others.

Training is one pass over all training texts: each task takes AdaGrad steps on its own copy, the copies are
summed on the executors in two steps (at most the square root of the tasks' number meets in one place), and
each row is averaged over the tasks that touched it. The levels and the rows grow with the vocabulary up to
most_levels and most_rows, which bound what a task and the driver hold. Token counts are exact, over all
training texts, and grow with them: they are never collected. A task asks for the counts of the distinct rare
tokens of a block of texts, so the join moves a row per block and token, not per text and token.

Edge cases: a null or empty text is the end token alone; null ids are held out; texts of any length are
whole; equal rows get equal scores; without training texts N and V are 0 and the model is uniform;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grown, TokenCache, bounded_batches, in_batches, texts, written
from .langid import id_mod

END = b""
BITS, FAN = 4, 16
#: Of the first level's 16 classes these are for frequent words; the other five for kinds of characters.
FREQUENT = 11
FEATURES, CHUNK, STEP, BLOCK = 4, 4096, 8192, 4_000_000
SMOOTH = 0.1
ONES, WAYS = np.ones(FAN, np.float32), np.arange(FAN, dtype=np.int32)


@dataclass(frozen=True)
class Size:
    """Levels of a code and bits of a row number."""

    levels: int = 3
    row_bits: int = 16

    @property
    def codes(self) -> int:
        return FAN**self.levels

    @property
    def heads(self) -> int:
        """How many words have a code of their own."""
        return FREQUENT * self.codes // FAN

    @staticmethod
    def of(vocabulary: int, most_levels: int, most_rows: int) -> Size:
        bits = max(vocabulary, 1).bit_length()
        return Size(min(max(-(-(bits - 10) // BITS), 3), most_levels), min(max(bits // 2 + 5, 16), most_rows.bit_length() - 1))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case, then the end."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def shared_code(token: bytes, levels: int) -> int:
    """The code of a word that isn't frequent: kind of characters, then its end, then its beginning; it has a level less (a zero)."""
    if token.isascii():
        kind = 2 if not token.isalpha() else int(len(token) > 6)
    else:
        kind = 3 if max(token) < 0xE0 else 4
    code = (FREQUENT + kind) << BITS | zlib.crc32(token[-2:]) & FAN - 1
    for k in range(levels - 3):
        code = code << BITS | zlib.crc32(token[: 2 * k + 2], 1) & FAN - 1
    return code << BITS


class Features(TokenCache):
    """Token -> its hash, its code, and whether it shares the code."""

    def __init__(self, heads: dict[bytes, int], size: Size):
        super().__init__(600_000)
        self.heads, self.size = heads, size
        self.reset()

    def reset(self) -> None:
        self.hash, self.code, self.shared, self.word = Grown(np.uint64), Grown(np.int32), Grown(np.bool_), []

    @property
    def full(self) -> bool:
        """Whether the next call of rows() forgets all rows."""
        return len(self) > self.limit

    def fill(self, new: list[bytes]) -> None:
        h = np.fromiter(map(zlib.crc32, new), np.uint64, len(new))
        h = (h ^ h >> np.uint64(15)) * np.uint64(0x9E3779B97F4A7C15)
        own = [self.heads.get(t, -1) for t in new]
        self.hash.add(h ^ h >> np.uint64(31))
        self.code.add(np.fromiter((c if c >= 0 else shared_code(t, self.size.levels) for c, t in zip(own, new, strict=True)), np.int32, len(new)))
        self.shared.add(np.fromiter((c < 0 for c in own), np.bool_, len(new)))
        self.word += new

    def inputs(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed features of each token's history (a row each), the tokens' rows, and of which text each is."""
        rows = self.rows([t for own in lists for t in own])
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        of = np.repeat(np.arange(len(lists)), counts)
        h = self.hash.a[rows]
        place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        back = []
        for k in (1, 2):
            x = np.zeros(len(h), np.uint64)
            x[k:] = h[:-k]
            back.append(np.where(place >= k, x, np.uint64(k)))
        f = np.zeros((len(h), FEATURES), np.uint64)
        f[:, 1], f[:, 2] = back[0] + np.uint64(1), back[0] * np.uint64(31) + back[1] + np.uint64(2)
        f[:, 3] = back[1] * np.uint64(3) + np.uint64(3)
        return f, rows, of


class Weights:
    """A table of rows for each level: the weights of a hashed feature and the code so far, one for each way on."""

    def __init__(self, size: Size, tables: np.ndarray | None = None):
        self.size = size
        self.tables = np.zeros((size.levels, 1 << size.row_bits, FAN), np.float32) if tables is None else tables

    def places(self, f: np.ndarray, code: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the features at a level, and the way that the code takes there."""
        shift = BITS * (self.size.levels - 1 - level)
        node = (code >> (shift + BITS)).astype(np.uint64) + np.uint64(1 + level)
        x = f + (node * np.uint64(0x94D049BB133111EB))[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - self.size.row_bits)).astype(np.int64), code >> shift & FAN - 1

    def walk(self, f: np.ndarray, code: np.ndarray):
        """For each level: which of the outcomes have a way there, the rows of their features, and the ways."""
        for level in range(self.size.levels):
            if level < self.size.levels - 1:
                yield level, slice(None), *self.places(f, code, level)
            elif len(own := np.flatnonzero(code < self.size.heads)):
                yield level, own, *self.places(f[own], code[own], level)

    def exponents(self, level: int, rows: np.ndarray) -> np.ndarray:
        z = self.tables[level].take(rows[:, 0], 0)
        for k in range(1, rows.shape[1]):
            z += self.tables[level].take(rows[:, k], 0)
        np.clip(z, -40, 40, z)
        return z

    def log_prob(self, f: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(code | history)."""
        out = np.zeros(len(f))
        for a in range(0, len(f), STEP):
            for level, own, rows, way in self.walk(f[a : a + STEP], code[a : a + STEP]):
                z = self.exponents(level, rows)
                out[a : a + STEP][own] += z[np.arange(len(way)), way] - np.log(np.exp(z) @ ONES)
        return out


class Trainer:
    """AdaGrad on a task's own copy; the sum of squares is kept for each row."""

    def __init__(self, size: Size, rate: float = 1.0):
        self.w, self.rate = Weights(size), rate
        self.sums = np.full(self.w.tables.shape[:2], 1e-2, np.float32)
        self.met, self.place = np.zeros(1 << size.row_bits, bool), np.zeros(1 << size.row_bits, np.int32)

    def learn(self, f: np.ndarray, code: np.ndarray) -> None:
        for a in range(0, len(f), STEP):
            for level, _, rows, way in self.w.walk(f[a : a + STEP], code[a : a + STEP]):
                self.update(level, rows, way)

    def update(self, level: int, rows: np.ndarray, gold: np.ndarray) -> None:
        g = self.w.exponents(level, rows)
        np.exp(g, g)
        g *= (-1 / (g @ ONES))[:, None]
        g.ravel()[np.arange(0, g.size, FAN) + gold] += 1
        self.met[rows] = True
        used = np.flatnonzero(self.met)
        self.met[used] = False
        self.place[used] = np.arange(0, FAN * len(used), FAN, dtype=np.int32)
        total, flat = np.zeros(FAN * len(used)), g.ravel()
        for k in range(rows.shape[1]):
            total += np.bincount((self.place.take(rows[:, k])[:, None] + WAYS).ravel(), flat, len(total))
        total = total.astype(np.float32).reshape(-1, FAN)
        sums = self.sums[level]
        sums[used] += (total * total) @ ONES / FAN
        total *= (self.rate / rows.shape[1] / np.sqrt(sums[used]))[:, None]
        self.w.tables[level][used] += total


def sums_of(of: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Sums of x by text; doubles where nothing is summed, too."""
    return np.bincount(of, x, m).astype(np.float64)


def held_out(key: str):
    return id_mod(key, 10) == 0


def count_tokens(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(token, c) over all texts; tasks add up their own tokens before the shuffle."""

    def run(batches):
        own: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["token", "n"])
            own.clear()
            return out

        for batch in batches:
            for text in texts(batch):
                own.update(tokens(text))
            if len(own) >= most:
                yield flush()
        if own:
            yield flush()

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def code_totals(counts: DataFrame, heads: dict[bytes, int], size: Size) -> tuple[np.ndarray, np.ndarray]:
    """Of each code the training tokens of the words that share it, and how many of these were seen once."""

    def make():
        def step(batch: pa.RecordBatch):
            token, c = batch.column("token").to_pylist(), batch.column("c").to_numpy()
            code = np.fromiter((-1 if t in heads else shared_code(t, size.levels) for t in token), np.int64, len(token))
            code, c = code[code >= 0], c[code >= 0]
            used, of = np.unique(code, return_inverse=True)
            n, once = np.bincount(of, c, len(used)), np.bincount(of, c == 1, len(used))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n.astype(np.int64)), pa.array(once.astype(np.int64))], ["code", "n", "once"])

        return step

    rows = in_batches(counts, make, "code long, n long, once long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()
    n, once = np.zeros(size.codes), np.zeros(size.codes)
    for r in rows:
        n[r["code"]], once[r["code"]] = r["n"], r["once"]
    return n, once


def unseen_share(n: np.ndarray, once: np.ndarray) -> np.ndarray:
    return np.clip((once + 0.5) / (n + 1.0), 1e-6, 0.9)


def train(docs: DataFrame, heads: dict[bytes, int], size: Size) -> Weights:
    """One pass over the texts; the driver gets the averaged model, whose size is bounded."""
    per, narrow = (1 << size.row_bits) // CHUNK, "chunk int, part int, tasks int, change binary, touched binary"

    def run(batches):
        trainer, feature, seen = Trainer(size), Features(heads, size), False
        for batch in batches:
            f, rows, _ = feature.inputs([tokens(t) for t in texts(batch)])
            trainer.learn(f, feature.code.a[rows])
            seen = True
        part = math.isqrt(TaskContext.get().partitionId())
        for level in range(size.levels) if seen else ():
            touched = trainer.sums[level] > 1e-2
            for k in range(per):
                s = slice(k * CHUNK, (k + 1) * CHUNK)
                yield message(level * per + k, part, trainer.w.tables[level][s].astype(np.float16), touched[s].astype(np.uint32))

    def message(chunk: int, part: int, change: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
        row = [pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([change.dtype.itemsize], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([touched.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["chunk", "part", "tasks", "change", "touched"])

    def add(batches):
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["change"], np.float16 if r["tasks"] == 2 else np.float32).astype(np.float32).reshape(CHUNK, -1)
                n = np.frombuffer(r["touched"], np.uint32)
                k = r["chunk"], r["part"]
                total[k] = [total[k][0] + x, total[k][1] + n] if k in total else [x, n]
        for (chunk, part), (x, n) in total.items():
            yield message(chunk, part, x, n)

    bounded_batches(docs.sparkSession)
    changes = docs.select("text").mapInArrow(run, narrow)
    some = changes.repartition("chunk", "part").mapInArrow(add, narrow).withColumn("part", F.lit(0))
    out = Weights(size)
    for r in some.repartition("chunk").mapInArrow(add, narrow).collect():
        x, n = np.frombuffer(r["change"], np.float32).reshape(CHUNK, -1), np.frombuffer(r["touched"], np.uint32)
        level, k = divmod(r["chunk"], per)
        out.tables[level, k * CHUNK : (k + 1) * CHUNK] = x / np.maximum(n, 1)[:, None]
    return out


def packed(columns: dict[str, pa.Array]) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def blocks(docs: DataFrame, shared, key: str) -> DataFrame:
    """A table of two kinds of rows: what a block asks for (place, token, code) and a batch of its texts.

    shared: the broadcast (heads, their counts, size, weights, logarithm of the base's denominator). A batch holds what
    the frequent words make of each text, and the rare words of all its texts as places of the block, in the
    order of the texts. Often asked words have low places: their upper bytes are mostly zero and compress well.
    """
    names, none = ["block", "place", "token", "code", "texts", "low", "high"], pa.nulls
    bounded_batches(docs.sparkSession)

    def run(batches):
        heads, head_counts, size, weights, log_base = shared.value
        feature, part, number = Features(heads, size), TaskContext.get().partitionId(), 0
        base = np.log10(head_counts + SMOOTH) - log_base
        told, rare, n = [], [], 0

        def flush():
            nonlocal told, rare, number, n
            block = part << 32 | number
            times = np.bincount(np.concatenate(rare), minlength=len(feature.word))
            used = np.flatnonzero(times)
            used = used[np.argsort(-times[used], kind="stable")]
            k, place = len(used), np.zeros(len(times), np.int64)
            place[used] = np.arange(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.arange(k, dtype=np.int32)), pa.array([feature.word[i] for i in used.tolist()], pa.binary()), pa.array(feature.code.a[used]), *(none(k, pa.binary()) for _ in range(3))], names)
            for own, rows in zip(told, rare, strict=True):
                at = place[rows]
                raw = [packed(own), at.astype("<u2").tobytes(), (at >> 16).astype(np.uint8).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), none(1, pa.int32()), none(1, pa.binary()), none(1, pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names)
            told, rare, number, n = [], [], number + 1, 0

        for batch in batches:
            if told and (feature.full or n >= BLOCK):
                yield from flush()
            lists = [tokens(t) for t in texts(batch)]
            f, rows, of = feature.inputs(lists)
            code, tail = feature.code.a[rows], feature.shared.a[rows]
            p = weights.log_prob(f, code) / np.log(10)
            m, head = len(lists), of[~tail]
            frequent = np.bincount(head, minlength=m)
            size_of = np.fromiter(map(len, lists), np.int64, m)
            own = {"key": batch.column(key), "held_out": batch.column("held_out"), "n_tokens": pa.array(size_of), "n_heads": pa.array(frequent.astype(np.int64))}
            told.append(own | {"code_score": pa.array(sums_of(of, p, m)), "head_base": pa.array(sums_of(head, base[code[~tail]], m))})
            rare.append(rows[tail])
            n += len(rows)
        if told:
            yield from flush()

    return docs.select(key, "text", held_out(key).alias("held_out")).mapInArrow(run, "block long, place int, token binary, code int, texts binary, low binary, high binary")


def scores(docs: DataFrame, key: str = "doc_id", most_levels: int = 4, most_rows: int = 1 << 18) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    training = docs.where(~held_out(key))
    counts = written(count_tokens(training), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    size = Size.of(v, most_levels, most_rows)
    top = counts.orderBy(F.desc("c"), "token").limit(size.heads).collect()
    heads = {bytes(r["token"]): i for i, r in enumerate(top)}
    code_n, once = code_totals(counts, heads, size)
    weights = train(training, heads, size)
    log_base = float(np.log10(n + SMOOTH * (v + 1)))
    shared = spark.sparkContext.broadcast((heads, np.array([r["c"] for r in top], np.float64), size, weights, log_base))
    table = written(blocks(docs, shared, key), "blocks")
    asked = table.where("token is not null").select("block", "place", "token", "code")
    told = asked.join(counts, "token", "left").select("block", "place", "code", F.coalesce("c", F.lit(0)).alias("c"))
    rest = table.where("token is null").drop("token")
    dealt = told.unionByName(rest, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    bounded_batches(spark)
    lam = unseen_share(code_n, once)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        now, count, tail = None, Grown(np.int64), Grown(np.float64)
        for batch in batches:
            block = batch.column("block").to_numpy()
            asks = batch.column("place").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(block) != 0) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if now != block[a]:
                    now, count, tail = block[a], Grown(np.int64), Grown(np.float64)
                m = int(asks[a:b].sum())
                if m:
                    c, code = batch.column("c").slice(a, m).to_numpy(), batch.column("code").slice(a, m).to_numpy()
                    count.add(c)
                    tail.add(np.log10(np.where(c > 0, (1 - lam[code]) * np.maximum(c, 1) / np.maximum(code_n[code], 1), lam[code])))
                for k in range(a + m, b):
                    raw = [batch.column(x)[k].as_py() for x in ("texts", "low", "high")]
                    yield finished(pa.ipc.open_stream(raw[0]).read_next_batch(), np.frombuffer(raw[1], "<u2") | np.frombuffer(raw[2], np.uint8).astype(np.int64) << 16, count.a, tail.a)

    def finished(part: pa.RecordBatch, place: np.ndarray, count: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
        m = part.num_rows
        size_of, heads_n, code_score, head_base = (part.column(x).to_numpy() for x in ("n_tokens", "n_heads", "code_score", "head_base"))
        of = np.repeat(np.arange(m), size_of - heads_n)
        c = count[place]
        known = heads_n + np.bincount(of[c > 0], minlength=m)
        base = head_base + sums_of(of, np.log10(c + SMOOTH) - log_base, m)
        columns = [pa.array(known, pa.int64()), pa.array(np.full(m, n), pa.int64()), pa.array(base), pa.array(code_score + sums_of(of, tail[place], m))]
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("held_out"), part.column("n_tokens"), *columns], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.mapInArrow(run, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
