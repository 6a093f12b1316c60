"""Token ids on disk under a Re-Pair grammar per shard, with random access.

A shard is a run of documents in order. compress() replaces frequent pairs of neighbouring ids by
nonterminals, many pairs a round, until no pair is frequent: the pairs of a round are ranked by their number (of
pairs that share a hash bin one waits; the last rounds count every pair by itself), and where two
occurrences overlap the better ranked one (then the left one) is replaced. The file format of a shard, little-endian: magic "RPAI", then nine uint32: version 1, first nonterminal, documents,
ids, rules, rounds, symbols, bytes of a symbol, partition's own number of the shard; then the
rules (two uint32 each), the first rule of each round (uint32), each rule's expansion length
(uint32), each document's number of ids (uint32), the expanded position of every 256th symbol
(uint32), and the symbols.

Edge cases: null and empty texts are documents of the end id alone; documents of equal key stay
apart, in the order of their texts' hash; null keys come first; a document is never cut, so a shard
holds one document at least; no documents give no shards; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import operator
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ChunkCache
from .common import bounded_batches, in_slices, spread, texts, work_dir

#: Odd factors of the hash in turn, so that what a bin hides in one round it shows in another.
MIX = (0x5851F42D4C957F2D, 0x1D8E4E27C47D124F, 0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD)
ID = operator.attrgetter("id")
#: Stands between pieces while they are mapped: no text holds half of a surrogate pair.
APART = "\ud800"
MAGIC, HEAD, STEP = b"RPAI", struct.Struct("<4s9I"), 256


def compress(ids: np.ndarray, base: int, rounds: int | None = None, each: int = 2048, least: int = 8, bins: int = 18) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Rules (pairs of symbols), the first rule of each round and the symbols left.

    base: the first nonterminal, above all ids. Rounds go on until no pair has `least` occurrences (or as many rounds
    are done as asked for). A rule takes 12 bytes and symbols from 65,536 on take 4 instead of 2, so rules
    for rarer pairs make a shard larger: with 2 occurrences one of 262,144 ids took 704,644 bytes instead of 374,486.

    A replaced pair's right symbol leaves a hole. A round looks only at the pairs of `live`, by their left symbols: those
    that the rounds before found in a frequent bin, and those next to a symbol of the last round. Any other pair
    is rare for good, as a pair of symbols that are there already never comes to stand anywhere anew.
    """
    seq, rules, firsts, top = ids.astype(np.int64), [], [], base
    n = left = len(seq)
    after, before, here = np.arange(1, n + 1), np.arange(-1, n), np.ones(n, bool)
    live = np.arange(max(n - 1, 0))
    for turn in range(rounds) if rounds is not None else itertools.count():
        if left < 2 * least:
            break
        some_bins = max(1, min(bins, len(live).bit_length()))
        key = seq.take(live) if turn else seq[:-1].copy()
        key <<= 32
        key |= seq.take(after.take(live)) if turn else seq[1:]
        h = key * np.int64(MIX[turn % len(MIX)])
        h >>= 64 - some_bins
        h &= (1 << some_bins) - 1
        whole = np.flatnonzero((np.bincount(h, minlength=1 << some_bins) >= least).take(h))  # a frequent pair's bin is frequent
        live, key, h = live.take(whole), key.take(whole), h.take(whole)
        pair = np.zeros(1 << some_bins, np.int64)
        pair[h] = key  # of pairs that share a bin one counts now
        mine = np.flatnonzero(pair.take(h) == key)
        some, h = live.take(mine), h.take(mine)
        number = np.bincount(h, minlength=1 << some_bins)
        often = np.flatnonzero(number >= least)
        if not len(often):  # none in the bins: every pair by itself
            some = live
            pair, h, number = np.unique(key, return_inverse=True, return_counts=True)
            often = np.flatnonzero(number >= least)
        best = often[np.argsort(-number[often], kind="stable")[:each]]
        if not len(best):
            break
        place = np.full(len(pair), each, np.int32)
        place[best] = np.arange(len(best))
        rank = place.take(h)
        at = np.flatnonzero(rank < each)
        rank, at = rank[at], some[at]
        beside = after[at[:-1]] == at[1:]
        start = np.concatenate([[True], ~beside | (rank[1:] != rank[:-1])])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        free, chosen = run % 2 == 0, np.zeros(len(at), bool)  # in a run of one symbol every other pair
        for _ in range(8):  # the best of each run of overlapping occurrences; what is left then may wait for the next round
            r, win = np.where(free, rank, each), free.copy()
            win[1:] &= ~beside | (r[1:] < np.where(free[:-1], r[:-1], each + 1))
            win[:-1] &= ~beside | (r[:-1] <= r[1:])
            if not win.any():
                break
            chosen |= win
            free &= ~win
            free[1:] &= ~(win[:-1] & beside)
            free[:-1] &= ~(win[1:] & beside)
        spot, rank = at[chosen], rank[chosen]
        if not len(spot):
            break
        got = np.bincount(rank, minlength=each)
        used = np.flatnonzero(got)
        new = (np.cumsum(got > 0) - 1)[rank]
        ruled = pair[best[used]]
        firsts.append(top)
        rules.append(np.stack([ruled >> 32, ruled & 0xFFFFFFFF], 1))
        gone = after[spot]
        seq[spot], here[gone] = top + new, False
        after[spot] = after[gone]
        before[after[gone]] = spot
        flag = np.zeros(n + 1, bool)  # the last one for the place before the first symbol
        flag[live] = flag[spot] = flag[before[spot]] = True
        flag[gone] = flag[-1] = False
        live = np.flatnonzero(flag)
        live = live[after[live] < n]
        left, top = left - len(spot), top + len(used)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), firsts, seq[here]


def lengths(rules: np.ndarray, firsts: list[int], base: int) -> np.ndarray:
    """How many ids each rule stands for, round by round."""
    out, cuts = np.zeros(len(rules), np.int64), [f - base for f in firsts] + [len(rules)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        side = rules[a:b]
        out[a:b] = np.where(side < base, 1, out[np.maximum(side - base, 0)]).sum(1)
    return out


def expand(seq: np.ndarray, rules: np.ndarray, firsts: list[int], base: int) -> np.ndarray:
    """The ids behind symbols: the rounds undone, the last one first."""
    seq = seq.astype(np.int64)
    for first in reversed(firsts):
        hit = seq >= first
        at = np.cumsum(hit) - hit + np.arange(len(seq))
        out = np.empty(len(seq) + int(hit.sum()), np.int64)
        pair = rules[seq[hit] - base]
        out[at[~hit]] = seq[~hit]
        out[at[hit]], out[at[hit] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def pack(ids: np.ndarray, counts: np.ndarray, base: int, number: int = 0, rounds: int | None = None) -> bytes:
    """A shard as bytes."""
    rules, firsts, seq = compress(ids, base, rounds)
    size = lengths(rules, firsts, base)
    each = np.where(seq < base, 1, size[np.maximum(seq - base, 0)]) if len(rules) else np.ones(len(seq), np.int64)
    at = (np.cumsum(each) - each)[::STEP]
    wide = 2 if base + len(rules) <= 1 << 16 else 4
    head = HEAD.pack(MAGIC, 1, base, len(counts), len(ids), len(rules), len(firsts), len(seq), wide, number)
    return b"".join([head, *(np.asarray(x).astype("<u4").tobytes() for x in (rules, firsts, size, counts, at)), seq.astype(f"<u{wide}").tobytes()])


class Shard:
    """A packed shard: all() gives its ids, document(k) one document without expanding the others."""

    def __init__(self, raw: bytes):
        magic, version, self.base, docs, self.n, m, rounds, symbols, wide, self.number = HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of version 1")
        at = HEAD.size

        def take(k: int, kind: str = "<u4") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, k, at)
            at += out.nbytes
            return out

        self.rules = take(2 * m).astype(np.int64).reshape(-1, 2)
        self.firsts = take(rounds).tolist()
        self.size, self.counts = take(m).astype(np.int64), take(docs).astype(np.int64)
        self.step = take(-(-symbols // STEP)).astype(np.int64)
        self.seq = take(symbols, f"<u{wide}").astype(np.int64)

    def all(self) -> np.ndarray:
        """Every rule is expanded once; symbols are then looked up."""
        rule = self.seq >= self.base
        length, start = np.ones(len(self.seq), np.int64), self.seq.copy()
        if rule.any():
            told = expand(np.arange(self.base, self.base + len(self.rules)), self.rules, self.firsts, self.base)
            at = self.base + np.cumsum(self.size) - self.size
            length[rule], start[rule] = self.size[self.seq[rule] - self.base], at[self.seq[rule] - self.base]
            return np.concatenate([np.arange(self.base), told])[spread(start, length)]
        return start

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from the step below its start on."""
        start = int(self.counts[:k].sum())
        stop = start + int(self.counts[k])
        j = (int(np.searchsorted(self.step, start, "right")) - 1) * STEP
        part = self.seq[j : int(np.searchsorted(self.step, stop)) * STEP]
        skip = start - int(self.step[j // STEP]) if len(self.step) else 0
        return expand(part, self.rules, self.firsts, self.base)[skip : skip + stop - start]


class LibraryEncoder:
    """Ids as the tokenizers library gives them: its model behind a cache of pieces.

    A text that holds one of the tokenizer's added tokens is encoded by the library as a whole, and so is every text if
    the tokenizer normalizes what it reads. The model takes a piece in the byte-level alphabet: printable Latin-1 stands
    for itself, other bytes for U+0100 on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
        self.letters = dict(zip([*plain, *(b for b in range(256) if b not in plain)], map(chr, [*plain, *range(256, 512 - len(plain))]), strict=True))
        self.apart = "".join(map(self.letters.get, APART.encode("utf-8", "surrogatepass")))
        self.cache = ChunkCache(PATTERN, self.merged, 800_000)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("" if self.tokenizer.normalizer is not None else "|".join(added) or r"(?!)")

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, length = [], []
        for part in in_slices(pieces, 512):
            mine, n = [], []
            for found in map(self.merge, self.mapped(part)):  # a token of the library is an object: none is kept
                n.append(len(found))
                mine += map(ID, found)
            ids.append(np.array(mine, np.uint32))
            length.append(np.array(n, np.int64))
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(length or [np.zeros(0, np.int64)])

    def mapped(self, pieces: list[str]) -> list[str]:
        """The pieces in the byte-level alphabet, all at once."""
        return APART.join(pieces).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters).split(self.apart)

    def __call__(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        odd = [k for k, x in enumerate(given) if self.whole.search(x)]
        if not odd:
            return self.cache(given)
        apart = set(odd)
        ids, n = self.cache([x for k, x in enumerate(given) if k not in apart])
        own = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        parts = [self.tokenizer.encode(x, add_special_tokens=False).ids if k in apart else next(own) for k, x in enumerate(given)]
        return np.concatenate([np.asarray(p, np.uint32) for p in parts]), np.fromiter(map(len, parts), np.int64, len(parts))


@functools.lru_cache(2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each tokenizer and worker."""
    return LibraryEncoder(path)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, key: str = "doc_id", base: int | None = None, shard_ids: int = 1 << 18, rounds: int | None = None) -> None:
    """Encodes the texts and writes shards to path, ordered by key over all partitions.

    One range shuffle of the texts; every further step is streaming within a partition. base is a number above all
    ids, by default the first one above the tokenizer's. A row of the table is a shard: its partition, its number there,
    the ids before it in the partition, its documents' keys and the packed bytes.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    schema = f"part int, shard int, before long, n_ids long, keys array<{kind}>, shard_bytes binary"
    bounded_batches(spark)
    if base is None:
        from tokenizers import Tokenizer

        base = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1

    def run(batches):
        encode, part = library_encoder(tokenizer), TaskContext.get().partitionId()
        ids, counts, keys, held, before, shard = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, counts, keys, held, before, shard
            n = np.array(counts)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before]), pa.array([held]), pa.array([keys]), pa.array([pack(np.concatenate(ids), n, base, shard, rounds)], pa.binary())]
            ids, counts, keys, before, held, shard = [], [], [], before + held, 0, shard + 1
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "before", "n_ids", "keys", "shard_bytes"])

        for batch in batches:
            given = texts(batch)
            made, n = encode(given)
            cut = np.concatenate([[0], np.cumsum(n)])
            for k, name in enumerate(batch.column(key).to_pylist()):
                ids.append(np.append(made[cut[k] : cut[k + 1]], np.uint32(end_id)))
                counts.append(len(ids[-1]))
                keys.append(name)
                held += counts[-1]
                if held >= shard_ids:
                    yield flush()
        if counts:
            yield flush()

    ranged = docs.select(key, "text").withColumn("_h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(key, "_h").sortWithinPartitions(key, "_h").select(key, "text")
    ranged.mapInArrow(run, schema).write.parquet(path)


def read_shards(spark, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: key, start, n_tokens, ids_crc32, shard_part, shard, position.

    The driver holds one number per partition of the writer, never one per shard or document.
    """
    shards = spark.read.parquet(path)
    sums = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offset, at = {}, 0
    for part, n in sums:
        offset[part], at = at, at + n
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    schema = f"{key} {kind}, start long, n_tokens long, ids_crc32 long, shard_part int, shard int, position int"
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["shard_bytes"])
                n, le = shard.counts, shard.all().astype("<u4")
                cut = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(le[cut[k] : cut[k + 1]]) for k in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array(cut[:-1] + offset[row["part"]] + row["before"]), pa.array(n), pa.array(crc, pa.int64()), pa.array([row["part"]] * len(n), pa.int32()), pa.array([row["shard"]] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32())],
                    [key, "start", "n_tokens", "ids_crc32", "shard_part", "shard", "position"],
                )

    return shards.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", **more) -> DataFrame:
    """Writes the shards to the shared folder and reads them back."""
    path = work_dir(docs.sparkSession, "shards")
    write_shards(docs, tokenizer, end_id, path, key, **more)
    return read_shards(docs.sparkSession, path, key)
