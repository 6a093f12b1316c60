"""Near-duplicates: SimHash with bit-sliced comparison inside buckets, Jaccard after it; then connected components.

A bucket's fingerprints are stored as bit planes, 64 of them to a word. A query's distances to all
of them grow in carry-save counters, a plane at a time; a comparison stops once every counter has
passed the radius. Counters start so that passing the radius is the carry out of the top one.

Buckets follow from the pigeonhole principle (of r + 1 parts one is equal, twice over). A bucket
gives a spanning forest of its links, nearest first, so a group of m makes m - 1 links, not all
pairs. A large bucket is split again by the same principle.

Similar shingle sets are found exactly, too: first within the components of their SimHashes, then by a way that
misses none: shingles have one order, rare ones first, and two sets
of a Jaccard similarity share one of their first shingles, so many that the rest can't make it up.
What shares enough of them in small buckets, or a large bucket, meets in tiles of bounded size: first as parity
bitmaps, whose distance is never more than the number of shingles in which two sets differ, so that members like
no other one go; then on the whole sets, and each connected part gives a star, not its pairs.

Edge cases: a text with fewer words than a shingle is one shingle, one without words has fingerprint
zero; null texts count as empty; equal texts link; null ids count as no id (the smallest id of a
group leaves them out); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, in_batches, texts, written

TILE, SEED, ONES = 2048, 42, np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of size words, repeats included; words end at ASCII white space, A-Z are lower-cased."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(length) - length
    stop = start[size - 1 :] + length[size - 1 :] - 1
    return [joined[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the word whose bits are those set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], 0, dtype=np.int32)
        out[some] = np.packbits(2 * total > counts[some][:, None], axis=1).view(">u8").ravel()
    return out


def set_print(own: np.ndarray, block: int = 1 << 16) -> int:
    """The SimHash of a set of hashes, as a signed number."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(own), block):
        total += np.unpackbits(own[a : a + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own)).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", size: int = 3) -> DataFrame:
    """key and fp0 (a signed long), the SimHash of the shingles."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, fp0 long"

    def make():
        digest = xxhash.xxh64_intdigest

        def step(batch: pa.RecordBatch):
            lists = [shingles(text, size) for text in texts(batch)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            hashes = np.fromiter((digest(x, SEED) for own in lists for x in own), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(majority(hashes, counts).view(np.int64))], [key, "fp0"])

        return step

    return in_batches(docs.select(key, "text"), make, schema)


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes: bit b of the fingerprints, 64 fingerprints to a word; x has a row per fingerprint."""
    n, w = x.shape
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(n, 8 * w), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def near(x: np.ndarray, y: np.ndarray, radius: int, y_planes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows i of x and j of y differ in at most radius bits."""
    p = planes(y) if y_planes is None else y_planes
    own = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
    size = (radius + 1).bit_length()
    first = (1 << size) - (radius + 1)
    counter = [np.full((len(x), p.shape[1]), ONES if first >> i & 1 else 0, np.uint64) for i in range(size)]
    over = np.zeros((len(x), p.shape[1]), np.uint64)
    if len(y) % 64:
        over[:, -1] = ONES << np.uint64(len(y) % 64)
    rows = np.arange(len(x))
    for b in range(len(p)):
        carry = p[b] ^ np.where(own[rows, b, None], ONES, np.uint64(0))
        for c in counter:
            c ^= carry
            carry &= ~c
        over |= carry
        if b > radius and b % 8 == 7:  # queries whose whole block has passed the radius are abandoned
            going = (over != ONES).any(1)
            if not going.all():
                rows, over, counter = rows[going], over[going], [c[going] for c in counter]
                if not len(rows):
                    break
    hit = np.unpackbits((~over).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    i, j = np.nonzero(hit)
    return rows[i], j


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(1)


class Forest:
    """A union-find that keeps the links it merged by."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def merge(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The positions of the links that joined two trees, in the order given."""
        kept = []
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                kept.append(k)
        return np.array(kept, np.int64)


def links(x: np.ndarray, radius: int, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a bucket, nearest first.

    free: masks (a row of words per part) of bits in which the bucket may differ; given, a large
    bucket is split by them, which loses no link: of radius + 1 parts one is equal.
    """
    n = len(x)
    if free is not None and n > TILE and np.bitwise_count(free).sum() > 3 * (radius + 1):
        bits = [(w, b) for w in range(x.shape[1]) for b in range(64) if int(free[w]) >> b & 1]
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in np.array_split(np.arange(len(bits)), radius + 1):
            mask = np.zeros(x.shape[1], np.uint64)
            for w, b in (bits[k] for k in part):
                mask[w] |= np.uint64(1) << np.uint64(b)
            masked = x & mask
            order = np.lexsort(masked.T)
            cut = np.flatnonzero((np.diff(masked[order], axis=0) != 0).any(1)) + 1
            for group in np.split(order, cut):
                if len(group) > 1:
                    i, j = links(x[group], radius, free & ~mask)
                    found_i.append(group[i])
                    found_j.append(group[j])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
    else:
        i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, n, TILE):
            for b in range(a, n, TILE):
                p = planes(x[b : b + TILE])
                for q in range(a, min(a + TILE, n), 256):
                    s, t = near(x[q : q + 256], x[b : b + TILE], radius, p)
                    s, t = s + q, t + b
                    k = s < t
                    i, j = np.concatenate([i, s[k]]), np.concatenate([j, t[k]])
                    if len(i) > 8 * n + 65_536:
                        i, j = spanning(x, i, j)
    return spanning(x, i, j)


def spanning(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(i):
        return i, j
    order = np.lexsort([j, i, popcount(x[i] ^ x[j])])
    kept = order[Forest(len(x)).merge(i[order], j[order])]
    return i[kept], j[kept]


def bucket_links(rows: DataFrame, masks: list[tuple[int, ...]], radius: int, id_type: str) -> DataFrame:
    """Links (a, b) between ids of rows (id, fp0, ...), from the buckets that each of the masks makes."""
    words = len(masks[0])
    fps = [f"fp{i}" for i in range(words)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(t).alias("t"), *(F.col(f).bitwiseAND(F.lit(signed(m))).alias(f"k{i}") for i, (f, m) in enumerate(zip(fps, mask, strict=True)))) for t, mask in enumerate(masks)])
    by = ["t", *(f"k{i}" for i in range(words))]
    dealt = rows.select("id", *fps, F.explode(keys).alias("k")).select("id", *fps, "k.*")
    dealt = dealt.withColumn("place", F.xxhash64(*by)).repartition("place").sortWithinPartitions("place", *by, *fps)
    bounded_batches(rows.sparkSession)
    whole = np.full(words, ONES, np.uint64)

    def run(batches):
        for part in whole_runs(batches, "place"):
            yield from done(part, np.stack([part.column(c).to_numpy() for c in by], 1))

    def done(part, k):
        if part.num_rows < 2:
            return
        x = np.stack([part.column(f).to_numpy() for f in fps], 1).view(np.uint64)
        change = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(k)))
        found_i, found_j = [], []
        group, of = np.cumsum(change) - 1, None
        small = size <= 8
        for step in range(1, 8):  # tiny buckets side by side
            a = np.arange(len(k) - step)
            a = a[(group[a] == group[a + step]) & small[group[a]]]
            a = a[popcount(x[a] ^ x[a + step]) <= radius]
            found_i.append(a)
            found_j.append(a + step)
        for g in np.flatnonzero(~small).tolist():
            s = slice(int(start[g]), int(start[g] + size[g]))
            fixed = np.array([np.uint64(m) for m in masks[int(k[s.start, 0])]], np.uint64)
            i, j = links(x[s], radius, whole & ~fixed)
            found_i.append(i + s.start)
            found_j.append(j + s.start)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if len(i):
            of = part.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([of.take(pa.array(i)), of.take(pa.array(j))], ["a", "b"])

    found = dealt.mapInArrow(run, f"a {id_type}, b {id_type}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def exact_masks(radius: int, bits: int = 64) -> list[tuple[int, ...]]:
    """Pigeonhole twice: one of radius + 1 parts is equal, and of the rest again one of radius + 1."""
    out = []
    parts = [p.tolist() for p in np.array_split(np.arange(bits), radius + 1)]
    for part in parts:
        rest = [b for b in range(bits) if b not in part]
        for more in np.array_split(np.array(rest), radius + 1):
            mask = sum(1 << b for b in [*part, *more.tolist()])
            out.append(tuple(mask >> 64 * w & int(ONES) for w in range(bits // 64)))
    return out


def components(links: DataFrame) -> DataFrame:
    """(v, root): the least id that each id of the links (a, b) reaches, by large stars and small stars in turn.

    An id hands its greater neighbours to the least one (large), then its lesser ones (small), until
    only stars are left; no number of rounds is fixed, and it grows with the logarithm of a chain's length.
    Every round is a written table, so lineage stays short and a lost executor costs one round at most.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    while not stars(edges):
        both = edges.union(edges.select("u", "v"))
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))
        large = written(edges.select(F.col("u").alias("x"), F.col("v").alias("w")).join(least.withColumnRenamed("v", "x"), "x").select(F.col("w").alias("v"), F.col("m").alias("u")).distinct(), "links")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least).distinct()
        made = written(small, "links")
        dropped(edges)
        dropped(large)
        edges = made
    return edges.select("v", F.col("u").alias("root")).union(edges.select("u", "u").distinct())


def stars(edges: DataFrame) -> bool:
    """Whether each v of the edges (v, u) has one u, and no u is a v."""
    chained = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
    return not chained and not edges.groupBy("v").count().where("count > 1").limit(1).count()


def rooted(rows: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """rows with root, the least fingerprint that fp0 reaches by links of at most radius bits; prints has every fp0 once."""
    label = components(bucket_links(prints.select(F.col("fp0").alias("id"), "fp0"), exact_masks(radius), radius, "long"))
    return rows.join(label.withColumnRenamed("v", "fp0"), "fp0", "left").withColumn("root", F.coalesce("root", "fp0"))


def groups(docs: DataFrame, key: str = "doc_id", size: int = 3, radius: int = 2) -> DataFrame:
    """key, fingerprint (hex) and component_id, the least key reachable by links of at most radius bits. Exact."""
    prints = written(fingerprints(docs, key, size), "prints")
    classes = prints.groupBy("fp0").agg(F.min(key).alias("least"))
    found = written(rooted(classes, classes, radius), "rooted")
    smallest = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.select("fp0", "root").join(smallest, "root").select("fp0", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp0"), 16, "0"))
    return prints.join(named, "fp0").select(key, hexed.alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, size: int, sample: int = 5000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (in order) and counts of shingles that stand in several texts of a sample.

    They only order the shingles: with any other sample the same pairs are found, at another cost.
    """
    every = max(1, docs.count() // sample)
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()

    def make():
        def step(batch: pa.RecordBatch):
            for text in texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(hashed(shingles(text, size)).view(np.int64))], ["token"])

        return step

    counts = in_batches(drawn, make, "token long").groupBy("token").agg(F.count("*").alias("c")).where("c > 2")
    rows = counts.orderBy(F.desc("c"), "token").limit(most).collect()
    token, c = np.array([r["token"] for r in rows], np.int64).view(np.uint64), np.array([r["c"] for r in rows], np.int64)
    order = np.argsort(token)
    return token[order], c[order]


def hashed(own: list[bytes]) -> np.ndarray:
    """The set of shingles as hashes in order."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))


def parities(own: np.ndarray) -> bytes:
    """A bit for each residue of a hash, set where an odd number of members has it; 2 to 4 bits a member, a power of two.

    Two sets differ in at least as many members as their bitmaps do in bits; halves put together by exclusive or
    are the bitmap of half the width.
    """
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_part(n: int, similarity: float) -> int:
    """How many members of a set of n a set at the similarity must share."""
    return math.ceil(similarity * n - 1e-6)


def rare_first(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    token, c = common
    if not len(token):
        return own
    at = np.searchsorted(token, own).clip(max=len(token) - 1)
    return own[np.lexsort((own, np.where(token[at] == own, c[at], 0)))]


def prefixes(docs: DataFrame, key: str, size: int, similarity: float) -> DataFrame:
    """key, text_hash, set_hash, n, prefix, bits and fp0: the size of the shingle set, its first hashes, its parities and its SimHash.

    Sets at the similarity share one of these: n less what they must share, and one.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def make():
        common = shared.value

        def step(batch: pa.RecordBatch):
            named, sizes, first, bits, prints = [], [], [], [], []
            for text in texts(batch):
                own = list(set(shingles(text, size)))
                named.append(xxhash.xxh3_128_hexdigest(b"".join(sorted(xxhash.xxh3_128_digest(x) for x in own))))
                own = hashed(own)
                sizes.append(len(own))
                first.append(rare_first(own, common)[: len(own) - least_part(len(own), similarity) + 1].tobytes())
                bits.append(parities(own))
                prints.append(set_print(own))
            made = pa.array(named, pa.string()), pa.array(sizes, pa.int32()), pa.array(first, pa.binary()), pa.array(bits, pa.binary()), pa.array(prints, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("text_hash"), *made], [key, "text_hash", "set_hash", "n", "prefix", "bits", "fp0"])

        return step

    return in_batches(docs.select(key, "text", F.xxhash64("text").alias("text_hash")), make, f"`{key}` {kind}, text_hash long, set_hash string, n int, prefix binary, bits binary, fp0 long")


def whole_runs(batches, name: str):
    """Tables in which no run of equal values is cut; rows come in ascending order of the column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(name).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut == 0 and held and held[-1].column(name)[0].as_py() == k[-1]:
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(k)))


def shared_shingles(classes: DataFrame) -> DataFrame:
    """(token, number, n): the first shingles of every class, where another class has the same one."""

    def make():
        def step(batch: pa.RecordBatch):
            token = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
            length = np.fromiter(map(len, token), np.int64, len(token))
            number, n = (np.repeat(batch.column(c).to_numpy(), length) for c in ("number", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(number), pa.array(n)], ["token", "number", "n"])

        return step

    def several(batches):
        held, met = None, False  # the last row so far, and whether the one before it has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            k = part.column("token").to_numpy()
            same = k[1:] == k[:-1]
            before, after = np.concatenate([[met], same]), np.concatenate([same, [False]])
            yield part.slice(0, len(k) - 1).filter(pa.array((before | after)[:-1]))
            held, met = part.slice(len(k) - 1), bool(before[-1])
        if held is not None and met:
            yield held

    dealt = in_batches(classes.select("number", "n", "prefix"), make, "token long, number long, n int").repartition("token")
    return dealt.sortWithinPartitions("token").mapInArrow(several, "token long, number long, n int")


def bucket_sizes(shared: DataFrame) -> DataFrame:
    """(token, m): how many classes have the token among their first shingles."""
    return shared.groupBy("token").agg(F.count("*").alias("m"))


def sharing_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, na, nb, c): classes that share c of the tokens of rows (token, number, n), and their sizes, na <= nb."""

    def run(batches):
        for part in whole_runs(batches, "token"):
            number, n = (part.column(c).to_numpy() for c in ("number", "n"))
            start, size = run_starts(part.column("token").to_numpy())
            group = np.repeat(np.arange(len(start)), size)
            for away in range(1, int(size.max(initial=1))):
                i = np.arange(len(n) - away)
                i = i[(group[i] == group[i + away]) & (n[i] >= similarity * n[i + away] - 1e-6)]
                j = i + away
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number[i], number[j], n[i], n[j])], ["a", "b", "na", "nb"])

    dealt = rows.select("token", "number", "n").repartition("token").sortWithinPartitions("token", "n", "number")
    bounded_batches(rows.sparkSession)
    return dealt.mapInArrow(run, "a long, b long, na int, nb int").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))


def hub_groups(large: DataFrame) -> DataFrame:
    """(hub, number, n): the classes of each large bucket under its hub, once each.

    The hub of a bucket is the class that stands in most large buckets: of a text and its edited copies the least
    edited one, whose rare shingles all are common to the group. So the buckets of one group mostly have one hub,
    and two classes that share a large bucket share a hub.
    """
    score = large.groupBy("number").agg(F.count("*").alias("score"))
    hub = large.join(score, "number").groupBy("token").agg(F.max(F.struct("score", "number")).alias("h")).select("token", F.col("h.number").alias("hub"))
    return large.join(hub, "token").select("hub", "number", "n").distinct()


def print_groups(classes: DataFrame, radius: int) -> DataFrame:
    """(hub, number, n): the classes that links of at most radius bits between their SimHashes connect, under the root of their component."""
    found = written(rooted(classes.select("number", "n", "fp0"), classes.select("fp0").distinct(), radius).select(F.col("root").alias("hub"), "number", "n"), "rooted")
    return found.join(found.groupBy("hub").count().where("count > 1").select("hub"), "hub", "left_semi")


def main_groups(groups: DataFrame) -> DataFrame:
    """(hub, number, n): every class in the largest of its groups only."""
    size = groups.groupBy("hub").agg(F.count("*").alias("m"))
    return groups.join(size, "hub").groupBy("number", "n").agg(F.max(F.struct("m", "hub")).alias("g")).select(F.col("g.hub").alias("hub"), "number", "n")


def unjoined(groups: DataFrame, ids: DataFrame, label: DataFrame) -> DataFrame:
    """(hub, number, n, part): the groups whose classes lie in several components; ids has number and id, label v (an id) and root."""
    root = ids.join(label.select(F.col("v").alias("id"), "root"), "id", "left").select("number", F.xxhash64(F.coalesce("root", "id")).alias("part"))
    found = groups.join(root, "number")
    several = found.groupBy("hub").agg((F.min("part") < F.max("part")).alias("several")).where("several").select("hub")
    return found.join(several, "hub", "left_semi").select("hub", "number", "n", "part")


def in_tiles(groups: DataFrame, tile: int, tile_shingles: int) -> DataFrame:
    """The rows of groups with i and j, the two tiles that meet; a row comes once for each tile of its group.

    A group is cut into tiles of about `tile` classes or `tile_shingles` shingles, and each two tiles meet in one task,
    so no task holds more, however large a group is.
    """
    size = groups.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / tile_shingles)).cast("int").alias("tiles"))
    own = groups.join(size, "hub").withColumn("tile", F.pmod(F.xxhash64("number"), F.col("tiles")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select(*groups.columns, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))


def fitting(groups: DataFrame, classes: DataFrame, similarity: float, tile: int = 2048, tile_shingles: int = 1 << 22) -> DataFrame:
    """(hub, number, n): the rows of groups (hub, number, n, part) that may be similar to a row of their hub with another part.

    The bound is that of the parities, so no row of a similar pair is left out; classes has number and bits.
    """
    met = in_tiles(groups, tile, tile_shingles).join(classes.select("number", "bits"), "number")
    dealt = met.select(F.xxhash64("hub", "i", "j").alias("place"), "hub", "number", "n", "part", "bits").repartition("place").sortWithinPartitions("place")
    bounded_batches(groups.sparkSession)

    def run(batches):
        for table in whole_runs(batches, "place"):
            start, size = run_starts(table.column("place").to_numpy())
            n, part = table.column("n").to_numpy(), table.column("part").to_numpy()
            for s, m in zip(start.tolist(), size.tolist(), strict=True):
                bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").slice(s, m).to_pylist()]
                kept = table.slice(s, m).filter(pa.array(near_some(bits, n[s : s + m], part[s : s + m], similarity)))
                yield from kept.select(["hub", "number", "n"]).to_batches()

    return dealt.mapInArrow(run, "hub long, number long, n int").distinct()


def near_some(bits: list[np.ndarray], n: np.ndarray, part: np.ndarray, similarity: float, words: int = 1 << 19) -> np.ndarray:
    """Whether each set (parities, size, part) may be similar to one of another part.

    Sizes of similar sets differ by less than two, so their bitmaps have one width or one is twice the other.
    """
    near = np.zeros(len(n), bool)
    width = np.fromiter(map(len, bits), np.int64, len(bits))

    def meet(x: np.ndarray, y: np.ndarray, planes: np.ndarray, others: np.ndarray) -> None:
        step = max(1, words // (len(y) * planes.shape[1]))
        for first in range(0, len(x), step):
            a = x[first : first + step]
            at = np.flatnonzero(~near[y]) if near[a].all() else np.arange(len(y))
            b = y[at]
            fits = (np.minimum.outer(n[a], n[b]) >= similarity * np.maximum.outer(n[a], n[b]) - 1e-6) & (part[a][:, None] != part[b])
            if not fits.any():
                continue
            both = np.add.outer(n[a], n[b]).astype(np.int64)
            apart = np.bitwise_count(planes[first : first + step, None] ^ others[None, at]).sum(2, dtype=np.int64)
            fits &= apart <= both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-6).astype(np.int64)
            near[a[fits.any(1)]] = True
            near[b[fits.any(0)]] = True

    for w in np.unique(width).tolist():
        x, y = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        planes = np.stack([bits[k] for k in x])
        meet(x, x, planes, planes)
        if len(y):
            meet(x, y, planes, np.stack([bits[k][:w] ^ bits[k][w:] for k in y]))
    return near


def tile_links(groups: DataFrame, sets: DataFrame, similarity: float, tile: int = 1024, tile_shingles: int = 1 << 20) -> DataFrame:
    """(a, b): links that connect what is similar enough within each hub's group; sets has number, id and own.

    In a tile all pairs are compared on their whole sets, and each connected part gives a star instead of its pairs.
    """
    met = in_tiles(groups.select("hub", "number", "n"), tile, tile_shingles)
    dealt = met.join(sets, "number").select(F.xxhash64("hub", "i", "j").alias("place"), "id", "own").repartition("place").sortWithinPartitions("place")
    bounded_batches(groups.sparkSession)

    def run(batches):
        for part in whole_runs(batches, "place"):
            start, size = run_starts(part.column("place").to_numpy())
            for s, m in zip(start.tolist(), size.tolist(), strict=True):
                ids, own = part.column("id").slice(s, m).to_pylist(), part.column("own").slice(s, m).to_pylist()
                a, b = similar_stars([np.frombuffer(x, np.uint64) for x in own], similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in a]), pa.array([ids[k] for k in b])], ["a", "b"])

    return dealt.mapInArrow(run, "a string, b string")


def similar_stars(sets: list[np.ndarray], similarity: float, columns: int = 2048) -> tuple[list[int], list[int]]:
    """Of each part that links of the similarity connect, its first set with each other one."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, count = np.unique(np.concatenate(sets), return_counts=True)
    flat = flat[count > 1]
    rows = np.repeat(np.arange(len(sets)), n)
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(flat):
        at = np.searchsorted(flat, joined := np.concatenate(sets)).clip(max=len(flat) - 1)
        hit = flat[at] == joined
        rows, at = rows[hit], at[hit]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        for first in range(0, len(flat), columns):
            x, y = np.searchsorted(at, [first, first + columns])
            own = np.zeros((len(sets), min(columns, len(flat) - first)), np.float32)
            own[rows[x:y], at[x:y] - first] = 1
            both += own @ own.T
    link = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-6
    left, a, b = np.ones(len(sets), bool), [], []
    for k in range(len(sets)):
        if left[k]:
            new, left[k] = np.array([k]), False
            while len(new):
                new = np.flatnonzero(link[new].any(0) & left)
                left[new] = False
                a += [k] * len(new)
                b += new.tolist()
    return a, b


def joined(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def near_duplicates(docs: DataFrame, key: str = "doc_id", size: int = 5, similarity: float = 0.8, large: int = 16, radius: int = 3) -> DataFrame:
    """key, text_hash, class_id (texts with equal shingle sets) and group_id of every row. Exact.

    Classes whose shingle sets have a Jaccard similarity of at least `similarity` are linked, and linked classes form
    groups. The sets' SimHashes, compared by bit planes in their buckets, bring together most of them: what their links
    of at most `radius` bits connect is compared first. Sets at the similarity may differ in more bits, so an exact way
    follows for the rest: similar classes share one of their first shingles. In buckets of at most `large` classes the
    pairs are counted, and what shares enough with a class is its group; a larger bucket is its hub's group. From groups
    of both kinds go, by their parities, members that are like no other one: long texts that only have a passage in
    common. Groups are compared in tiles of whole sets, in three rounds: the components of the SimHashes, then of the
    other groups members that may be like one which isn't connected with them, each in its largest group alone, then
    those of which that still holds. What is connected already can't change what is connected, so most sets are sent once.
    """
    prints = written(prefixes(docs, key, size, similarity), "prints")
    classes = prints.groupBy(F.col("set_hash").alias("id")).agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("fp0").alias("fp0"), F.min(F.struct(key, "text_hash")).alias("least"))
    classes = written(classes.withColumn("number", F.xxhash64("id")), "classes")
    shared = written(shared_shingles(classes), "shared")
    sized = shared.join(bucket_sizes(shared), "token")
    least = F.ceil(F.lit(similarity) * F.col("nb") - 1e-6) - 1
    enough = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-6)
    # A pair that also shares a large bucket may be counted too low here; it is compared there.
    pairs = sharing_pairs(sized.where(F.col("m") <= large), similarity).where(F.col("c") + least >= enough)
    ends = F.array(F.struct(F.col("a").alias("number"), F.col("na").alias("n")), F.struct(F.col("b").alias("number"), F.col("nb").alias("n")))
    paired = pairs.select(F.col("a").alias("hub"), F.inline(ends)).distinct()
    met = written(paired.unionByName(hub_groups(sized.where(F.col("m") > large))).distinct(), "met")
    dropped(shared)
    groups = written(fitting(met.withColumn("part", F.col("number")), classes, similarity), "groups")
    dropped(met)
    alike = written(fitting(print_groups(classes, radius).withColumn("part", F.col("number")), classes, similarity), "groups")
    members = classes.join(groups.select("number").union(alike.select("number")).distinct(), "number", "left_semi")
    sets = written(whole_sets(docs, members, key, size), "sets")
    ids = written(sets.select("number", "id"), "ids")
    rounds = [written(tile_links(alike, sets, similarity), "links")]
    for chosen in (main_groups, lambda rest: rest):
        left = written(unjoined(groups, ids, components(joined(rounds))), "left")
        apart = written(fitting(left, classes, similarity), "groups")
        for done in (groups, left):
            dropped(done)
        groups = apart
        rounds.append(written(tile_links(chosen(groups), sets, similarity), "links"))
    for done in (groups, alike, classes, sets, ids):
        dropped(done)
    label = components(joined(rounds))
    for done in rounds:
        dropped(done)
    return prints.join(label.select(F.col("v").alias("set_hash"), "root"), "set_hash", "left").select(key, "text_hash", F.col("set_hash").alias("class_id"), F.coalesce("root", "set_hash").alias("group_id"))


def whole_sets(docs: DataFrame, classes: DataFrame, key: str, size: int) -> DataFrame:
    """number, id and own (the hashes of the shingles, in order) of the classes, from one text of each."""
    row = lambda k, h: F.xxhash64(k, h).alias("row")
    wanted = classes.select("id", "number", row(F.col("least")[key], F.col("least")["text_hash"]))
    own = docs.select("text", row(F.col(key), F.xxhash64("text")))
    chosen = own.join(wanted, "row").dropDuplicates(["row"])

    def make():
        def step(batch: pa.RecordBatch):
            sets = [hashed(shingles(text, size)).tobytes() for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("id"), pa.array(sets, pa.binary())], ["number", "id", "own"])

        return step

    return in_batches(chosen.select("id", "number", "text"), make, "number long, id string, own binary")


def one_of_each(docs: DataFrame, key: str = "doc_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the least key (then text hash) stays.

    Of rows that agree in key and text one stays. Columns of any name are carried along.
    """
    named = near_duplicates(docs, key, size, similarity)
    kept = named.groupBy("group_id").agg(F.min(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("h"))).alias("least")).select("least.k", "least.h")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("own_key"), F.xxhash64("text").alias("own_hash"))
    left = rows.join(kept, F.col("own_key").eqNullSafe(F.col("k")) & (F.col("own_hash") == F.col("h")), "left_semi")
    return left.dropDuplicates(["own_key", "own_hash"]).select("row.*")
