"""Shards of near equal bytes in which equal texts stay together: minimax contiguous partition of ordered groups.

A group is all rows of one text; its size is theirs, and groups stand in the order of a checksum of the text. A shard is
a range of that order, so that a text's shard can be told from the text and the cuts alone.

1. Giants, groups above an equal share of what is left, get a shard each, the largest first: they would set the
   capacity of all others.
2. The smallest capacity for which the other groups fit into the other shards is found by halving; a capacity is
   checked greedily, each shard filled as far as it goes.
3. Cuts are made with that capacity: each at the end of a group nearest to an equal share of what is left, but never
   so far that a shard exceeds the capacity, nor so early that the rest would.

The driver never sees all groups. It sees sums over blocks of the order, at most BLOCKS, and asks for finer ones only
where a cut may fall, until the answer is that of the single groups; each round is one sum over the narrow rows of the
table. All is DataFrame functions; a group of any number of copies is summed before the shuffle.

Null texts count as empty and are one group with them; rows of equal or null ids each get a slot; fewer groups than
shards leave the last shards empty; an empty table gives none; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of a text's place in the order, of the first blocks, and how many blocks a round may give.
BITS, FIRST, BLOCKS = 60, 16, 1 << 16
#: Bytes that each row counts besides its text; a fixed value.
PER_ROW = 8
#: Rows of a shard are numbered in about so many parts as it has thousands of rows, 2**16 at most.
PART_ROWS, PART_BITS = 1024, 16


def place(text: Column) -> Column:
    """A text's place in the order of groups. Texts that share one, which takes some 2**30 texts to happen, are one group."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def turn(key: Column, at: Column) -> Column:
    """Where a row stands within its shard: by a checksum, so that shards come shuffled and any number of tasks can number them."""
    own = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), at.cast("string"))
    return F.conv(F.substring(F.md5(own), 1, 8), 16, 10).cast("long")


@dataclass(frozen=True)
class Block:
    """The groups whose places, without their last `shift` bits, are `prefix`; `single` if that is known to be one group."""

    prefix: int
    shift: int
    size: int
    single: bool

    @property
    def start(self) -> int:
        return self.prefix << self.shift


class Coarse(Exception):
    """A cut falls inside blocks of several groups."""

    def __init__(self, blocks: set[int]):
        self.blocks = blocks


class Order:
    """What is known of the groups' sizes along their order: blocks, and their ends as running sums."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.ends = [0, *accumulate(b.size for b in blocks)]
        self.total = self.ends[-1]

    def inside(self, x: int) -> int | None:
        """The block that x falls inside of, not at its ends."""
        k = bisect_right(self.ends, x) - 1
        return k if self.ends[k] < x < self.total else None

    def floor(self, x: int, fluid: bool = False, unknown: set[int] | None = None) -> int:
        """The last end of a group up to x; inside a block of several groups x itself if they are fluid, else the block's start, and the block is noted as unknown."""
        if x >= self.total:
            return self.total
        k = self.inside(x)
        if k is None:
            return x
        if not self.blocks[k].single:
            if fluid:
                return x
            if unknown is not None:
                unknown.add(k)
        return self.ends[k]

    def ceil(self, x: int, unknown: set[int]) -> int:
        """The first end of a group from x on."""
        if x <= 0:
            return 0
        k = self.inside(x)
        if k is None:
            return min(x, self.total)
        if not self.blocks[k].single:
            unknown.add(k)
        return self.ends[k + 1]

    def filled(self, capacity: int, n: int, fluid: bool) -> list[int]:
        """Where n shards end if each is filled as far as it goes."""
        out, at = [], 0
        for _ in range(n):
            at = self.floor(at + capacity, fluid)
            out.append(at)
        return out

    def smallest(self, n: int, fluid: bool) -> int:
        """The smallest capacity with which n shards hold all, by halving."""
        lo, hi = -1, self.total
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.filled(mid, n, fluid)[-1] == self.total else (mid, hi)
        return hi

    def cuts(self, n: int) -> list[int]:
        """Where the first n - 1 of n shards end; raises Coarse where blocks are too coarse to tell."""
        least, most = self.smallest(n, True), self.smallest(n, False)
        if least < most:  # whatever a capacity between them would touch
            spans = zip(self.filled(least, n, False), self.filled(most, n, True), strict=True)
            touched = {k for a, b in spans for k in range(max(bisect_right(self.ends, a) - 1, 0), min(bisect_left(self.ends, b), len(self.blocks)))}
            raise Coarse({k for k in touched if not self.blocks[k].single})
        unknown: set[int] = set()
        needed = [self.total]  # how far the first shards have to reach, from the last one back
        for _ in range(n - 1):
            needed.append(self.ceil(needed[-1] - most, unknown))
        out, at = [], 0
        for k in range(1, n):
            fair = at + (self.total - at) // (n - k + 1)
            low, high = self.floor(fair, unknown=unknown), self.ceil(fair, unknown)
            near = low if fair - low <= high - fair else high
            if near <= at:
                near = self.ceil(at + 1, unknown)
            at = min(max(near, needed[n - k]), self.floor(at + most, unknown=unknown))
            out.append(at)
        if unknown:
            raise Coarse(unknown)
        return out


def summed(rows: DataFrame, shift: int) -> list[Block]:
    by = rows.groupBy(F.shiftright("place", shift).alias("b")).agg(F.sum("size").alias("size"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    return [Block(r.b, shift, r.size, r.lo == r.hi) for r in by.collect()]


def finer(rows: DataFrame, blocks: list[Block], wanted: set[int]) -> list[Block]:
    """The blocks, with those that are wanted replaced by smaller ones."""
    out = [b for k, b in enumerate(blocks) if k not in wanted]
    bits = max(1, (BLOCKS // len(wanted)).bit_length() - 1)
    for shift in {blocks[k].shift for k in wanted}:
        own = [blocks[k].prefix for k in wanted if blocks[k].shift == shift]
        out += summed(rows.where(F.shiftright("place", shift).isin(own)), max(0, shift - bits))
    return sorted(out, key=lambda b: b.start)


def giants(rows: DataFrame, blocks: list[Block], n: int) -> tuple[list[int], list[Block]]:
    """Places of the groups above an equal share of what they leave, the largest first; and the blocks without them."""
    places: list[int] = []
    while n - len(places) > 1:
        left, rest = n - len(places), sum(b.size for b in blocks)
        heavy = [b for b in blocks if b.size * left > rest]
        if not heavy:
            break
        if not all(b.single for b in heavy):
            blocks = finer(rows.where(~F.col("place").isin(places)), blocks, {k for k, b in enumerate(blocks) if b.size * left > rest and not b.single})
            continue
        top = min(heavy, key=lambda b: (-b.size, b.start))
        # A single block's groups have one place; it is found by what the block holds.
        places.append(rows.where(F.shiftright("place", top.shift) == top.prefix).select("place").first().place)
        blocks = [b for b in blocks if b is not top]
    return places, blocks


def plan(rows: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """Places of the groups that have a shard to themselves, and the places at which each further shard begins."""
    blocks = sorted(summed(rows, BITS - FIRST), key=lambda b: b.start)
    alone, blocks = giants(rows, blocks, n)
    others = rows.where(~F.col("place").isin(alone))
    while True:
        order = Order(blocks)
        try:
            ends = order.cuts(n - len(alone))
        except Coarse as coarse:
            blocks = finer(others, blocks, coarse.blocks)
            continue
        starts = [bisect_left(order.ends, e) for e in ends]
        return alone, [blocks[k].start if k < len(blocks) else 1 << BITS for k in starts]


def shard_of(at: Column, alone: list[int], begins: list[int]) -> Column:
    """The shard of a place: giants first, then the ranges between cuts."""
    own = F.coalesce(*(F.when(at == p, F.lit(k)) for k, p in enumerate(alone)), sum((F.when(at >= b, 1).otherwise(0) for b in begins), F.lit(len(alone))))
    return own.cast("int")


def narrow(docs: DataFrame, key: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col(key).alias("id"), (F.octet_length(text) + PER_ROW).cast("long").alias("size"), F.crc32(text).alias("crc"), place(text).alias("place"))


def numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (id, size, crc, place, shard) with slot: gapless within each shard, by turn, then id and place.

    Equal rows are counted first; each part of a shard is numbered on its own and starts after the parts before it.
    """
    bits = min(PART_BITS, max(0, n_rows // PART_ROWS).bit_length())
    counted = rows.groupBy("id", "size", "crc", "place", "shard").agg(F.count("*").alias("n"))
    at = counted.withColumn("turn", turn(F.col("id"), F.col("place"))).withColumn("part", F.shiftright("turn", 32 - bits))
    sums = at.groupBy("shard", "part").agg(F.sum("n").alias("own"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("turn", "id", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = at.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "part"])
    # Equal rows come apart again, in portions, however many they are.
    some = placed.withColumn("k", F.explode(F.expr("sequence(0, (n - 1) div 4096)")))
    each = some.withColumn("i", F.explode(F.expr("sequence(k * 4096, least(n, (k + 1) * 4096) - 1)")))
    return each.select("id", "size", "crc", "place", "shard", (F.col("base") + F.col("first") + F.col("i")).cast("long").alias("slot"))


def shards(docs: DataFrame, n: int = 24, key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row: shards of near equal bytes, 0 to n - 1, equal texts together."""
    rows = written(narrow(docs, key), "shards")
    alone, begins = plan(rows, n)
    done = numbered(rows.withColumn("shard", shard_of(F.col("place"), alone, begins)), rows.count())
    return done.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def shard_files(docs: DataFrame, folder: str, n: int = 24, key: str = "doc_id", file_rows: int = 1_000_000) -> DataFrame:
    """Writes the rows with all their columns below folder/shard=<number>, in the order of their slots, and reads them again.

    A shard is as many files as its rows need; their names ascend with the slots. A column that is called shard is
    replaced.
    """
    rows = written(narrow(docs, key), "shards")
    alone, begins = plan(rows, n)
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"), shard_of(place(docs.text), alone, begins).alias("shard"))
    by = ["shard", turn(F.col(key), place(F.col("text"))), F.col(key)]
    parts = max(n, -(-rows.count() // file_rows))
    own.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
