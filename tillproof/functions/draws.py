"""Draws of a linear congruential generator, any of them by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier, increment and modulus (as a mask); fixed values.
A, C, MASK = 1103515245, 12345, (1 << 31) - 1


def powers(bits: int = 31) -> list[tuple[int, int]]:
    """For each bit k the factor and summand of 2**k steps at once."""
    out, a, c = [], A, C
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a & MASK, (a * c + c) & MASK
    return out


def state(seed: Column, k: Column) -> Column:
    """The generator's state k steps after the seed: a step for each bit of k instead of k steps; whole numbers throughout."""
    steps = F.array(*(F.struct(F.lit(1 << bit).alias("bit"), F.lit(a).cast("bigint").alias("a"), F.lit(c).cast("bigint").alias("c")) for bit, (a, c) in enumerate(powers())))
    k = k.cast("bigint")
    step = lambda s, p: F.when(k.bitwiseAND(p["bit"]) != 0, (s * p["a"] + p["c"]).bitwiseAND(F.lit(MASK))).otherwise(s)
    return F.aggregate(steps, seed.cast("bigint").bitwiseAND(F.lit(MASK)).cast("bigint"), step)


def draw(seed: Column, k: Column) -> Column:
    """The k-th draw, from 0 up to 1."""
    return state(seed, k) / F.lit(float(MASK))
