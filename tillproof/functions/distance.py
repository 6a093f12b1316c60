"""Levenshtein distance of texts of any length: a bit for each row of a band about the diagonal, a few long additions for each column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


#: Characters from whose distance that of longer texts is guessed.
PROBE = 512


def edits(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between a and b, in code points.

    Time grows with the longer length times the distance over the bits of a word, memory with the lengths. The distance
    that bounds the band is guessed from the beginnings; what a band gives is never too small, so where it is beyond the
    guess a second band of that width is sure to hold it.
    """
    if len(a) < len(b):
        a, b = b, a
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b:
        return len(a)
    here = positions(a, b)
    if len(b) <= 2 * PROBE:
        return in_band(here, len(a), b, len(a))
    guess = in_band(positions(a[:PROBE], b[:PROBE]), PROBE, b[:PROBE], PROBE) * len(a) * 6 // (5 * PROBE)
    guess = min(max(guess, len(a) - len(b)) + 64, len(a))
    found = in_band(here, len(a), b, guess)
    return found if found <= guess else in_band(here, len(a), b, found)


def positions(a: str, b: str) -> dict[str, int]:
    """For each character of b the places in a that hold it, a bit each."""
    codes = np.array(list(a), "U1").view(np.uint32)
    return {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}


def in_band(here: dict[str, int], m: int, b: str, most: int) -> int:
    """The distance between b and a text, no shorter, of m characters that stand at the places here, if it is `most` or less; else no less than it.

    A way of `most` edits stays on the diagonals between. Columns go in blocks; a block's window has the rows that those
    diagonals cross in it. The rows are kept as the differences between neighbours, up and down, a bit each; Python's long
    integers carry a sum over all of them. Above a window, and below the one before it, distances are taken to grow by one,
    which is never too little.
    """
    n = len(b)
    spare = (min(most, m) - (m - n)) // 2 + 1
    low, high = spare, m - n + spare
    block = n if low + high >= m else max(64, (low + high) // 16)
    first, last, above, up, down = 0, 0, 0, 0, 0  # the window's rows, and the distance in the row above it
    for j in range(0, n, block):
        columns = b[j : j + block]
        gone = max(0, j - low) - first
        if gone > 0:
            dropped = (1 << gone) - 1
            above += (up & dropped).bit_count() - (down & dropped).bit_count()
            up, down, first = up >> gone, down >> gone, first + gone
        below = min(m, j + len(columns) + high)
        up |= ((1 << (below - last)) - 1) << (last - first)
        last = below
        full = (1 << (last - first)) - 1
        window = {c: here[c] >> first & full for c in set(columns)}
        for c in columns:
            equal = window[c]
            same = ((((equal & up) + up) ^ up) | equal | down) & full
            more, less = (down | full ^ (same | up)) << 1 | 1, (same & up) << 1
            up, down = (less | ~(same | more)) & full, more & same
        above += len(columns)
    return above + up.bit_count() - down.bit_count()


@F.pandas_udf(IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_distance(a: Column, b: Column) -> Column:
    """edits() of two columns, null where either is null; for long texts, as Spark's own function keeps two rows of numbers a character at a time."""
    return _edits(a, b)
