"""Slope and rows of many receipts at once, in numpy: a receipt's words lie in bands, sorted from left to right.

Nearest neighbours are looked up by a binary search in a word's own band and the two beside it, so a receipt costs
n log n whatever its length, as long as few words lie behind a word's right edge at other heights. Rows are one pass
over the words from top to bottom, all receipts of a batch in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.money import WS, re2

#: In line heights: how far to the right a neighbour may be and how far up or down; the steepest slope; fixed values.
REACH, DRIFT, STEEPEST = 3.0, 1.5, 0.3
#: Words of whole receipts that are worked on together, at least.
AT_ONCE = 1 << 15
#: Below so many receipts still in step, each is finished on its own.
IN_STEP = 8


def cents(texts: pa.Array) -> pa.Array:
    """What money.parse_cents gives for texts, each of which is read once."""
    coded = pc.dictionary_encode(texts)
    s = pc.replace_substring_regex(coded.dictionary, re2(f"[${WS}]"), "")
    grouped = pc.match_substring_regex(s, r"^\d{1,3}(,\d{3})+\.\d{2}$")
    plain = pc.if_else(grouped, pc.replace_substring(s, ",", ""), pc.replace_substring(s, ",", ".", max_replacements=1))
    money = pc.match_substring_regex(plain, r"^\d+\.\d{2}$").to_pylist()
    read = [int(t.replace(".", "")) if m else None for m, t in zip(money, plain.to_pylist(), strict=True)]
    return pa.array([v if v is not None and v < 1 << 63 else None for v in read], pa.int64()).take(coded.indices)


def medians(values: np.ndarray, group: np.ndarray, n: int, otherwise: float) -> np.ndarray:
    """Of each of n groups the median, the mean of the two middle values for an even number of them."""
    order = np.lexsort((values, group))
    counts = np.bincount(group, minlength=n)
    starts = np.cumsum(counts) - counts
    out = np.full(n, otherwise)
    some = np.flatnonzero(counts)
    low, high = starts[some] + (counts[some] - 1) // 2, starts[some] + counts[some] // 2
    out[some] = (values[order[low]] + values[order[high]]) / 2
    return out


def neighbours(receipt, number, x0, x1, cy, tall) -> np.ndarray:
    """For each word its nearest neighbour to the right, -1 if there is none; ties go to the smaller x0, then number.

    tall: the line height of each word's receipt.
    """
    n = len(receipt)
    found = np.full(n, -1)
    if not n:
        return found
    band = np.floor(cy / (DRIFT * tall * (1 + 1e-9)))  # a hair taller: two words within reach are never two bands apart
    order = np.lexsort((number, x0, band, receipt))
    r, b = receipt[order], band[order]
    new = np.append(True, (r[1:] != r[:-1]) | (b[1:] != b[:-1]))
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    edges = np.unique(x0)
    keys = group * (len(edges) + 1) + np.searchsorted(edges, x0[order])
    behind = np.searchsorted(edges, x1[order])
    follows = np.append((r[starts[1:]] == r[starts[:-1]]) & (b[starts[1:]] == b[starts[:-1]] + 1), False)
    best = np.full(n, -1)  # positions in order
    for shift in (0, 1, -1):
        has = np.ones(n, bool) if shift == 0 else follows[group] if shift == 1 else np.append(False, follows[:-1])[group]
        own = np.flatnonzero(has)
        target = group[own] + shift
        at = np.searchsorted(keys, target * (len(edges) + 1) + behind[own])
        end = ends[target]
        while len(own):
            me = order[own]
            inside = at < end
            other = order[np.minimum(at, n - 1)]
            inside &= x0[other] - x1[me] <= REACH * tall[me]
            hit = inside & (np.abs(cy[other] - cy[me]) <= DRIFT * tall[me]) & (other != me)
            mine, theirs = own[hit], at[hit]
            old = best[mine]
            o, t = order[np.maximum(old, 0)], order[theirs]
            better = (old < 0) | (x0[t] < x0[o]) | ((x0[t] == x0[o]) & (number[t] < number[o]))
            best[mine[better]] = theirs[better]
            on = inside & ~hit
            own, at, end = own[on], at[on] + 1, end[on]
    found[order] = np.where(best >= 0, order[np.maximum(best, 0)], -1)
    return found


def fold(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The row of each word, from 0 in each receipt: a word joins while it is within `allowed` of the row's mean so far.

    flat: ascending within each receipt.
    """
    out = np.zeros(len(flat), np.int64)
    by = np.argsort(-counts, kind="stable")
    starts, counts, allowed = starts[by], counts[by], allowed[by]
    total, n, row = np.zeros(len(by)), np.zeros(len(by), np.int64), np.full(len(by), -1)
    most, step = int(counts[0]) if len(counts) else 0, 0
    live = int((counts > 0).sum())
    while step < most and live >= IN_STEP:
        at = starts[:live] + step
        x = flat[at]
        joins = (n[:live] > 0) & (np.abs(x - total[:live] / np.maximum(n[:live], 1)) <= allowed[:live])
        total[:live] = np.where(joins, total[:live] + x, x)
        n[:live] = np.where(joins, n[:live] + 1, 1)
        row[:live] += ~joins
        out[at] = row[:live]
        step += 1
        live = int(np.searchsorted(-counts, -step, "left"))
    for k in range(live):
        s, m, g, reach, rows = float(total[k]), int(n[k]), int(row[k]), float(allowed[k]), []
        for x in flat[starts[k] + step : starts[k] + counts[k]].tolist():
            if m and abs(x - s / m) <= reach:
                s, m = s + x, m + 1
            else:
                s, m, g = x, 1, g + 1
            rows.append(g)
        out[starts[k] + step : starts[k] + counts[k]] = rows
    return out


PLACE = ("x0", "y0", "x1", "y1")


def changes(ids: pa.Array) -> np.ndarray:
    """Whether each id is unlike the one before it; nulls are alike."""
    if len(ids) < 2:
        return np.ones(len(ids), bool)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.append(True, unlike.to_numpy(zero_copy_only=False))


class Pages:
    """Receipts whose words stand together in a table of receipt_id, word_idx, text, x0, y0, x1 and y1, and perhaps cents; else these come from the text.

    Words without text or box don't count, but their receipts stay.
    """

    def __init__(self, words: pa.Table):
        words = words.combine_chunks()
        column = lambda k: pa.array([], words.schema.field(k).type) if not words.num_rows else words.column(k).chunk(0)
        new = changes(column("receipt_id"))
        self.ids = column("receipt_id").filter(pa.array(new))
        self.n = len(self.ids)
        place = [column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in PLACE]
        whole = pc.is_valid(column("text")).to_numpy(zero_copy_only=False) & ~np.isnan(np.array(place)).any(axis=0)
        self.receipt = (np.cumsum(new) - 1)[whole]
        self.counts = np.bincount(self.receipt, minlength=self.n)
        self.x0, self.y0, self.x1, self.y1 = (p[whole] for p in place)
        self.number = column("word_idx").to_numpy(zero_copy_only=False)[whole]
        kept = pa.array(whole)
        self.text = column("text").filter(kept)
        self.cents = column("cents").filter(kept) if "cents" in words.schema.names else cents(self.text)
        self.cx, self.cy = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2
        self.tall = medians(self.y1 - self.y0, self.receipt, self.n, 0.0)
        self.tall[self.tall == 0] = 1.0
        other = neighbours(self.receipt, self.number, self.x0, self.x1, self.cy, self.tall[self.receipt])
        me = np.flatnonzero(other >= 0)
        dx, dy = self.cx[other[me]] - self.cx[me], self.cy[other[me]] - self.cy[me]
        far = np.abs(dx) >= 1
        slope = medians(dy[far] / dx[far], self.receipt[me[far]], self.n, 0.0)
        self.slope = np.where(np.abs(slope) > STEEPEST, 0.0, slope)

    def placed(self, tolerance: float) -> Rows:
        """The rows of all receipts, from top to bottom, each with its words from left to right."""
        flat = self.cy - self.slope[self.receipt] * self.cx
        down = np.lexsort((self.number, flat, self.receipt))
        starts = np.cumsum(self.counts) - self.counts
        group = np.empty(len(flat), np.int64)
        group[down] = fold(flat[down], starts, self.counts, self.tall * tolerance)
        across = np.lexsort((self.number, flat, self.x0, group, self.receipt))
        r, g = self.receipt[across], group[across]
        new = np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])) if len(across) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(across)))
        gather = lambda f, x: f.reduceat(x[across], first) if len(first) else np.zeros(0)
        flat_y, y = gather(np.add, flat) / size, gather(np.add, self.cy) / size
        edges = [gather(np.minimum, self.x0), gather(np.minimum, self.y0), gather(np.maximum, self.x1), gather(np.maximum, self.y1)]
        order = np.lexsort((g[first], flat_y, r[first]))
        # The words of the rows in their order: a row's words stay together.
        lengths = size[order]
        at = across[np.repeat(first[order] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(across))]
        return Rows(self, r[first][order], y[order], flat_y[order], [e[order] for e in edges], lengths, at)

    def rows(self, tolerance: float, kind: pa.DataType) -> pa.ListArray:
        """For each receipt its rows from top to bottom, each with its words from left to right."""
        return self.placed(tolerance).listed(kind)


class Rows:
    """The rows of a batch's receipts: receipt after receipt, and in each from top to bottom."""

    def __init__(self, pages: Pages, of: np.ndarray, y: np.ndarray, flat_y: np.ndarray, edges: list[np.ndarray], lengths: np.ndarray, at: np.ndarray):
        self.pages, self.of, self.lengths, self.at = pages, of, lengths, at
        self.n = len(of)
        self.per = np.bincount(of, minlength=pages.n)
        self.starts = np.cumsum(self.per) - self.per
        self.position = np.arange(self.n) - np.repeat(self.starts, self.per)
        self.ends = np.append(0, np.cumsum(lengths))
        index = pa.array(at)
        self.texts, self.x1, self.cents = pages.text.take(index), pages.x1[at], pages.cents.take(index)
        self.columns = {"row_idx": pa.array(self.position, pa.int32()), "y": pa.array(y), "flat_y": pa.array(flat_y), **{k: pa.array(e) for k, e in zip(PLACE, edges, strict=True)}}
        self.columns["text"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), self.texts), " ")
        self.right = edges[2]

    def words(self, kind: pa.DataType) -> pa.ListArray:
        """The words of each row."""
        word = kind.value_type
        words = pa.StructArray.from_arrays([self.texts, pa.array(self.x1), self.cents], fields=list(word))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), words, type=kind)

    def listed(self, kind: pa.DataType) -> pa.ListArray:
        """A list of rows for each receipt, with the columns that kind names."""
        made = [self.words(f.type) if f.name == "words" else self.columns[f.name] for f in kind.value_type]
        rows = pa.StructArray.from_arrays(made, fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.per)), pa.int32()), rows, type=kind)


WORD = pa.struct([("text", pa.string()), ("x1", pa.float64()), ("cents", pa.int64())])
ROWS = pa.list_(pa.struct([("row_idx", pa.int32()), *((k, pa.float64()) for k in ("y", "flat_y", "x0", "y0", "x1", "y1")), ("text", pa.string()), ("words", pa.list_(WORD))]))
ROWS_SQL = "array<struct<row_idx:int,y:double,flat_y:double,x0:double,y0:double,x1:double,y1:double,text:string,words:array<struct<text:string,x1:double,cents:bigint>>>>"


def of_whole_receipts(batches: Iterator[pa.RecordBatch]) -> Iterator[Pages]:
    """Pages of batches whose receipts stand together, some batches at a time; the last receipt waits for its other words."""
    waiting: list[pa.RecordBatch] = []
    held = 0  # words that wait
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting:
            last = waiting[-1].column(0)
            joint = changes(pa.concat_arrays([last.slice(len(last) - 1), batch.column(0)]))[1:]
        else:
            joint = changes(batch.column(0))
        starts = np.flatnonzero(joint)
        end = int(starts[-1]) if len(starts) else 0
        if len(starts) and held + end >= AT_ONCE:
            yield Pages(pa.Table.from_batches([*waiting, batch.slice(0, end)]))
            waiting, held, batch = [], 0, batch.slice(end)
        waiting.append(batch)
        held += batch.num_rows
    if waiting:
        yield Pages(pa.Table.from_batches(waiting))


def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """receipt_id, line_height and slope of sorted words."""
    for p in of_whole_receipts(batches):
        yield pa.RecordBatch.from_arrays([p.ids, pa.array(p.tall), pa.array(p.slope)], names=["receipt_id", "line_height", "slope"])


def rows(tolerance: float):
    """receipt_id and rows of sorted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in of_whole_receipts(batches):
            yield pa.RecordBatch.from_arrays([p.ids, p.rows(tolerance, ROWS)], names=["receipt_id", "rows"])

    return run
