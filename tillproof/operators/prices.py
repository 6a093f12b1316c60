"""Price column, labels, totals and dishes of many receipts at once: numpy over rows, RE2 over their texts.

A word boundary is a character more or an end on either side, as RE2 looks neither behind nor ahead; whether a text matches
is the same. Texts are looked at once each, and only those that hold a label's or a payment's word are looked at for each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.money import BLANK, WS, re2
from .layout import ROWS, Rows, of_whole_receipts

SP = f"[{WS}]"
FIELDS = ("subtotal", "tax", "tip", "total")
#: Labels of the totals, in the order in which they are tried; fixed values.
LABELS = (
    ("subtotal", rf"SUB{SP}?-?{SP}?TOTAL|SUBTTL"),
    ("tax", rf"TAX|VAT|GST|HST|PST|SALES{SP}?TAX"),
    ("tip", rf"TIP|GRATUITY|SERVICE{SP}?(?:CHARGE|CHG)?"),
    ("total", rf"GRAND{SP}?TOTAL|TOTAL|BALANCE(?:{SP}?DUE)?|AMOUNT{SP}?DUE"),
)
#: What opens the block of totals, payment words and dividers; fixed values.
OPENING = f"{LABELS[0][1]}|{LABELS[3][1]}"
PAYMENT = "CASH|CHANGE|VISA|MASTERCARD|MC|AMEX|DEBIT|CREDIT|CARD|TENDER|AUTH|APPROVED|REF|ACCT"
DIVIDER = rf"^[-_=~*.{WS}]+"
LEAD = 14

PART = "[^A-Za-z0-9_]"
BOUND = {name: re2(f"(?:^|{PART})(?:{words})(?:$|{PART})") for name, words in (*LABELS, ("payment", PAYMENT))}
ANY = re2("|".join(words for _, words in (*LABELS, ("payment", PAYMENT))))
OPENS = re2(f"(?s)^.{{0,{LEAD}}}(?:^|[^A-Z])(?:{OPENING})(?:$|{PART})")
#: The same anywhere, for Python.
OPENING_AT = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), f"(?:^|[^A-Z])(?:{OPENING})(?:$|{PART})"))


def matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def upper(texts: pa.Array) -> pa.Array:
    """In capitals, with the letters that become several."""
    plain = pc.string_is_ascii(texts)
    if pc.all(plain).as_py() is not False:
        return pc.ascii_upper(texts)
    return pa.array([None if t is None else t.upper() for t in texts.to_pylist()], pa.string())


def marks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its label, as a number in LABELS or -1, and whether it names a payment."""
    coded = pc.dictionary_encode(texts)
    own = upper(coded.dictionary)
    label, payment = np.full(len(own), -1), np.zeros(len(own), bool)
    some = np.flatnonzero(matches(own, ANY))
    if len(some):
        chosen = own.take(pa.array(some))
        payment[some] = matches(chosen, BOUND["payment"])
        for k in reversed(range(len(LABELS))):
            label[some[matches(chosen, BOUND[LABELS[k][0]])]] = k
    index = coded.indices.to_numpy(zero_copy_only=False)
    return label[index], payment[index]


def opens(texts: pa.Array) -> np.ndarray:
    """A totals label with at most 14 characters before it, as UTF-16 counts them."""
    coded = pc.dictionary_encode(texts)
    own = pc.utf8_trim(upper(coded.dictionary), characters=BLANK)
    found = matches(own, OPENS)
    for i in np.flatnonzero(found & matches(own, r"[\x{10000}-\x{10FFFF}]")):
        text = own[i].as_py()
        found[i] = len(text[: OPENING_AT.search(text).start()].encode("utf-16-le")) // 2 <= LEAD
    return found[coded.indices.to_numpy(zero_copy_only=False)]


def last_of(rows: np.ndarray, members: np.ndarray, n: int) -> np.ndarray:
    """Of each row the last of the members that lie in it, -1 without any; members in the order of rows."""
    out = np.full(n, -1)
    final = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    out[rows[final]] = members[final]
    return out


def columns_of(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Of each receipt the edge on which most of its edges x agree, the leftmost of several; NaN without any."""
    out = np.full(n, np.nan)
    if not len(x):
        return out
    order = np.lexsort((x, of))
    v, g = x[order], of[order]
    count = np.bincount(g, minlength=n)
    end = np.cumsum(count)
    span = np.zeros(n)
    some = np.flatnonzero(count)
    span[some] = v[end[some] - 1] - v[end[some] - count[some]]
    tol = np.maximum(np.where(span == 0, 1.0, span) * 0.05, 12.0)[g]

    def far(edge: np.ndarray, way: int) -> np.ndarray:
        """The last index towards the edge that is within reach, by halving."""
        near = np.arange(len(v))
        while (apart := np.abs(edge - near) > 1).any():
            mid = near + (edge - near) // 2 if way > 0 else near - (near - edge) // 2
            ok = np.abs(v[mid] - v) <= tol
            near, edge = np.where(apart & ok, mid, near), np.where(apart & ~ok, mid, edge)
        return near

    votes = far(end[g], 1) - far((end - count)[g] - 1, -1) + 1
    best = np.lexsort((v, -votes, g))
    out[some] = v[best[(end - count)[some]]]
    return out


class Priced:
    """The priced rows of a batch's receipts."""

    def __init__(self, r: Rows):
        self.r, n = r, r.n
        pages = r.pages.n
        row_of = np.repeat(np.arange(n), r.lengths)
        money = np.flatnonzero(r.cents.is_valid().to_numpy(zero_copy_only=False))
        rows, edge = row_of[money], r.x1[money]
        last = last_of(rows, money, n)
        has = np.flatnonzero(last >= 0)
        self.column = columns_of(r.x1[last[has]], r.of[has], pages)
        self.width = np.ones(pages)
        some = np.flatnonzero(r.per)
        if len(some):
            self.width[some] = np.maximum(1.0, np.maximum.reduceat(r.right, r.starts[some]))
        reach = np.maximum(self.width * 0.06, 15.0)
        inside = np.abs(edge - self.column[r.of[rows]]) <= reach[r.of[rows]]
        own = last_of(rows[inside], money[inside], n)
        own = np.where(own >= 0, own, last)
        self.has = own >= 0
        cents = pc.fill_null(r.cents, 0).to_numpy(zero_copy_only=False)
        self.cents = np.where(self.has, cents[own], 0) if len(cents) else np.zeros(n, np.int64)
        first = r.ends[:-1]
        before = np.where(self.has, own - first, 0)
        kept = np.arange(len(r.at)) - first[row_of] < before[row_of]
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(before)), pa.int32()), r.texts.filter(pa.array(kept)))
        desc = pc.utf8_trim(pc.binary_join(listed, " "), characters=BLANK)
        priced = pa.array(self.has)
        said = pc.if_else(priced, desc, pc.utf8_trim(r.columns["text"], characters=BLANK))
        self.price = pa.array(self.cents, mask=~self.has)
        self.desc = pc.if_else(priced, desc, pa.scalar(None, pa.string()))
        self.label, self.payment = marks(said)
        self.divider = matches(r.columns["text"], re2(DIVIDER) + "$")
        self.opens = np.zeros(n, bool)
        self.opens[self.has] = opens(r.columns["text"].filter(priced))
        block = self.first(self.opens)
        self.block = np.where(block >= 0, r.position[block] if r.n else block, -1)
        ends = self.block[r.of]
        said = pc.not_equal(desc, "").to_numpy(zero_copy_only=False)
        self.dish = ~self.divider & self.has & (self.label < 0) & ~self.payment & said & ((ends < 0) | (r.position < ends))

    def first(self, holds: np.ndarray) -> np.ndarray:
        """Of each receipt the first row that holds, as a number over all rows; -1 without any."""
        out = np.full(self.r.pages.n, -1)
        at = np.flatnonzero(holds)
        of = self.r.of[at]
        new = np.append(True, of[1:] != of[:-1]) if len(at) else np.zeros(0, bool)
        out[of[new]] = at[new]
        return out

    def listed(self, kind: pa.DataType) -> pa.ListArray:
        """A list of rows for each receipt, with the columns that kind names."""
        names = pa.array([name for name, _ in LABELS])
        own = {
            "price": lambda: self.price,
            "desc": lambda: self.desc,
            "label": lambda: names.take(pa.array(self.label, mask=self.label < 0)),
            "divider": lambda: pa.array(self.divider),
            "payment": lambda: pa.array(self.payment),
            "opens": lambda: pa.array(self.opens),
        }
        self.r.columns |= {f.name: own[f.name]() for f in kind.value_type if f.name in own}
        return self.r.listed(kind)

    def totals(self) -> tuple[list[pa.Array], pa.Array]:
        """The four totals (first occurrence) and the rows they stand in, and of each receipt its unreadable labels in order."""
        r, n = self.r, self.r.pages.n
        at = lambda rows: np.where(rows >= 0, r.position[rows] if r.n else rows, -1)
        values, places, lost = [], [], []
        for k in range(len(LABELS)):
            said = ~self.divider & (self.label == k)
            hit, miss = self.first(said & self.has), self.first(said & ~self.has)
            values.append(pa.array(self.cents[hit] if r.n else hit, mask=hit < 0))
            places.append(pa.array(at(hit), pa.int32(), mask=hit < 0))
            unread = np.flatnonzero((miss >= 0) & ((hit < 0) | (miss < hit)))
            lost.append((unread, at(miss)[unread], np.full(len(unread), k)))
        of, row, k = (np.concatenate(x) for x in zip(*lost, strict=True))
        order = np.lexsort((row, of))
        counts = np.bincount(of, minlength=n)
        names = pa.array([name for name, _ in LABELS]).take(pa.array(k[order]))
        unreadable = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), names), ",")
        return [*values, *places], unreadable

    def items(self) -> tuple[pa.ListArray, pa.Array, pa.Array]:
        """Of each receipt its dishes, their number and their sum."""
        r = self.r
        at = np.flatnonzero(self.dish)
        counts = np.bincount(r.of[at], minlength=r.pages.n)
        starts = np.cumsum(counts) - counts
        sums = np.append(0, np.cumsum(self.cents[at]))
        if np.abs(self.cents[at].astype(np.float64)).sum() >= 2.0**62:
            raise OverflowError("the prices of some receipts' items are too large to be added up")
        index = pa.array(at)
        made = [pa.array(np.arange(len(at)) - np.repeat(starts, counts), pa.int32()), self.desc.take(index), pa.array(self.cents[at]), r.columns["row_idx"].take(index)]
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays(made, fields=list(ITEM)), type=pa.list_(ITEM))
        return listed, pa.array(counts, pa.int32()), pa.array(sums[starts + counts] - sums[starts])


ITEM = pa.struct([("item_idx", pa.int32()), ("desc", pa.string()), ("price", pa.int64()), ("row_idx", pa.int32())])
ITEMS_SQL = "array<struct<item_idx:int,desc:string,price:bigint,row_idx:int>>"
#: What a priced row may have, with the types of Arrow and of SQL.
ROW = {f.name: (f.type, t) for f, t in zip(ROWS.value_type, ("int", *["double"] * 6, "string", "array<struct<text:string,x1:double,cents:bigint>>"), strict=True)}
ROW |= {"price": (pa.int64(), "bigint"), "desc": (pa.string(), "string"), "label": (pa.string(), "string"), "divider": (pa.bool_(), "boolean"), "payment": (pa.bool_(), "boolean"), "opens": (pa.bool_(), "boolean")}


def priced_sql(columns: tuple[str, ...]) -> str:
    return f"column_x double, page_width double, block_start int, rows array<struct<{','.join(f'{c}:{ROW[c][1]}' for c in columns)}>>"


def priced(tolerance: float, columns: tuple[str, ...]):
    """receipt_id, column_x, page_width, block_start and the priced rows, with these columns, of sorted words."""
    kind = pa.list_(pa.struct([(c, ROW[c][0]) for c in columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in of_whole_receipts(batches):
            p = Priced(page.placed(tolerance))
            made = [page.ids, pa.array(p.column, mask=np.isnan(p.column)), pa.array(p.width), pa.array(p.block, pa.int32(), mask=p.block < 0), p.listed(kind)]
            yield pa.RecordBatch.from_arrays(made, names=["receipt_id", "column_x", "page_width", "block_start", "rows"])

    return run


PARSED_SQL = ", ".join([*(f"{f} bigint" for f in FIELDS), *(f"{f}_row int" for f in FIELDS), "unreadable string", f"items {ITEMS_SQL}", "n_items int", "items_sum bigint"])


def parsed(tolerance: float):
    """receipt_id, the totals and their rows, unreadable labels, and the items with their number and sum, of sorted words."""
    names = ["receipt_id", *FIELDS, *(f"{f}_row" for f in FIELDS), "unreadable", "items", "n_items", "items_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in of_whole_receipts(batches):
            p = Priced(page.placed(tolerance))
            totals, unreadable = p.totals()
            yield pa.RecordBatch.from_arrays([page.ids, *totals, unreadable, *p.items()], names=names)

    return run
