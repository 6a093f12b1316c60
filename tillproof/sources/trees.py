"""Plain recognisers' trees, read by Python's own JSON parser; a tree of which it isn't certain is left to a VARIANT.

Certain is what both read alike: JSON without a name twice in an object, of a depth and of numbers within a VARIANT's
limits, whose words have four finite numbers as their box. What isn't a word there isn't one here.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from ..functions.money import BLANK

#: Under these names a recogniser's node keeps what is inside it, looked for in this order; fixed values.
INSIDE = ("blocks", "paragraphs", "lines", "children")
CORNERS = ("x0", "y0", "x1", "y1")
#: Signed zeros and very long numbers, which a VARIANT has otherwise or not at all.
UNSURE = r"-0(\.0*)?([eE][-+]?[0-9]+)?[,\]}\s]|-0(\.0*)?$|[0-9.]{500}"
#: Characters of a tree, of a text in it, and levels, beyond which a tree is left; lower than the limits of a VARIANT.
LARGEST, LONGEST, DEEPEST = 1 << 20, 40_000, 500
QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
BOXED = pa.struct([(k, pa.float64()) for k in CORNERS])
WORD = pa.struct([("text", pa.string()), ("bbox", BOXED), ("confidence", pa.float64())])


class UncertainError(ValueError):
    pass


def once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise UncertainError
    return out


def never(_: str):
    raise UncertainError


DECODER = json.JSONDecoder(object_pairs_hook=once, parse_constant=never)


def number(v) -> float:
    """A number that is a double in both."""
    if type(v) is int and -(1 << 53) < v < 1 << 53:
        return float(v)
    if type(v) is not float or not math.isfinite(v):
        raise UncertainError
    return v


def checked(tree: str) -> str:
    if len(tree) > LARGEST or (len(tree) > LONGEST and max(map(len, QUOTED.findall(tree)), default=0) > LONGEST):
        raise UncertainError
    if tree.count("[") + tree.count("{") > DEEPEST:
        depth = most = 0
        for c in re.findall(r"[\[{\]}]", QUOTED.sub("", tree)):
            depth += 1 if c in "[{" else -1
            most = max(most, depth)
        if most > DEEPEST:
            raise UncertainError
    return tree


def words_of(root) -> list[tuple]:
    """text, the four corners and confidence of a tree's words, in order."""
    out, open_ = [], [root]
    while open_:
        v = open_.pop()
        if type(v) is list:
            open_ += reversed(v)
        if type(v) is not dict:
            continue
        ws = v.get("words")
        if type(ws) is not list:
            open_ += [v[k] for k in reversed(INSIDE) if k in v]
            continue
        for w in ws:
            text = w.get("text") if type(w) is dict else None
            if type(text) is not str or not (bare := text.strip(BLANK)):
                continue
            if not text.isascii():
                text.encode()  # half a pair of surrogates is no text
                if "\x85" in text:
                    raise UncertainError
            box, sure = w.get("bbox"), w.get("confidence")
            if box is None:
                continue
            if type(box) is not dict or len(box) != 4:
                raise UncertainError
            out.append((bare, *(number(box.get(k)) for k in CORNERS), number(sure) if type(sure) in (int, float) else 0.0))
    return out


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of key and tree: key, the tree if it was left (else null), whether it was read, and its words."""
    for batch in batches:
        trees = batch.column(1)
        unsure = pc.fill_null(pc.match_substring_regex(trees, UNSURE), False).to_pylist()
        left, whole, found, ends = [], [], [], [0]
        for tree, odd in zip(trees.cast(pa.binary()).to_pylist(), unsure, strict=True):
            ws = None
            if tree is not None and not odd:
                try:
                    ws = words_of(DECODER.decode(checked(tree.decode())))
                except (ValueError, RecursionError):
                    pass
            found += ws or ()
            ends.append(len(found))
            whole.append(ws is not None)
            left.append(None if ws is not None else tree)
        texts, *corners, sure = zip(*found, strict=True) if found else [()] * 6
        boxes = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in corners], fields=list(BOXED))
        flat = pa.StructArray.from_arrays([pa.array(texts, pa.string()), boxes, pa.array(sure, pa.float64())], fields=list(WORD))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=pa.list_(WORD))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary()).cast(pa.string(), safe=False), pa.array(whole), listed], names=["key", "left", "whole", "found"])
