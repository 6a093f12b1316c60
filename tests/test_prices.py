"""Prices, labels, totals and dishes of the kernel against loops over rows; plans that hold no function over a receipt's rows."""

import random
import re

import pyarrow as pa
import pytest
from test_layout import KIND

from tillproof.functions import money
from tillproof.operators import layout, prices, receipt
from tillproof.plans import queries
from tillproof.sources import words

SPACE = "\t\n\x0b\f\r \u00a0\ufeff\u2003\u3000"
TEXTS = ["TOTAL", "SUB", "TOTAL", "SUB-TOTAL", "SUBTTL", "Tax", "vat", "TIP", "TIPS", "XTAX", "TAX8", "GRAND", "BALANCE", "DUE", "VISA", "MC", "DISCARD", "CARD", "---", "=*=", "a-b", "Soup", "straße", "ﬁn", "\u00a0", "é_TAX", "12345678901234", "123456789012345", "😀😀", "SERVICE", "CHG", "REF"]


def sp(pattern: str) -> str:
    """Java's pattern as Python has it."""
    return re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", pattern).replace(r"\z", r"\Z").replace(r"\s", r"\t\n\x0b\f\r ")


def plain(rows: list[dict]) -> dict:
    """One receipt's rows, as the pieces of receipt.py say it."""
    strip = lambda t: t.strip(SPACE + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f")
    money = [[(i, w["x1"], w["cents"]) for i, w in enumerate(r["words"]) if w["cents"] is not None] for r in rows]
    xs = sorted(m[-1][1] for m in money if m)
    column = None
    if xs:
        tol = max(((xs[-1] - xs[0]) or 1.0) * 0.05, 12.0)
        column = -max((sum(abs(o - x) <= tol for o in xs), -x) for x in xs)[1]
    wide = max(max([1.0, *(r["x1"] for r in rows)]) * 0.06, 15.0)
    out, block = [], None
    for r, m in zip(rows, money, strict=True):
        at = ([x for x in m if abs(x[1] - column) <= wide] or m or [None])[-1]
        desc = strip(" ".join(w["text"] for w in r["words"][: at[0]])) if at else None
        said = (desc if at else strip(r["text"])).upper()
        label = next((n for n, p in receipt.LABELS if re.search(sp(p), said)), None)
        found = re.search(sp(receipt.BLOCK), strip(r["text"].upper()))
        opens = bool(at and found and len(strip(r["text"].upper())[: found.start()].encode("utf-16-le")) // 2 <= 14)
        if opens and block is None:
            block = r["row_idx"]
        out.append({"price": at[2] if at else None, "desc": desc, "label": label, "divider": bool(re.search(sp(receipt.DIVIDER), r["text"])), "payment": bool(re.search(sp(receipt.PAYMENT), said)), "opens": opens})
    both = list(enumerate(out))
    hit = {n: next((i for i, r in both if not r["divider"] and r["label"] == n and r["price"] is not None), None) for n in prices.FIELDS}
    miss = {n: next((i for i, r in both if not r["divider"] and r["label"] == n and r["price"] is None), None) for n in prices.FIELDS}
    lost = sorted((miss[n], n) for n in prices.FIELDS if miss[n] is not None and (hit[n] is None or miss[n] < hit[n]))
    dishes = [(r["desc"], r["price"], i) for i, r in both if not r["divider"] and r["price"] is not None and r["label"] is None and not r["payment"] and r["desc"] and (block is None or i < block)]
    return {"column": column, "width": max([1.0, *(r["x1"] for r in rows)]), "block": block, "rows": out, "totals": [None if hit[n] is None else out[hit[n]]["price"] for n in prices.FIELDS], "at": [hit[n] for n in prices.FIELDS], "unreadable": ",".join(n for _, n in lost), "dishes": dishes}


def pages(rnd: random.Random) -> list[list[dict]]:
    out = []
    for _ in range(60):
        ws = []
        for k in range(rnd.choice([0, 1, 3, 9, 14])):
            for i in range(rnd.randint(1, 3)):
                x = 40.0 + 120 * i
                ws.append({"word_idx": len(ws), "text": rnd.choice(TEXTS), "x0": x, "y0": 30.0 * k, "x1": x + 100, "y1": 30.0 * k + 15, "cents": rnd.choice([None, None, None, 7])})
            if rnd.random() < 0.7:
                x = rnd.choice([575.0, 575.0, 570.0, 480.0, 588.0, 500.0 + 10 * rnd.randrange(9)])
                ws.append({"word_idx": len(ws), "text": "1.00", "x0": x - 50, "y0": 30.0 * k, "x1": x, "y1": 30.0 * k + 15, "cents": rnd.randrange(900)})
        out.append(ws)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_prices_and_totals_equal_loops(seed):
    rnd = random.Random(seed)
    table = pa.Table.from_pylist([{"receipt_id": k} | w for k, ws in enumerate(pages(rnd)) for w in ws], KIND)
    batches = lambda: iter(table.to_batches(max_chunksize=rnd.choice([3, 100, 9999])))
    looked = [r for b in layout.rows(0.6)(batches()) for r in b.to_pylist()]
    priced = [r for b in prices.priced(0.6, tuple(prices.ROW))(batches()) for r in b.to_pylist()]
    parsed = [r for b in prices.parsed(0.6)(batches()) for r in b.to_pylist()]
    assert len(looked) == len(priced) == len(parsed) > 20
    for seen, p, q in zip(looked, priced, parsed, strict=True):
        want = plain(seen["rows"])
        assert (p["column_x"], p["page_width"], p["block_start"]) == (want["column"], want["width"], want["block"])
        assert p["rows"] == [r | own for r, own in zip(seen["rows"], want["rows"], strict=True)]
        assert [q[f] for f in prices.FIELDS] == want["totals"] and [q[f"{f}_row"] for f in prices.FIELDS] == want["at"] and q["unreadable"] == want["unreadable"]
        assert [(i["desc"], i["price"], i["row_idx"]) for i in q["items"]] == want["dishes"] and [i["item_idx"] for i in q["items"]] == list(range(q["n_items"]))
        assert q["items_sum"] == sum(d[1] for d in want["dishes"])


def test_many_prices_in_one_receipt_and_sums_beyond_a_long():
    row = lambda k, cents: {"receipt_id": 1, "word_idx": k, "text": "x", "x0": 1.0 * k, "y0": 30.0 * k, "x1": 1.0 * k + 5, "y1": 30.0 * k + 15, "cents": cents}
    (b,) = prices.priced(0.6, ("price",))(iter(pa.Table.from_pylist([row(k, k) for k in range(20_000)], KIND).to_batches()))
    assert b.column("block_start")[0].as_py() is None and b.column("column_x")[0].as_py() == 1004.0
    large = [row(k, 2**62) | {"text": t, "x0": x, "x1": x + 9, "cents": c} for k in range(3) for t, x, c in (("Soup", 1.0, None), ("9", 500.0, 2**62))]
    with pytest.raises(OverflowError):
        list(prices.parsed(0.6)(iter(pa.Table.from_pylist(large, KIND).to_batches())))


@pytest.mark.parametrize("name", ["q17_price_column", "q18_parse_roundtrip", "q19_unreadable", "q53_degraded_sessions", "q54_degraded_policies"])
def test_rows_of_receipts_are_priced_in_the_kernel(spark, sf, name):
    """No function over arrays of a receipt's rows, which the JVM would interpret word by word."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(array_compact" not in plan and ".words" not in plan


def test_words_are_rendered_without_functions_over_arrays(spark, sf):
    plan = words.words(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(struct(text" not in plan and "slice(" not in plan


def test_amounts_are_read_once_for_each_text(spark):
    texts = ["12.34", "$12.34", "12,34", "1,234.56", "$12,345.00", "19.169", "2300", "12,34.56", "1,23.45", "1,234,56", "", "12.\n34", "1\x0b2.34", " 5.00", "٣.٠٠", "9" * 17 + ".99", "92233720368547758.07", "92233720368547758.08", "9" * 30 + ".00", "5.00\n", ".50", None, "12.34"]
    want = {r.i: r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", money.parse_cents("t").alias("c")).collect()}
    assert layout.cents(pa.array(texts, pa.string())).to_pylist() == [want[i] for i in range(len(texts))]


@pytest.mark.parametrize("name", ["q18_parse_roundtrip", "q53_degraded_sessions", "q54_degraded_policies"])
def test_words_meet_no_pattern_in_the_jvm(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "(,\\d{3})" not in plan and "array_sort(transform" not in plan
