"""From located words to a parsed receipt: rows by geometry, then prices, labels and items.

Words have receipt_id, word_idx, text, x0, y0, x1, y1. A receipt's words come together by the only shuffle, or by none
where they stand together (`together`, as sources.words gives them);
slope and rows (layout), column, prices, labels and fields (prices) are worked out for many receipts at a time. Words without text or box don't count; a receipt without words has no rows, a line height of 1 and no
slope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import strip
from . import layout, prices

B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Labels of the totals, in the order in which they are tried, and payment words.
LABELS = tuple((name, f"{B}({words}){E}") for name, words in prices.LABELS)
BLOCK = f"(^|[^A-Z])({prices.OPENING}){E}"
PAYMENT = f"{B}({prices.PAYMENT}){E}"
DIVIDER = rf"{prices.DIVIDER}\z"
LEAD = prices.LEAD


def label(upper: Column) -> Column:
    return F.coalesce(*(F.when(upper.rlike(x), F.lit(name)) for name, x in LABELS))


def opens_block(text: Column) -> Column:
    """A totals label, with at most 14 characters before it."""
    return F.regexp_instr(strip(F.upper(text)), F.lit(BLOCK)).between(1, LEAD + 1)


def is_payment(upper: Column) -> Column:
    return upper.rlike(PAYMENT)


def is_divider(text: Column) -> Column:
    return text.rlike(DIVIDER)


def laid_out(words: DataFrame, kernel: Callable, made: str, together: bool = False) -> DataFrame:
    """A kernel of layout over the words, a receipt's together: one shuffle of plain rows and a sort by receipt alone.

    together: each receipt's words stand in one partition and one after the other already, as a source gives them that
    opens whole receipts; then neither is needed.
    """
    place = (F.col(c).cast("double").alias(c) for c in layout.PLACE)
    flat = words.select("receipt_id", F.col("word_idx").cast("bigint").alias("word_idx"), F.col("text").cast("string").alias("text"), *place)
    dealt = flat if together else flat.repartition("receipt_id").sortWithinPartitions("receipt_id")
    return dealt.mapInArrow(kernel, f"receipt_id {flat.schema['receipt_id'].dataType.simpleString()}, {made}")


def slopes(words: DataFrame, together: bool = False) -> DataFrame:
    """receipt_id, line_height and slope.

    The line height is the median of the words' heights (1 if that is 0), the slope the median over the words of the
    slope to the nearest right-hand neighbour; a steep one counts as none.
    """
    return laid_out(words, layout.slopes, "line_height double, slope double", together)


def page_rows(words: DataFrame, tolerance: float = 0.6, together: bool = False) -> DataFrame:
    """receipt_id and rows: an array of row_idx, y, flat_y, x0, y0, x1, y1, text and words (in reading order)."""
    return laid_out(words, layout.rows(tolerance), f"rows {layout.ROWS_SQL}", together)


def rows(words: DataFrame, tolerance: float = 0.6, together: bool = False) -> DataFrame:
    """receipt_id, row_idx, y, flat_y, x0, y0, x1, y1, text and words, a row each."""
    return page_rows(words, tolerance, together).select("receipt_id", F.inline("rows"))


def page_priced(words: DataFrame, columns: tuple[str, ...] = tuple(prices.ROW), tolerance: float = 0.6, together: bool = False) -> DataFrame:
    """receipt_id, column_x, page_width, block_start and the rows, of which only these columns: those of page_rows(), price, desc, label, divider, payment and opens.

    column_x (null without prices) is the right edge on which most last prices agree; a row's price is the last amount in
    the column, else the last at all, and desc the words before it. block_start is the first row that opens the totals.
    """
    return laid_out(words, prices.priced(tolerance, columns), prices.priced_sql(columns), together)


def priced(words: DataFrame, together: bool = False) -> DataFrame:
    """receipt_id, column_x, page_width, block_start and the priced rows of the words, a row each."""
    own = tuple(c for c in prices.ROW if c != "opens")
    return page_priced(words, own, together=together).select("receipt_id", "column_x", "page_width", "block_start", F.inline("rows"))


def items(words: DataFrame, together: bool = False) -> DataFrame:
    """receipt_id, item_idx, desc, price, row_idx of the lines that are dishes."""
    return parse(words, together).select("receipt_id", F.inline("items"))


def fields(words: DataFrame, together: bool = False) -> DataFrame:
    """receipt_id, the four totals (first occurrence), the rows they stand in and unreadable labels, in order."""
    return parse(words, together).drop("items", "n_items", "items_sum")


def parse(words: DataFrame, together: bool = False) -> DataFrame:
    """receipt_id, totals, unreadable, n_items, items_sum and items (an array in order)."""
    return laid_out(words, prices.parsed(0.6), prices.PARSED_SQL, together)
