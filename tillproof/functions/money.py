"""Money, text and identifiers. Money is always integer cents; only the edge formats it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a receipt's text may hold, the no-break kinds too; inside a character class.
WS = r"\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: The same characters one by one.
BLANK = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0xFEFF, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A pattern as RE2 has it, whose own white space lacks the vertical tab.
re2 = lambda pattern: pattern.replace(r"\s", r"\t\n\x0B\f\r ")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5), for negative values too."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^[{WS}]+", ""), f"[{WS}]+$", "")


def parse_cents(raw: Column | str) -> Column:
    """Printed money: digits, a mark and two digits; thousands commas only where they all fit. Else null."""
    s = F.regexp_replace(col(raw), f"[${WS}]", "")
    grouped = s.rlike(r"^\d{1,3}(,\d{3})+\.\d{2}\z")
    plain = F.when(grouped, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(s, r"^([^,]*),", "$1."))
    return F.when(plain.rlike(r"^\d+\.\d{2}\z"), F.replace(plain, F.lit("."), F.lit("")).try_cast("bigint"))


def parse_typed(raw: Column | str) -> Column:
    """Money as people type it: a comma before one or two last digits is decimal, cents may be short or missing."""
    s = F.regexp_replace(col(raw), f"[${WS}]", "")
    plain = F.when(s.rlike(r"^\d+,\d{1,2}\z"), F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    whole, cents = F.regexp_extract(plain, r"^(\d+)(?:\.(\d{0,2}))?\z", 1), F.regexp_extract(plain, r"^(\d+)(?:\.(\d{0,2}))?\z", 2)
    return F.when(plain.rlike(r"^\d+(\.\d{0,2})?\z"), whole.try_cast("bigint") * 100 + F.rpad(cents, 2, "0").try_cast("bigint"))


def format_cents(c: Column | str) -> Column:
    """12.34, without the sign."""
    a = F.abs(col(c))
    return F.concat(F.floor(a / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def money_text(c: Column | str) -> Column:
    """12.34 or -12.34, for messages."""
    return F.concat(F.when(col(c) < 0, "-").otherwise(""), format_cents(c))


def percent_of(subtotal: Column | str, percent: Column) -> Column:
    return round_half_up(col(subtotal).cast("double") * percent / 100)


def added_tip(cents: Column, percent: Column, subtotal: Column) -> Column:
    """Cents as given, else a percentage of the subtotal, else nothing."""
    return F.coalesce(cents, percent_of(subtotal, percent), F.lit(0)).cast("bigint")


def normalise(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.upper(col(c)), f"[{WS}]+", " "))


def fold_lookalikes(c: Column | str) -> Column:
    return F.translate(col(c), "01", "OI")


def escape_xml(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_text(n: Column, d: Column) -> Column:
    return F.when(d == 0, "n/a").otherwise(F.concat(F.round(100.0 * n / F.when(d != 0, d)).cast("bigint").cast("string"), F.lit("%")))


def placeholder_number(name: Column | str) -> Column:
    """Which of Friend (1), Friend 2, ... a name is, in whatever case and spacing; null if none."""
    text = F.lower(strip(col(name)))
    number = F.regexp_extract(text, r"^friend ([1-9][0-9]{0,17})\z", 1).try_cast("bigint")
    return F.when(text == "friend", F.lit(1).cast("bigint")).when(number > 1, number)


def free_name(numbers: Column | str) -> Column:
    """The first of Friend, Friend 2, ... whose number isn't among the numbers."""
    numbers = col(numbers)
    free = F.get(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.size(numbers).cast("bigint") + 1), numbers), F.lit(0))
    return F.when(free == 1, F.lit("Friend")).otherwise(F.concat(F.lit("Friend "), free.cast("string")))


def placeholder_name(names: Column) -> Column:
    """The first of Friend, Friend 2, ... that no one has, in whatever case and spacing."""
    return free_name(F.array_compact(F.transform(names, placeholder_number)))


def id_number(i: Column | str) -> Column:
    """The number after an id's first letter, 0 without one."""
    return F.coalesce(F.substring(col(i), 2, 18).try_cast("bigint"), F.lit(0))


def id_after(most: Column) -> Column:
    """One more than the largest number of all ids, if there are any."""
    return F.greatest(F.lit(1), F.coalesce(most, F.lit(0)) + 1).cast("bigint")


def next_id(ids: Column) -> Column:
    """One more than the largest number after an id's first letter; ids without a number count as 0."""
    return id_after(F.array_max(F.transform(ids, id_number)))
