"""Rounding, safe division and as-of dates that every plan shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 4) -> Column:
    """Half-up rounding of a double by plain arithmetic, alike in every engine; null stays null."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_change(now: Column, before: Column, digits: int = 2) -> Column:
    """Change in per cent, null unless the earlier value is positive."""
    return F.when(before > 0, half_up((now / before - 1) * 100.0, digits))


def money(x: Column) -> Column:
    """1.5T, 2.3B, 4.0M, 7.1K or the plain number, with a dollar sign."""
    out = F.format_string("%.0f", F.abs(x))
    for size, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(F.abs(x) >= size, F.concat(F.format_string("%.1f", F.abs(x) / size), F.lit(mark))).otherwise(out)
    return F.concat(F.when(x < 0, "-$").otherwise("$"), out)


def to_date(x: Column) -> Column:
    """The first ten characters as a date; empty, '0000-00-00', 'N/A' and unreadable values are null."""
    return F.try_to_date(F.substring(F.trim(x.cast("string")), 1, 10), "yyyy-MM-dd")


def to_number(x: Column) -> Column:
    value = x.cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def to_integer(x: Column) -> Column:
    """Truncated towards zero."""
    return to_number(x).try_cast("bigint")


def shown_number(x: Column) -> Column:
    """1,234.50; a dash for null."""
    return F.when(x.isNull(), "–").otherwise(F.format_string("%,.2f", half_up(x, 2)))


def shown_percent(x: Column) -> Column:
    return F.when(x.isNull(), "–").otherwise(F.concat(F.format_string("%,.2f", half_up(x * 100, 2)), F.lit("%")))


def shown_big(x: Column) -> Column:
    """2.34B and the like."""
    out = F.format_string("%,.2f", half_up(x, 2))
    for size, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(F.abs(x) >= size, F.concat(F.format_string("%,.2f", half_up(x / size, 2)), F.lit(mark))).otherwise(out)
    return F.when(x.isNull(), "–").otherwise(out)
