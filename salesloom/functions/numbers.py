"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesloom import fixed

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(c: Column) -> Column:
    """Null out NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def to_number(c: Column) -> Column:
    """Text (or any number) to double; whatever is not a finite number becomes null.

    The shape test keeps out spellings the cast alone would take, such as ``12d``.
    """
    text = F.trim(c.cast("string"))
    return finite(F.when(text.rlike(_NUMBER), text.try_cast("double")))


def rounded(c: Column | str, digits: int = 0) -> Column:
    """Half-up rounding that does not depend on the order numbers were summed in.

    Sums of doubles differ in the last bits from run to run.  Rounding to eight digits first removes
    that noise, so a value like 10.015 goes the same way every time.
    """
    return F.round(F.round(c, 8), digits)


def measure(c: Column) -> Column:
    """A double column without NaN or infinity, for columns that are numeric already."""
    return finite(c.cast("double"))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def clamp0(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def share_pct(part: Column, total: Column, digits: int = 1) -> Column:
    """``part`` as a percentage of ``total``; zero where there is no total."""
    return rounded(F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0)) * 100, digits)


def stored_qty(c: Column) -> Column:
    """Whole units for storage: missing is zero, fractions are cut off."""
    return F.coalesce(c, F.lit(0)).cast("bigint")


def stored_price(c: Column) -> Column:
    return rounded(or_zero(c), 2)


def valid_measures(qty: Column, price: Column) -> Column:
    """Both measures present and positive."""
    return F.coalesce((qty > 0) & (price > 0), F.lit(False))


def euclid(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def p_text(p: Column) -> Column:
    """Printed p-value: ``<0.001`` or four decimals."""
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(rounded(p, 4).cast("string"))


def grouped_digits(c: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(c, 0)


def season_factor(month: Column) -> Column:
    """Seasonal factor of a month number; the naive factor for anything else."""
    table = F.create_map(*[F.lit(x) for kv in fixed.SEASONAL_FACTORS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, month.cast("int")), F.lit(fixed.NAIVE_FACTOR))
