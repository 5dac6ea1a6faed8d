"""Date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesloom import fixed


def parse_date(c: Column) -> Column:
    """Date from text in any of the known formats, null when none fits.

    A cheap shape test picks the candidate formats, so a row only pays for the parser of its own
    shape.  ``10/11/2024`` fits month-first, ``13/11/2024`` only day-first; hence the coalesce
    inside one shape.
    """
    text = F.trim(c.cast("string"))
    shapes: dict[str, list[str]] = {}
    for shape, pattern in fixed.DATE_FORMATS + fixed.FALLBACK_DATE_FORMATS:
        shapes.setdefault(shape, []).append(pattern)
    out = None
    for shape, patterns in shapes.items():
        parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])
        out = F.when(text.rlike(shape), parsed) if out is None else out.when(text.rlike(shape), parsed)
    return out.cast("date")


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
