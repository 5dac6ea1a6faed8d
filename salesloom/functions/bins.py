"""Half-open numeric bins given as ``(label, low, high)``; ``high=None`` is open-ended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_bin(c: Column, lo: float, hi: float | None) -> Column:
    test = c >= lo
    return test if hi is None else test & (c < hi)


def bin_id(c: Column, bins) -> Column:
    """Position of the bin a value falls in, null outside all bins."""
    out = None
    for i, (_, lo, hi) in enumerate(bins):
        out = F.when(in_bin(c, lo, hi), i) if out is None else out.when(in_bin(c, lo, hi), i)
    return out


def bin_label(i: Column, bins) -> Column:
    return F.element_at(F.array(*[F.lit(b[0]) for b in bins]), (i + 1).cast("int"))
