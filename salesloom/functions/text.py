"""Text column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesloom import fixed


def null_if_na(c: Column, tokens: Iterable[str] = tuple(fixed.NA_TEXTS)) -> Column:
    """Null for every text that stands for a missing value."""
    return F.when(~c.isin(list(tokens)), c)


def standard_category(c: Column, spellings: dict[str, list[str]] = fixed.CATEGORY_SPELLINGS,
                      ignore_case: bool = False) -> Column:
    """Canonical category of a raw spelling; unknown spellings pass through trimmed.

    One membership test per canonical value, so a spelling is found by hash lookup.
    """
    trimmed = F.trim(c)
    key = F.lower(trimmed) if ignore_case else trimmed
    out = None
    for name, words in spellings.items():
        if ignore_case:
            words = [w.lower() for w in words]
        hit = key.isin(words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(trimmed)


def has_mark(c: Column, marks: Iterable[str]) -> Column:
    """1 where the text contains any of the marks, else 0."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | c.contains(m)
    return F.coalesce(hit, F.lit(False)).cast("int")


def is_electric(c: Column) -> Column:
    return has_mark(c, fixed.ELECTRIC_MARKS)


def is_hybrid(c: Column) -> Column:
    return has_mark(c, fixed.HYBRID_MARKS)


def display_name(dim: Column, item: Column) -> Column:
    return F.trim(F.concat_ws(" ", dim, item))


def compact_label(dim: Column, item: Column, dim_len: int = 4, item_len: int = 6) -> Column:
    """Short chart label from the first letters of both names."""
    return F.concat(F.substring(dim, 1, dim_len), F.substring(item, 1, item_len))


def ellipsis(c: Column, limit: int = 10) -> Column:
    """Texts longer than ``limit`` are cut one short of it and get three dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("..."))).otherwise(c)


def invalid_name(c: Column) -> Column:
    return F.coalesce(c.isin(fixed.INVALID_NAMES), F.lit(False))


def strength_word(r: Column) -> Column:
    """Wording for a correlation coefficient."""
    sign = F.when(r > 0, fixed.POSITIVE_WORD).otherwise(fixed.NEGATIVE_WORD)
    out = None
    for bound, word in fixed.STRENGTH_WORDS:
        test, text = F.abs(r) >= bound, F.concat(F.lit(word), sign)
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.otherwise(fixed.NO_CORRELATION)


def segment_label(rank: Column, avg_price: Column) -> Column:
    """Name of a market segment from its sales rank and mean price."""
    tag = (
        F.when(rank == 1, fixed.SEGMENT_TAGS["top"])
        .when(avg_price > fixed.HIGH_PRICE, fixed.SEGMENT_TAGS["high"])
        .when(avg_price < fixed.LOW_PRICE, fixed.SEGMENT_TAGS["low"])
        .otherwise(fixed.SEGMENT_TAGS["mid"])
    )
    return F.concat(F.lit("簇"), rank.cast("string"), F.lit("·"), tag)


def printable(c: Column) -> Column:
    """Text form of any column; missing prints as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))
