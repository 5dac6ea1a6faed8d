"""Cleaning steps.  ``by`` names the keys statistics are taken over; none means the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import dates, numbers, text
from salesloom.operators.spread import MEDIAN_ACCURACY, attach, measure_profile, modes
from salesloom.roles import SALES, Roles

COPIES = "_copies"


# ---------------------------------------------------------------- columns

def harmonise(df: DataFrame, spellings: Mapping[str, Sequence[str]] = fixed.HEADER_SPELLINGS) -> DataFrame:
    """Rename known header spellings to their canonical names."""
    names = {w: canonical for canonical, words in spellings.items() for w in words}
    renamed = [names.get(c.strip().lower(), c) for c in df.columns]
    twice = sorted({c for c in renamed if renamed.count(c) > 1})
    if twice:
        raise ValueError(f"several headers stand for the same column: {', '.join(twice)}")
    return df.toDF(*renamed)


def missing_columns(columns: Sequence[str], roles: Roles = SALES) -> list[str]:
    return [c for c in roles.required if c not in columns]


def check_columns(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    """Raise unless all required columns are there."""
    missing = missing_columns(df.columns, roles)
    if missing:
        raise ValueError(fixed.MSG_MISSING_COLUMNS % (", ".join(missing), df.columns))
    return df


def coerce_measures(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    """Both measures as doubles; texts that are no finite number become missing."""
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: numbers.to_number(F.col(c)) if kinds[c] == "string" else numbers.measure(F.col(c))
        for c in roles.numeric
    })


# ---------------------------------------------------------------- duplicates

def fold_copies(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with the number of their copies in ``_copies``.

    One hash aggregate: copies collapse on the map side, so a row repeated a billion times is
    shuffled once per task, and the number removed comes along without a count before and after.
    Columns in ``ignore`` do not make rows distinct; the smallest value combination is kept.

    The condition on the count is always true.  It keeps the count part of every use of the result,
    so statistics and rows taken from it share one shuffle instead of three slightly different ones.
    """
    keys = [c for c in df.columns if c not in ignore]
    kept = [c for c in df.columns if c in ignore]
    counts = F.count(F.lit(1)).alias(COPIES)
    some = F.col(COPIES) > 0
    if not kept:
        return df.groupBy(*keys).agg(counts).filter(some)
    grouped = df.groupBy(*keys).agg(counts, F.min(F.struct(*kept)).alias("_kept")).filter(some)
    return grouped.select(*[F.col("_kept")[c].alias(c) if c in kept else F.col(c) for c in df.columns], COPIES)


def drop_copies(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    return fold_copies(df, ignore).drop(COPIES)


def copies_report(df: DataFrame, by: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """Rows before, rows after and rows removed by de-duplication."""
    folded = fold_copies(df, ignore)
    before = F.coalesce(F.sum(COPIES), F.lit(0))
    after = F.count(F.lit(1))
    return folded.groupBy(*by).agg(
        before.cast("bigint").alias("original_rows"), after.alias("distinct_rows"),
        (before - after).cast("bigint").alias("duplicates_removed"),
    )


# ---------------------------------------------------------------- missing values

def any_missing(roles: Roles = SALES) -> Column:
    out = F.lit(False)
    for c in roles.required:
        out = out | F.col(c).isNull()
    return out


def count_missing(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Rows with any required value missing, and missing values per column."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_missing(roles)).alias("rows_with_missing"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in roles.required],
    )


def drop_missing(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    return df.dropna(subset=roles.required)


def fill_median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                accuracy: int = MEDIAN_ACCURACY, groups: int | None = None) -> DataFrame:
    """Missing numbers become the group's exact median, or zero in a group without any number."""
    stats = measure_profile(df, columns, by, accuracy, groups)
    wide = attach(df, stats, by, "_s", "rows", groups)
    return wide.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_s.{c}_median"), F.lit(0.0)) for c in columns
    }).drop("_s")


def with_modes(sizes: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring the modes, which lack groups without any value, to a table with one row per group."""
    if not by:
        packed = F.struct(*found.columns)
        whole = sizes.withColumn("_m", found.select(packed).scalar())
        return whole.select(*sizes.columns, *[F.col("_m")[c].alias(c) for c in found.columns])
    return join_on(sizes, found, by, "left")


def _group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Equi-join of two per-group tables that also matches null keys."""
    named = right.select(*[F.col(b).alias(f"_r_{b}") for b in by],
                         *[c for c in right.columns if c not in by])
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_r_{b}"))
    return left.join(named, cond, how).drop(*[f"_r_{b}" for b in by])


def fill_mode(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
              default: str = fixed.UNKNOWN_TEXT, groups: int | None = None) -> DataFrame:
    """Missing texts become the group's most frequent value, or ``default``."""
    stats = with_modes(_group_sizes(df, by), modes(df, columns, by), by)
    wide = attach(df, stats, by, "_s", "rows", groups)
    return wide.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_s.{c}_mode"), F.lit(default)) for c in columns
    }).drop("_s")


def fill_mode_date_text(df: DataFrame, column: str = SALES.ts, by: Sequence[str] = ()) -> DataFrame:
    """The same for date texts, which have their own default."""
    return fill_mode(df, [column], by, fixed.UNKNOWN_DATE_TEXT)


def fill_defaults(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    """Missing values become fixed defaults."""
    fills = dict(zip(roles.required, [fixed.DEFAULT_FILLS[c] for c in SALES.required]))
    return df.fillna({c: v for c, v in fills.items() if c in df.columns})


def parse_fill(value, numeric: bool):
    """A user's fill value: the value itself, or None where the statistic has to serve."""
    if value is None:
        return None
    if not numeric:
        return str(value)
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def fill_custom(df: DataFrame, values: Mapping[str, object], roles: Roles = SALES,
                by: Sequence[str] = (), groups: int | None = None) -> DataFrame:
    """Missing values become the user's values; columns without a usable one get median or mode."""
    return fill_custom_noted(df, values, roles, by, groups).drop("_fill")


def fill_custom_noted(df: DataFrame, values: Mapping[str, object], roles: Roles, by: Sequence[str],
                      groups: int | None = None) -> DataFrame:
    """As ``fill_custom``, keeping the fill values used as texts in the struct ``_fill``."""
    given = {c: parse_fill(values.get(c), c in roles.numeric) for c in roles.required}
    by_median = [c for c in roles.numeric if given[c] is None]
    by_mode = [c for c in roles.text if given[c] is None]
    fill = {c: F.lit(v) for c, v in given.items() if v is not None}
    out = df
    if by_median or by_mode:
        stats = measure_profile(df, by_median, by, groups=groups) if by_median else _group_sizes(df, by)
        if by_mode:
            stats = with_modes(stats, modes(df, by_mode, by), by)
        out = attach(df, stats, by, "_s", "rows", groups)
        fill |= {c: F.coalesce(F.col(f"_s.{c}_median"), F.lit(0.0)) for c in by_median}
        fill |= {c: F.coalesce(F.col(f"_s.{c}_mode"), F.lit(fixed.UNKNOWN_TEXT)) for c in by_mode}
    return (
        out.withColumn("_fill", F.struct(*[fill[c].cast("string").alias(c) for c in roles.required]))
        .withColumns({c: F.coalesce(F.col(c), fill[c]) for c in roles.required})
        .drop("_s")
    )


# ---------------------------------------------------------------- outliers

def is_outlier(c: Column, rows: Column, mean: Column, var: Column) -> Column:
    """More than three population standard deviations off, in groups of more than three rows."""
    z = F.abs(c - mean) / F.sqrt(var)
    return F.coalesce((rows > fixed.Z_MIN_ROWS) & (var > 0) & (z > fixed.Z_LIMIT), F.lit(False))


def repair_zscore(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                  flag: bool = False, accuracy: int = MEDIAN_ACCURACY,
                  groups: int | None = None) -> DataFrame:
    """Replace z-score outliers by the group median (taken including them), column by column.

    ``flag`` keeps a boolean ``{c}_outlier`` next to each repaired column.
    """
    wide = attach(df, measure_profile(df, columns, by, accuracy, groups), by, "_s", "rows", groups)
    hits = {
        c: is_outlier(F.col(c), F.col("_s.rows"), F.col(f"_s.{c}_avg"), F.col(f"_s.{c}_var"))
        for c in columns
    }
    wide = wide.withColumns({f"{c}_outlier": h for c, h in hits.items()}).withColumns({
        c: F.when(F.col(f"{c}_outlier"), F.col(f"_s.{c}_median")).otherwise(F.col(c)) for c in columns
    })
    return wide.drop("_s", *([] if flag else [f"{c}_outlier" for c in columns]))


def outside(c: Column, lo: float | None, hi: float | None) -> Column:
    test = F.lit(False)
    if lo is not None:
        test = test | (c < lo)
    if hi is not None:
        test = test | (c > hi)
    return F.coalesce(test, F.lit(False))


def repair_range(df: DataFrame, column: str, lo: float | None, hi: float | None,
                 by: Sequence[str] = (), flag: bool = False, groups: int | None = None) -> DataFrame:
    """Replace values outside the inclusive range by the group median (taken including them)."""
    wide = attach(df, measure_profile(df, [column], by, groups=groups), by, "_s", "rows", groups)
    wide = wide.withColumn(f"{column}_outlier", outside(F.col(column), lo, hi)).withColumn(
        column, F.when(F.col(f"{column}_outlier"), F.col(f"_s.{column}_median")).otherwise(F.col(column))
    )
    return wide.drop("_s", *([] if flag else [f"{column}_outlier"]))


# ---------------------------------------------------------------- categories, dates, entities

def standardise_category(df: DataFrame, roles: Roles = SALES, ignore_case: bool = False) -> DataFrame:
    return df.withColumn(roles.cat, text.standard_category(F.col(roles.cat), ignore_case=ignore_case))


def parse_dates(df: DataFrame, column: str = SALES.ts) -> DataFrame:
    return df.withColumn(column, dates.parse_date(F.col(column)))


def is_invalid_entity(roles: Roles = SALES) -> Column:
    return text.invalid_name(F.col(roles.dim)) | text.invalid_name(F.col(roles.item))


def drop_invalid(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    return df.filter(~is_invalid_entity(roles))


# ---------------------------------------------------------------- storage form

def store_form(df: DataFrame, roles: Roles = SALES, keep: Sequence[str] = ()) -> DataFrame:
    """The five stored columns: whole units, prices to two decimals, nothing missing."""
    return df.select(
        *keep,
        F.col(roles.dim), F.col(roles.item),
        numbers.stored_qty(F.col(roles.qty)).alias(roles.qty),
        numbers.stored_price(F.col(roles.price)).alias(roles.price),
        F.col(roles.cat),
    )
