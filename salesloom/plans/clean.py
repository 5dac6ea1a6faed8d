"""The two cleaning jobs: automatic and interactive.

Both return the cleaned rows and a report with one row per group.  They share one plan: rows are
de-duplicated once, statistics and rows read that same shuffle, and the report's counters are sums
over the same flagged rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import dates, text
from salesloom.operators import cleaning as C
from salesloom.operators.spread import attach, measure_profile, modes
from salesloom.roles import SALES, Roles


Stage = Callable[[DataFrame], DataFrame]


class Cleaned(NamedTuple):
    rows: DataFrame
    report: DataFrame


def _count_map(counts: Mapping[str, Column]) -> Column:
    """Map of column name to count, without the zero counts."""
    pairs = [x for name, n in counts.items() for x in (F.lit(name), n.cast("bigint"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def _warnings(candidates: Sequence[Column]) -> Column:
    return F.filter(F.array(*candidates), lambda w: w.isNotNull())


def _message(n: Column, template: str, *args: Column) -> Column:
    """The message where ``n`` is positive, else null."""
    return F.when(n > 0, F.format_string(template, *args))


def _total(values: Sequence[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for v in values:
        out = out + v
    return out


def _count_if(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def _after_fold(test: Column) -> Column:
    """The test, tied to the copy count so that it is not moved below the de-duplication.

    Moved there, it would give this use of the fold a shuffle of its own.
    """
    return F.when(F.col(C.COPIES) > 0, test)


def _prepared(df: DataFrame, roles: Roles, ignore: Sequence[str]) -> DataFrame:
    """Renamed, checked, numeric, de-duplicated."""
    named = C.check_columns(C.harmonise(df), roles)
    return C.fold_copies(C.coerce_measures(named, roles), ignore)


def auto_clean(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
               ignore: Sequence[str] = (), groups: int | None = None, stage: Stage | None = None,
               wanted: Sequence[str] | None = None) -> Cleaned:
    """Rename, coerce, de-duplicate, fill, repair outliers, normalise, drop invalid entities.

    The statistics after filling follow from those before it: adding ``k`` copies of the median
    keeps the median and moves mean and variance by a closed formula.  So filling and outlier
    repair need one round of statistics, not two.

    ``groups`` is the number of groups where it is known; up to a bound it saves moving the rows.
    ``stage`` (such as ``session.staged``) keeps the repaired rows with their flags in a table, for
    callers that use both results in separate jobs; ``wanted`` names the columns of the rows those callers
    read, so that the table has no others.
    """
    by = list(by)
    columns_before = df.columns
    folded = _prepared(df, roles, ignore)
    has_ts = roles.ts in folded.columns
    texts = roles.text + ([roles.ts] if has_ts else [])
    data_columns = [c for c in folded.columns if c != C.COPIES]

    stats = C.with_modes(measure_profile(folded, roles.numeric, by, groups=groups), modes(folded, texts, by), by)
    wide = attach(folded, stats, by, "_num", "rows", groups)

    size = F.col("_num.rows")
    flags, values, medians = {}, {}, {}
    for c in roles.numeric:
        n = F.col(f"_num.{c}_n")
        median = F.coalesce(F.col(f"_num.{c}_median"), F.lit(0.0))
        mean0 = F.coalesce(F.col(f"_num.{c}_avg"), median)
        var0 = F.coalesce(F.col(f"_num.{c}_var"), F.lit(0.0))
        added = size - n
        # merging n values (mean0, var0) with `added` copies of the median
        mean = mean0 + (median - mean0) * added / size
        var = (var0 * n + (median - mean0) ** 2 * n * added / size) / size
        filled = F.coalesce(F.col(c), median)
        flags[f"_out_{c}"] = C.is_outlier(filled, size, mean, var)
        flags[f"_null_{c}"] = F.col(c).isNull()
        values[c] = F.when(F.col(f"_out_{c}"), median).otherwise(filled)
        medians[c] = median
    for c in texts:
        default = fixed.UNKNOWN_DATE_TEXT if c == roles.ts else fixed.UNKNOWN_TEXT
        flags[f"_null_{c}"] = F.col(c).isNull()
        values[c] = F.coalesce(F.col(c), F.col(f"_num.{c}_mode"), F.lit(default))
    values[roles.cat] = text.standard_category(values[roles.cat])
    if has_ts:
        values[roles.ts] = dates.parse_date(values[roles.ts])

    flagged = (
        wide.withColumns(flags)
        .withColumns(values | {f"_median_{c}": m for c, m in medians.items()})
        .withColumn("_invalid", C.is_invalid_entity(roles))
        .drop("_num")
    )
    row_columns = data_columns if wanted is None else [c for c in data_columns if c in wanted]
    if stage:
        flagged = stage(flagged.drop(*[c for c in data_columns if c not in row_columns]))
    rows = flagged.filter(_after_fold(~F.col("_invalid"))).select(*row_columns)

    # report --------------------------------------------------------------
    counted = flagged.groupBy(*by).agg(
        F.coalesce(F.sum(C.COPIES), F.lit(0)).cast("bigint").alias("original_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        _count_if(F.col("_invalid")).alias("invalid_removed"),
        *[_count_if(F.col(f"_null_{c}")).alias(f"_null_{c}") for c in roles.numeric + texts],
        *[_count_if(F.col(f"_out_{c}")).alias(f"_out_{c}") for c in roles.numeric],
        *[F.max(f"_median_{c}").alias(f"_median_{c}") for c in roles.numeric],
    )
    col = F.col
    removed = col("original_rows") - col("_distinct")
    missing = {c: col(f"_null_{c}") for c in roles.numeric + texts}
    outliers = {c: col(f"_out_{c}") for c in roles.numeric}
    empty = col("original_rows") == 0
    notes = [
        F.when(empty, F.lit(fixed.MSG_EMPTY)),
        _message(removed, fixed.MSG_DUPLICATES, removed),
        *[
            _message(n, fixed.MSG_OUTLIERS, F.lit(c), n, col(f"_median_{c}").cast("string"))
            for c, n in outliers.items()
        ],
        _message(col("invalid_removed"), fixed.MSG_INVALID, col("invalid_removed")),
        F.when(~empty & (_total(missing.values()) == 0), F.lit(fixed.MSG_NO_MISSING)),
        F.when(~empty & (_total(outliers.values()) == 0), F.lit(fixed.MSG_NO_OUTLIERS)),
    ]
    report = counted.select(
        *by, "original_rows",
        removed.alias("duplicates_removed"),
        _count_map(missing).alias("missing_filled"),
        _count_map(outliers).alias("outliers_handled"),
        "invalid_removed",
        (col("_distinct") - col("invalid_removed")).alias("final_rows"),
        _warnings(notes).alias("warnings"),
        F.array(*[F.lit(c) for c in columns_before]).alias("columns_original"),
        F.array(*[F.lit(c) for c in data_columns]).alias("columns_final"),
    )
    return Cleaned(rows, report)


def _bound(ranges: Mapping, column: str) -> tuple[float | None, float | None]:
    given = ranges.get(column) or {}
    lo, hi = given.get("min"), given.get("max")
    return (None if lo is None else float(lo), None if hi is None else float(hi))


def interactive_clean(df: DataFrame, config: Mapping, roles: Roles = SALES, by: Sequence[str] = (),
                      ignore: Sequence[str] = (), groups: int | None = None) -> Cleaned:
    """Cleaning by a user's choices.

    ``config`` may hold ``missing_action`` (``drop``, ``custom`` or ``default``), ``custom_fill``
    (column to value) and ``outlier_ranges`` (column to ``{"min": .., "max": ..}``; a column
    without a bound is repaired by z-score).  ``ignore`` names id columns that must not make
    otherwise equal rows distinct.
    """
    by = list(by)
    action = config.get("missing_action", "default")
    custom = config.get("custom_fill") or {}
    ranges = config.get("outlier_ranges") or {}
    columns_before = df.columns
    folded = _prepared(df, roles, ignore)
    data_columns = [c for c in folded.columns if c != C.COPIES]
    start = folded.withColumns({f"_null_{c}": F.col(c).isNull() for c in roles.required}
                               | {"_incomplete": C.any_missing(roles)})
    # missing values ------------------------------------------------------
    if action == "custom":
        filled = C.fill_custom_noted(start, custom, roles, by, groups)
    elif action == "drop":
        filled = start.withColumn("_fill", F.lit(None).cast("struct<x:string>"))
    else:
        action = "default"
        words = [F.lit(str(fixed.DEFAULT_FILLS[c])).alias(r) for c, r in zip(SALES.required, roles.required)]
        filled = C.fill_defaults(start, roles).withColumn("_fill", F.struct(*words))
    # rows to be dropped take no part in the statistics; masking instead of filtering leaves the
    # shared shuffle as it is
    kept = filled
    if action == "drop":
        kept = filled.withColumns({c: F.when(~F.col("_incomplete"), F.col(c)) for c in roles.numeric})

    # outliers ------------------------------------------------------------
    wide = attach(filled, measure_profile(kept, roles.numeric, by, groups=groups), by, "_num", "rows", groups)
    hits, values = {}, {}
    for c in roles.numeric:
        lo, hi = _bound(ranges, c)
        if lo is None and hi is None:
            # no value is missing any more, so the values number the rows
            hit = C.is_outlier(F.col(c), F.col(f"_num.{c}_n"), F.col(f"_num.{c}_avg"), F.col(f"_num.{c}_var"))
        else:
            hit = C.outside(F.col(c), lo, hi)
        stays = ~F.col("_incomplete") if action == "drop" else F.lit(True)
        hits[f"_out_{c}"] = hit & stays
        values[c] = F.when(F.col(f"_out_{c}"), F.col(f"_num.{c}_median")).otherwise(F.col(c))
    values[roles.cat] = text.standard_category(F.col(roles.cat))
    if roles.ts in data_columns:
        values[roles.ts] = dates.parse_date(F.col(roles.ts))
    flagged = wide.withColumns(hits).withColumns(values)
    rows = flagged.filter(_after_fold(~F.col("_incomplete"))) if action == "drop" else flagged
    rows = rows.select(*data_columns)

    # report --------------------------------------------------------------
    def first(c: Column) -> Column:
        return F.max(c)  # constant inside a group

    counted = flagged.groupBy(*by).agg(
        F.coalesce(F.sum(C.COPIES), F.lit(0)).cast("bigint").alias("original_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        _count_if(F.col("_incomplete")).alias("missing_count_total"),
        *[_count_if(F.col(f"_null_{c}")).alias(f"_null_{c}") for c in roles.required],
        *[_count_if(F.col(f"_out_{c}")).alias(f"_out_{c}") for c in roles.numeric],
        *[first(F.col(f"_num.{c}_median")).alias(f"_median_{c}") for c in roles.numeric],
        *([] if action == "drop" else [first(F.col("_fill")[c]).alias(f"_fill_{c}") for c in roles.required]),
    )
    col = F.col
    removed = col("original_rows") - col("_distinct")
    dropped = col("missing_count_total") if action == "drop" else F.lit(0).cast("bigint")
    entry_type = "struct<count:bigint,value:string>"
    if action == "drop":
        filled_map = F.create_map().cast(f"map<string,{entry_type}>")
        fill_notes = [
            _message(dropped, fixed.MSG_DROPPED, dropped),
            F.when((dropped == 0) & (col("_distinct") > 0), F.lit(fixed.MSG_NONE_TO_DROP)),
        ]
        none_missing = dropped == 0
    else:
        template = fixed.MSG_CUSTOM_FILL if action == "custom" else fixed.MSG_DEFAULT_FILL
        pairs = [
            x for c in roles.required
            for x in (F.lit(c), F.struct(col(f"_null_{c}").alias("count"), col(f"_fill_{c}").alias("value")))
        ]
        filled_map = F.map_filter(F.create_map(*pairs), lambda _, v: v["count"] > 0)
        fill_notes = [
            _message(col(f"_null_{c}"), template, F.lit(c), col(f"_null_{c}"), col(f"_fill_{c}"))
            for c in roles.required
        ]
        none_missing = col("missing_count_total") == 0
    outlier_total = _total([col(f"_out_{c}") for c in roles.numeric])
    details, outlier_notes = [], []
    for c in roles.numeric:
        lo, hi = _bound(ranges, c)
        by_z = lo is None and hi is None
        show = lambda b: F.lit(fixed.MSG_NO_BOUND if b is None else str(b))
        details += [F.lit(c), F.struct(
            col(f"_out_{c}").alias("count"),
            (F.lit(None).cast("string") if by_z else show(lo)).alias("min"),
            (F.lit(None).cast("string") if by_z else show(hi)).alias("max"),
            F.lit("zscore" if by_z else "range").alias("method"),
            col(f"_median_{c}").alias("replaced_with"),
        )]
        template = fixed.MSG_OUTLIERS if by_z else fixed.MSG_RANGE
        outlier_notes.append(
            _message(col(f"_out_{c}"), template, F.lit(c), col(f"_out_{c}"), col(f"_median_{c}").cast("string"))
        )
    empty = col("original_rows") == 0
    notes = [
        F.when(empty, F.lit(fixed.MSG_EMPTY)),
        _message(removed, fixed.MSG_DUPLICATES, removed),
        *fill_notes,
        F.when(~empty & none_missing, F.lit(fixed.MSG_NO_MISSING)),
        *outlier_notes,
        F.when(~empty & (outlier_total == 0), F.lit(fixed.MSG_NO_OUTLIERS)),
    ]
    report = counted.select(
        *by, "original_rows",
        removed.alias("duplicates_removed"),
        F.lit(action).alias("missing_action"),
        "missing_count_total",
        dropped.alias("missing_dropped"),
        filled_map.alias("missing_filled"),
        outlier_total.alias("outliers_detected"),
        outlier_total.alias("outliers_handled"),
        F.map_filter(F.create_map(*details), lambda _, v: v["count"] > 0).alias("outliers_detail"),
        (col("_distinct") - dropped).alias("final_rows"),
        _warnings(notes).alias("warnings"),
        F.array(*[F.lit(c) for c in columns_before]).alias("columns_original"),
        F.array(*[F.lit(c) for c in data_columns]).alias("columns_final"),
    )
    return Cleaned(rows, report)


def report_totals(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roll a cleaning report up to its totals.

    ``rows_removed`` counts duplicates only; rows dropped as invalid stay in their own column.
    """
    add = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)
    kinds = dict(report.dtypes)
    fills = F.map_values("missing_filled")
    if "struct" in kinds["missing_filled"]:
        fills = F.transform(fills, lambda v: v["count"])
    outliers = (
        add(F.map_values("outliers_handled")) if kinds["outliers_handled"].startswith("map")
        else F.col("outliers_handled")
    )
    extra = ["invalid_removed"] if "invalid_removed" in report.columns else []
    return report.select(
        *by, "original_rows",
        add(fills).alias("missing_filled"),
        outliers.alias("outliers_detected"),
        F.col("duplicates_removed").alias("rows_removed"),
        *extra, "final_rows",
    )
