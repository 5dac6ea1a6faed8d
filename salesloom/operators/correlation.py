"""Price and volume correlation, overall and per stratum."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import numbers, text
from salesloom.functions.student import corr_p_value
from salesloom.operators import aggregates
from salesloom.operators.cleaning import join_on
from salesloom.operators.filters import scatter_rounded, valid_rows
from salesloom.operators.spread import attach, running_start, top_per_group
from salesloom.roles import SALES, Roles
from salesloom.session import cut_lineage


def _xy(df: DataFrame, roles: Roles, by: Sequence[str]) -> DataFrame:
    rows = valid_rows(df, roles)
    return rows.select(*by, F.col(roles.price).cast("double").alias("x"),
                       F.col(roles.qty).cast("double").alias("y"))


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a column is constant.

    The built-in ``corr`` divides by zero there, which fails the job under ANSI rules.
    """
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def linear_fit(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Points, Pearson r, slope, intercept and r squared of volume on price, in one aggregate."""
    return _xy(df, roles, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        pearson("x", "y").alias("r"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
    )


def average_ranks(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (x, y) pairs of the valid rows with their count ``c`` and the average rank of each value.

    Tied values share the mean of their positions.  The average rank of a value is the number of
    smaller rows plus (copies + 1) / 2, and the number of smaller rows is a prefix sum over distinct
    values.  No window ever covers a whole group, and a value shared by very many rows is one row.
    The pairs are written once, since ranks and sums read them several times.
    """
    by = list(by)
    pairs = cut_lineage(_xy(df, roles, by).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("c")))
    out = pairs
    for v in ("x", "y"):
        values = pairs.groupBy(*by, v).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("w"))
        ranks = running_start(values, [v], "c", by).select(
            *by, v, "w", (F.col("start") + (F.col("c") + 1) / 2).alias("rank"))
        out = attach(out, ranks, by + [v], f"_{v}", "w")
        out = out.withColumn(f"r{v}", F.col(f"_{v}.rank")).drop(f"_{v}")
    return out


def spearman(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Spearman's rho: Pearson correlation of average ranks.

    The ranks of n points average (n + 1) / 2 exactly, so with n known the moments are centred; with
    the sums of raw ranks alone they would cancel at this size.
    """
    by = list(by)
    ranked = average_ranks(df, roles, by)
    sizes = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("w"))
    wide = attach(ranked, sizes, by, "_s", "w")
    mid = (F.col("_s.n") + 1) / 2
    dx, dy, c = F.col("rx") - mid, F.col("ry") - mid, F.col("c")
    return wide.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.try_divide(F.sum(c * dx * dy), F.sqrt(F.sum(c * dx * dx) * F.sum(c * dy * dy))).alias("rho"),
    )


def _signed(r: str, n: str):
    return corr_p_value(F.col(r), F.col(n))


def overall(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """The whole-table (or per-key) result with p-values, wording and equation text.

    Groups with fewer than five valid points carry only their count and an error text.
    """
    by = list(by)
    fit, rank = linear_fit(df, roles, by), spearman(df, roles, by).drop("n")
    if by:
        wide = join_on(fit, rank, by, "left")
    else:
        wide = fit.withColumn("rho", rank.select("rho").scalar())
    wide = wide.withColumn("p", _signed("r", "n")).withColumn("p_rho", _signed("rho", "n"))
    enough = F.col("n") >= fixed.MIN_POINTS
    return wide.select(
        *by, enough.alias("success"),
        F.when(~enough, F.format_string(fixed.MSG_TOO_FEW, F.lit(fixed.MIN_POINTS), F.col("n"))).alias("error"),
        F.col("n").alias("data_points"),
        *[F.when(enough, e).alias(a) for e, a in (
            (numbers.rounded("r", 4), "pearson_r"),
            (numbers.p_text(F.col("p")), "pearson_p"),
            (numbers.rounded("rho", 4), "spearman_rho"),
            (numbers.p_text(F.col("p_rho")), "spearman_p"),
            (text.strength_word(F.col("r")), "interpretation"),
            (numbers.rounded("r2", 4), "r_squared"),
            (F.format_string(fixed.MSG_EQUATION, F.col("intercept"), F.col("slope")), "equation"),
        )],
    )


def by_category(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation inside each category; small strata get a note instead."""
    keyed = df.withColumn(roles.cat, F.coalesce(roles.cat, F.lit(fixed.UNKNOWN_CATEGORY)))
    keys = [*by, roles.cat]
    stats = _xy(keyed, roles, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("r"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"),
    ).withColumn("p", _signed("r", "n"))
    enough = F.col("n") >= fixed.MIN_STRATUM
    return stats.select(
        *keys, "n",
        F.when(enough, numbers.rounded("r", 4)).alias("r"),
        F.when(enough, numbers.p_text(F.col("p"))).alias("p"),
        F.coalesce(enough & (F.col("p") < fixed.SIGNIFICANT_P), F.lit(False)).alias("significant"),
        F.when(enough, numbers.rounded("mx", 1)).alias("avg_price"),
        F.when(enough, numbers.rounded("my", 1)).alias("avg_sales"),
        F.when(~enough, fixed.SMALL_STRATUM_NOTE).alias("note"),
    )


def counterexamples(df: DataFrame, n: int = 4, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows furthest off the regression line, with the expected volume."""
    by = list(by)
    fit = linear_fit(df, roles, by)
    rows = valid_rows(df, roles).select(*by, roles.dim, roles.item,
                                        F.col(roles.price).cast("double").alias("x"),
                                        F.col(roles.qty).cast("double").alias("y"))
    wide = attach(rows, fit, by, "_f", "n").filter(F.col("_f.n") >= fixed.MIN_POINTS)
    expected = F.col("_f.intercept") + F.col("_f.slope") * F.col("x")
    # the residual is rounded far below its meaning, so equal rows tie on every engine
    scored = wide.withColumn("_expected", expected).withColumn(
        "residual", numbers.rounded(F.abs(F.col("y") - F.col("_expected")), 6)).drop("_f")
    order = [F.desc("residual"), F.asc(roles.dim), F.asc(roles.item), F.asc("x"), F.asc("y")]
    best = top_per_group(scored, by, order, n) if by else scored.orderBy(*order).limit(n)
    name = text.display_name(F.col(roles.dim), F.col(roles.item))
    above = F.when(F.col("y") > F.col("_expected"), fixed.ABOVE_WORD).otherwise(fixed.BELOW_WORD)
    return best.select(
        *by, F.when(name == "", fixed.UNKNOWN_ITEM).otherwise(name).alias("model"),
        numbers.rounded("x", 1).alias("price"),
        numbers.rounded("y", 0).cast("bigint").alias("actual_sales"),
        numbers.rounded("_expected", 0).cast("bigint").alias("expected_sales"),
        "residual", above.alias("direction"),
        F.format_string(fixed.MSG_RESIDUAL, F.col("y"), above, F.col("_expected")).alias("reason"),
    )


class Correlation(NamedTuple):
    overall: DataFrame
    summary: DataFrame
    scatter: DataFrame
    by_category: DataFrame | None
    counterexamples: DataFrame
    segments: DataFrame


def analyze(df: DataFrame, stratify: str | None = None, roles: Roles = SALES,
            by: Sequence[str] = ()) -> Correlation:
    """All tables of the correlation view."""
    valid = valid_rows(df, roles)
    return Correlation(
        overall(df, roles, by),
        aggregates.ranges(valid, roles, by),
        scatter_rounded(df, roles, by),
        by_category(df, roles, by) if stratify in ("energy", "energy_type", roles.cat) else None,
        counterexamples(df, roles=roles, by=by),
        aggregates.price_segments(valid, roles, by),
    )
