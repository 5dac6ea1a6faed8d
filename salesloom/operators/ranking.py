"""Sorts, top-k and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions import numbers
from salesloom.operators.aggregates import dim_measures
from salesloom.operators.spread import attach, top_per_group
from salesloom.roles import SALES, Roles


def _tie_break(df: DataFrame, used: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in used]


def top_rows(df: DataFrame, sort_by: str = SALES.qty, order: str = "desc", n: int = 15,
             roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest rows (of every group) by a column, in descending or ascending display order.

    Ascending order shows the same largest rows, smallest of them first; ``n <= 0`` keeps all.
    Ties are settled by the remaining columns, so the choice is the same on every run.
    """
    if sort_by not in (roles.qty, roles.price, roles.dim):
        sort_by = roles.qty
    ties = _tie_break(df, [sort_by, *by])
    descending = [F.desc(sort_by), *[F.asc(c) for c in ties]]
    if by:
        largest = top_per_group(df, by, descending, n, "_rank").drop("_rank")
        return largest.orderBy(*by, *(descending if order != "asc" else [F.asc(sort_by), *[F.desc(c) for c in ties]]))
    largest = df.orderBy(*descending)
    if n > 0:
        largest = largest.limit(n)
    return largest if order != "asc" else largest.orderBy(F.asc(sort_by), *[F.desc(c) for c in ties])


def largest_rows(df: DataFrame, n: int = 10, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the largest volume, of the table or of every group."""
    cols = df.select(*by, roles.dim, roles.item, roles.qty, roles.price)
    order = [F.desc(roles.qty), F.asc(roles.dim), F.asc(roles.item), F.asc(roles.price)]
    if by:
        return top_per_group(cols, by, order, n, "_rank").drop("_rank")
    return cols.orderBy(*order).limit(n)


def top_dims(df: DataFrame, n: int = 7, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` entity groups with the largest volume, numbered."""
    sums = df.groupBy(*by, roles.dim).agg(F.sum(roles.qty).alias("total_sales"))
    order = [F.desc("total_sales"), F.asc(roles.dim)]
    if by:
        return top_per_group(sums, by, order, n)
    # numbering needs no partitioning: it sees n rows
    return sums.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def radar_dims(df: DataFrame, n: int = 6, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Measures of the ``n`` largest entity groups, with a flag whether there are enough to compare."""
    order = [F.desc("total_sales"), F.asc(roles.dim)]
    sums = dim_measures(df, roles, by)
    top = top_per_group(sums, by, order, n, "_rank").drop("_rank") if by else sums.orderBy(*order).limit(n)
    return top.withColumn("enough", F.count(F.lit(1)).over(Window.partitionBy(*by)) >= 3)  # over n rows


def top_rows_per_tenant(df: DataFrame, n: int = 10, roles: Roles = SALES,
                        tenant: str = "user_id") -> DataFrame:
    """Up to ``n`` rows with the largest volume of every tenant (or batch)."""
    cols = df.select(tenant, *roles.required)
    order = [F.desc(roles.qty), F.asc(roles.dim), F.asc(roles.item), F.asc(roles.price), F.asc(roles.cat)]
    return top_per_group(cols, [tenant], order, n)


def top_rows_per_upload(df: DataFrame, uploads: DataFrame, users: DataFrame, n: int = 10,
                        user_id: int | None = None, upload_id: int | None = None,
                        roles: Roles = SALES) -> DataFrame:
    """The same per upload batch, with the batch's owner, for all batches or chosen ones."""
    chosen = uploads
    if user_id is not None:
        chosen = chosen.filter(F.col("user_id") == user_id)
    if upload_id is not None:
        chosen = chosen.filter(F.col("upload_id") == upload_id)
        df = df.filter(F.col("upload_id") == upload_id)
    heads = chosen.join(users.select("user_id", "username"), "user_id").select("upload_id", "username", "filename")
    return top_rows_per_tenant(df, n, roles, "upload_id").join(heads, "upload_id")


def sort_by_volume(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    return df.orderBy(F.desc(roles.qty), roles.dim, roles.item)


def newest_first(uploads: DataFrame, id_col: str = "upload_id") -> DataFrame:
    return uploads.orderBy(F.desc("created_at"), F.desc(id_col))


def optional_limit(df: DataFrame, n: int | None) -> DataFrame:
    """At most ``n`` rows; nothing, zero or less means all."""
    return df if n is None or n <= 0 else df.limit(n)


def scale_groups(df: DataFrame, columns: Sequence[str], lo: float = 20.0, hi: float = 100.0,
                 flat: float = 50.0, by: Sequence[str] = ()) -> DataFrame:
    """Min-max scaling of each column (within its group) to ``lo``..``hi``; a constant column becomes ``flat``."""
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                *[e for c in columns for e in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])
    wide = attach(df, stats, by, "_m", "n")
    for c in columns:
        low, high = F.col(f"_m.{c}_min"), F.col(f"_m.{c}_max")
        scaled = (F.col(c) - low) / (high - low) * (hi - lo) + lo
        wide = wide.withColumn(f"{c}_scaled", F.when(high == low, flat).otherwise(scaled))
    return wide.drop("_m")


def stack_offsets(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Volume per entity group and category, with the volume stacked below it.

    The window runs over the categories of one entity group, not over its rows.
    """
    cells = df.groupBy(*by, roles.dim, roles.cat).agg(F.sum(roles.qty).alias("volume"))
    below = Window.partitionBy(*by, roles.dim).orderBy(roles.cat).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("bottom", F.coalesce(F.sum("volume").over(below), F.lit(0)))


def share_of_largest(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Value as a whole percentage of the group's largest value; zero where that is not positive."""
    top = df.groupBy(*by).agg(F.max(column).alias("top"), F.count(F.lit(1)).alias("n"))
    wide = attach(df, top, by, "_t", "n")
    pct = F.when(F.col("_t.top") > 0, numbers.rounded(F.col(column) / F.col("_t.top") * 100, 0)).otherwise(0.0)
    return wide.withColumn("pct", pct.cast("bigint")).drop("_t")
