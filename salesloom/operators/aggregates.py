"""Dashboard aggregates.

``by`` groups by tenant, batch or any other keys.  Where several figures are asked for, they come
out of one aggregate per level: first per entity, then per group.  The entity level is keyed by
group *and* entity, so a tenant with a third of all rows is still summed up by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import bins as B
from salesloom.functions import numbers, text
from salesloom.operators.cleaning import join_on
from salesloom.operators.filters import revenue
from salesloom.operators.spread import attach, shared
from salesloom.roles import SALES, Roles


def entity_level(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and entity with everything the overview needs."""
    qty, price, cat = F.col(roles.qty), F.col(roles.price), F.col(roles.cat)
    return df.groupBy(*by, roles.dim, roles.item).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(qty).alias("volume"),
        F.sum(price).alias("price_sum"),
        F.count(price).alias("price_rows"),
        F.max(qty).alias("best_volume"),
        F.max(revenue(roles)).alias("best_revenue"),
        *[
            F.sum(F.when(cat.isin(words), qty)).alias(f"{name}_volume")
            for name, words in fixed.SHARE_SPELLINGS.items()
        ],
    )


def overview(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
             tenants: DataFrame | None = None) -> DataFrame:
    """The headline figures of each group, one row per group.

    Ties go to the alphabetically first names; missing measures and names never win.  With ``tenants`` (the full list of keys), groups
    without rows get a row of zeros and dashes.
    """
    return overview_of(entity_level(df, roles, by), roles, by, tenants)


def overview_of(level: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
                tenants: DataFrame | None = None) -> DataFrame:
    """The overview from rows of ``entity_level``."""
    by, level = list(by), shared(level)
    dim, item = F.col(roles.dim), F.col(roles.item)
    main = level.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.min(F.when(F.col("best_volume").isNotNull(), F.struct((-F.col("best_volume")).alias("m"), dim, item))).alias("_car"),
        F.min(F.when(F.col("best_revenue").isNotNull(), F.struct((-F.col("best_revenue")).alias("m"), dim, item))).alias("_money"),
        F.try_divide(F.sum("price_sum"), F.sum("price_rows")).alias("_avg_price"),
        F.sum("volume").alias("_volume"),
        *[F.sum(f"{s}_volume").alias(f"_{s}") for s in fixed.SHARE_SPELLINGS],
    )
    items = (
        level.groupBy(*by, roles.item).agg((-F.sum("rows")).alias("m"))
        .groupBy(*by).agg(F.min(F.when(item.isNotNull(), F.struct("m", item))).alias("_item"))
    )
    dims = (
        level.groupBy(*by, roles.dim).agg((-F.sum("rows")).alias("m"))
        .groupBy(*by).agg(F.min(F.when(dim.isNotNull(), F.struct("m", dim))).alias("_dim"), F.count(dim).alias("_dims"))
    )
    if by:
        wide = join_on(join_on(main, items, by, "inner"), dims, by, "inner")
    else:
        wide = (
            main.withColumn("_i", items.select(F.struct("_item")).scalar())
            .withColumn("_d", dims.select(F.struct("_dim", "_dims")).scalar())
            .select(*main.columns, "_i.*", "_d.*")
        )
    if tenants is not None and by:
        wide = join_on(tenants.select(*by), wide, by, "left")
    dash = F.lit("-")
    name = lambda s: F.when(F.col(s).isNotNull(), text.display_name(F.col(s)[roles.dim], F.col(s)[roles.item])).otherwise(dash)
    some = F.col("total_rows") > 0
    return wide.select(
        *by,
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.when(some, name("_car")).otherwise(dash).alias("top_volume_name"),
        F.coalesce(-F.col("_car.m"), F.lit(0)).alias("top_volume"),
        F.when(some, name("_money")).otherwise(dash).alias("top_revenue_name"),
        F.coalesce(numbers.rounded(-F.col("_money.m"), 2), F.lit(0.0)).alias("top_revenue"),
        F.coalesce(F.col("_item")[roles.item], dash).alias("top_item_by_rows"),
        F.coalesce(F.col("_dim")[roles.dim], dash).alias("top_dim_by_rows"),
        F.coalesce(numbers.rounded("_avg_price", 2), F.lit(0.0)).alias("avg_price"),
        F.coalesce("_dims", F.lit(0)).alias("dim_count"),
        *[
            numbers.share_pct(F.coalesce(F.col(f"_{s}"), F.lit(0)), F.col("_volume")).alias(f"{s}_ratio")
            for s in fixed.SHARE_SPELLINGS
        ],
    )


def volume_by_dim(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Total volume per entity group, largest first."""
    return (
        df.groupBy(*by, roles.dim).agg(F.sum(roles.qty).alias("total_sales"))
        .orderBy(*by, F.desc("total_sales"), roles.dim)
    )


def counts(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Rows and distinct entity groups."""
    distinct = F.approx_count_distinct(roles.dim) if approximate else F.countDistinct(roles.dim)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), distinct.alias("dims"))


def average_price(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(numbers.rounded(F.avg(roles.price), 2).alias("avg_price"))


def volume_shares(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
                  spellings: Mapping[str, Sequence[str]] = fixed.SHARE_SPELLINGS) -> DataFrame:
    """Share of each category family in the volume, in percent; zero without any volume."""
    qty, cat = F.col(roles.qty), F.col(roles.cat)
    sums = df.groupBy(*by).agg(
        F.sum(qty).alias("_all"),
        *[F.coalesce(F.sum(F.when(cat.isin(list(w)), qty)), F.lit(0)).alias(f"_{s}") for s, w in spellings.items()],
    )
    return sums.select(*by, *[numbers.share_pct(F.col(f"_{s}"), F.col("_all")).alias(s) for s in spellings])


def rows_by_category(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Row count per category, most frequent first."""
    return (
        df.groupBy(*by, roles.cat).agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(*by, F.desc("rows"), roles.cat)
    )


def price_histogram(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
                    bins=fixed.PRICE_BINS) -> DataFrame:
    """Rows per price bin; empty bins are listed with zero.

    All bins are counted in one aggregate row per group, which is then unfolded, so empty bins
    need no join with a bin table.
    """
    price = F.col(roles.price)
    counted = df.groupBy(*by).agg(*[
        F.count_if(B.in_bin(price, lo, hi)).alias(f"_b{i}") for i, (_, lo, hi) in enumerate(bins)
    ])
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("bin"), F.lit(label).alias("label"), F.lit(float(lo)).alias("lo"),
            F.lit(None if hi is None else float(hi)).cast("double").alias("hi"), F.col(f"_b{i}").alias("rows"),
        )
        for i, (label, lo, hi) in enumerate(bins)
    ])
    return counted.select(*by, F.inline(entries))


def price_segments(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
                   bins=fixed.PRICE_SEGMENTS) -> DataFrame:
    """Rows, mean volume and mean price per price segment; empty segments are left out."""
    return (
        df.withColumn("_bin", B.bin_id(F.col(roles.price), bins))
        .filter(F.col("_bin").isNotNull())
        .groupBy(*by, "_bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            numbers.rounded(F.avg(roles.qty), 0).cast("bigint").alias("avg_sales"),
            numbers.rounded(F.avg(roles.price), 1).alias("avg_price"),
        )
        .select(*by, F.col("_bin").alias("bin"), B.bin_label(F.col("_bin"), bins).alias("label"),
                "rows", "avg_sales", "avg_price")
    )


def dim_measures(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Total volume, mean price, rows and value index (volume per price) of each entity group."""
    sums = df.groupBy(*by, roles.dim).agg(
        F.sum(roles.qty).alias("total_sales"),
        F.avg(roles.price).alias("avg_price"),
        F.count(roles.item).alias("item_rows"),
    )
    index = F.when(F.col("avg_price") > 0, F.try_divide("total_sales", "avg_price")).otherwise(0.0)
    return sums.withColumn("value_index", index)


def pivot_by_category(df: DataFrame, categories: Sequence[str] = tuple(fixed.CATEGORY_SPELLINGS),
                      roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Volume per entity group, one column per listed category, absent combinations zero."""
    return (
        df.groupBy(*by, roles.dim).pivot(roles.cat, list(categories)).agg(F.sum(roles.qty))
        .fillna(0, subset=list(categories))
    )


def dim_share(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Volume of each entity group and its share of the total in percent."""
    sums = df.groupBy(*by, roles.dim).agg(F.sum(roles.qty).alias("total_sales"), F.count(F.lit(1)).alias("_n"))
    sums = shared(sums)
    totals = sums.groupBy(*by).agg(F.sum("total_sales").alias("all"), F.count(F.lit(1)).alias("n"))
    wide = attach(sums, totals, by, "_t", "n")
    return wide.select(*by, roles.dim, "total_sales",
                       numbers.share_pct(F.col("total_sales"), F.col("_t.all"), 2).alias("pct"))


def histogram_share(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
                    bins=fixed.PRICE_BINS) -> DataFrame:
    """Price histogram with the share of each bin, fullest bin first."""
    hist = price_histogram(df, roles, by, bins)
    totals = hist.groupBy(*by).agg(F.sum("rows").alias("all"), F.count(F.lit(1)).alias("n"))
    return (
        attach(hist, totals, by, "_t", "n")
        .select(*by, "bin", "label", "rows", numbers.share_pct(F.col("rows"), F.col("_t.all")).alias("pct"))
        .orderBy(*by, F.desc("rows"), "bin")
    )


def ranges(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Means and ranges of both measures."""
    qty, price = F.col(roles.qty), F.col(roles.price)
    whole = lambda c: numbers.rounded(c, 0).cast("bigint")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        numbers.rounded(F.avg(price), 1).alias("avg_price"), numbers.rounded(F.avg(qty), 1).alias("avg_sales"),
        numbers.rounded(F.min(price), 1).alias("price_min"), numbers.rounded(F.max(price), 1).alias("price_max"),
        whole(F.min(qty)).alias("sales_min"), whole(F.max(qty)).alias("sales_max"),
    )


def summary_snapshot(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """One row per group: row count, sorted entity groups, rows per category, mean price, time.

    Entity groups and categories are reduced to their distinct values before they are listed.
    """
    cells = df.groupBy(*by, roles.dim, roles.cat).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(roles.price).alias("p"), F.count(roles.price).alias("pn"))
    return summary_of(cells, roles, by)


def summary_of(cells: DataFrame, roles: Roles = SALES, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """The summary from rows per entity group and category: ``rows``, sum ``p`` and number ``pn`` of prices."""
    by, cells = list(by), shared(cells)
    main = cells.groupBy(*by).agg(
        F.sum("rows").alias("record_count"),
        F.countDistinct(roles.dim).alias("brand_count"),
        F.sort_array(F.collect_set(roles.dim)).alias("brands"),
        numbers.rounded(F.try_divide(F.sum("p"), F.sum("pn")), 2).alias("avg_price"),
    )
    by_cat = (
        cells.filter(F.col(roles.cat).isNotNull())
        .groupBy(*by, roles.cat).agg(F.sum("rows").alias("rows"))
        .groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(roles.cat, "rows"))))
                          .alias("energy_distribution"))
    )
    wide = (
        join_on(main, by_cat, by, "left") if by
        else main.withColumn("energy_distribution", by_cat.scalar())
    )
    return wide.select(*by, "record_count", "brand_count", "brands", "energy_distribution", "avg_price",
                       F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
