"""Chart-ready datasets.  Drawing is left to whatever consumes them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import numbers, text
from salesloom.operators import aggregates, filters, ranking
from salesloom.operators.spread import attach
from salesloom.roles import SALES, Roles

# --- fixed values: what a chart request may ask for, and its defaults
CHART_TYPES = ["bar", "line", "bar_line", "pie", "scatter", "horizontal_bar", "stacked_bar", "radar"]
SORT_FIELDS = ["sales_volume", "sales_price", "brand"]
CATEGORY_FILTERS = ["all", "油车", "电车", "混动"]


@dataclass(frozen=True)
class ChartSpec:
    """One chart request."""

    chart_type: str = "bar"
    top_n: int = 15
    sort_by: str = "sales_volume"
    sort_order: str = "desc"
    energy_filter: str = "all"
    title: str = "汽车销售统计图"
    show_value: bool = True
    grid_on: bool = True

    def __post_init__(self):
        for value, allowed, what in (
            (self.chart_type, CHART_TYPES, "chart type"),
            (self.sort_by, SORT_FIELDS, "sort field"),
            (self.sort_order, ["asc", "desc"], "sort order"),
        ):
            if value not in allowed:
                raise ValueError(f"unknown {what}: {value}")


def chart_config() -> dict:
    """What can be asked for, and the defaults."""
    return {
        "chart_types": list(CHART_TYPES), "sort_fields": list(SORT_FIELDS),
        "energy_filters": list(CATEGORY_FILTERS), "default_params": dict(ChartSpec().__dict__),
    }


def _labelled(rows: DataFrame, roles: Roles) -> DataFrame:
    return rows.withColumn("label", text.compact_label(F.col(roles.dim), F.col(roles.item)))


def collapse_small(rows: DataFrame, label: str, value: str, share: float = fixed.SMALL_SLICE,
                   by: Sequence[str] = ()) -> DataFrame:
    """Slices of a pie: items below ``share`` of the total go into one common slice.

    The remaining items keep a slice each, even where two carry the same label.
    """
    by = list(by)
    totals = rows.groupBy(*by).agg(F.sum(value).alias("all"), F.count(F.lit(1)).alias("n"))
    wide = attach(rows, totals, by, "_t", "n")
    big = F.col(value) >= F.col("_t.all") * share
    main = wide.filter(big).select(*by, F.col(label).alias("slice"), F.col(value).cast("bigint").alias("size"),
                                   F.lit(False).alias("is_other"))
    rest = (
        wide.filter(~big).groupBy(*by).agg(F.sum(F.col(value).cast("bigint")).alias("size"))
        .filter(F.col("size") > 0)
        .select(*by, F.lit(fixed.OTHER_SLICE).alias("slice"), "size", F.lit(True).alias("is_other"))
    )
    return main.unionByName(rest)


def bubble_sizes(rows: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Marker size from the price relative to the highest price shown."""
    top = rows.groupBy(*by).agg(F.max(roles.price).alias("top"), F.count(F.lit(1)).alias("n"))
    wide = attach(rows, top, by, "_t", "n")
    size = F.coalesce(F.try_divide(F.col(roles.price), F.col("_t.top")), F.lit(0.0)) * 400 + 50
    return wide.withColumn("bubble", size).drop("_t")


def chosen_rows(df: DataFrame, spec: ChartSpec, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Filter, sort and cut as the chart request says, for the table or every group."""
    sort_col = {"sales_volume": roles.qty, "sales_price": roles.price, "brand": roles.dim}[spec.sort_by]
    rows = filters.filter_category(df.select(*by, *roles.required), spec.energy_filter, roles)
    return ranking.top_rows(rows, sort_col, spec.sort_order, spec.top_n, roles, by)


def chart_info(rows: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Row count, total volume and mean price of the rows shown; an error text if there are none."""
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("data_count"),
                    F.coalesce(F.sum(roles.qty), F.lit(0)).cast("bigint").alias("total_sales"),
                    numbers.rounded(F.avg(roles.price), 2).alias("avg_price"))
    none = F.col("data_count") == 0
    return sums.select(*by, (~none).alias("success"), F.when(none, fixed.MSG_NO_CHART_ROWS).alias("error"),
                       "data_count", "total_sales", "avg_price")


def chart_rows(df: DataFrame, spec: ChartSpec, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Dataset of one chart, or of the chart of every group."""
    rows = chosen_rows(df, spec, roles, by)
    kind = spec.chart_type
    if kind == "pie":
        return collapse_small(_labelled(rows, roles), "label", roles.qty, by=by)
    if kind == "scatter":
        return bubble_sizes(_labelled(rows, roles), roles, by)
    if kind == "horizontal_bar":
        return ranking.top_rows(_labelled(rows, roles), roles.qty, "asc", 0, roles, by)
    if kind == "stacked_bar":
        return ranking.stack_offsets(rows, roles, by).withColumn("label", F.substring(roles.dim, 1, 6))
    if kind == "radar":
        return radar(rows, roles, by=by)
    return _labelled(rows, roles)


def radar(rows: DataFrame, roles: Roles = SALES, n: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """Scaled measures of the largest entity groups."""
    top = ranking.radar_dims(rows, n, roles, by)
    measures = ["total_sales", "avg_price", "item_rows", "value_index"]
    return ranking.scale_groups(top, measures, by=by).withColumn("label", F.substring(roles.dim, 1, 8))


class Dashboard(NamedTuple):
    records: DataFrame
    brand_sales: DataFrame
    energy_ratio: DataFrame
    price_bins: DataFrame
    sales_scatter: DataFrame
    top_models: DataFrame


def dashboard(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> Dashboard:
    """All datasets of the dashboard."""
    return Dashboard(
        filters.records(df),
        aggregates.volume_by_dim(df, roles, by),
        aggregates.rows_by_category(df, roles, by),
        aggregates.price_histogram(df, roles, by),
        filters.scatter(df, roles, by),
        ranking.largest_rows(df, 10, roles, by),
    )
