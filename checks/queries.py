"""One query per operator over the given tables.

Every query reads whole tables and returns a DataFrame; integers come back as 64 bit and compared
doubles rounded, to be comparable with SQL engines that add in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import bindings as b
from salesloom.functions import dates, numbers, text
from salesloom.operators import (
    aggregates, charts, cleaning, clustering, correlation, filters, narrative, profiles, ranking, regression, tenant_clusters, tenants,
)
from salesloom.operators.spread import attach, count_groups, measure_profile
from salesloom.plans import clean as jobs
from salesloom.plans import upload as uploading
from salesloom.roles import SALES
from salesloom.session import scratch_path
from salesloom.sources import batches, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """64-bit integers and doubles only."""
    wide = {"int": "bigint", "smallint": "bigint", "float": "double"}
    return df.select(*[F.col(c).cast(wide[k]).alias(c) if k in wide else F.col(c) for c, k in df.dtypes])


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
    return fn


def rounded(df: DataFrame, digits: int = 4, **columns: int) -> DataFrame:
    """Round double columns for comparison."""
    return df.select(*[
        numbers.rounded(F.col(c), columns.get(c, digits)).alias(c) if k == "double" else F.col(c)
        for c, k in df.dtypes
    ])


KEYS = ["l_orderkey", "l_linenumber"]
ROW = KEYS + SALES.required


# ------------------------------------------------------------------ cleaning steps

@query
def numeric_coercion(spark, d):
    return rounded(cleaning.coerce_measures(b.raw(spark, d)).select(*ROW))


@query
def exact_dedup(spark, d):
    return rounded(cleaning.drop_copies(cleaning.coerce_measures(b.raw(spark, d))))


@query
def dedup_report(spark, d):
    return cleaning.copies_report(cleaning.coerce_measures(b.raw(spark, d)))


@query
def dedup_report_by_model(spark, d):
    return cleaning.copies_report(cleaning.coerce_measures(b.raw(spark, d)), ["model"])


@query
def median_fill(spark, d):
    return rounded(cleaning.fill_median(b.numeric(spark, d), SALES.numeric).select(*ROW))


@query
def median_fill_by_model(spark, d):
    return rounded(cleaning.fill_median(b.numeric(spark, d), SALES.numeric, ["model"]).select(*ROW))


@query
def mode_fill(spark, d):
    return cleaning.fill_mode(b.numeric(spark, d), SALES.text).select(*KEYS, *SALES.text)


@query
def mode_fill_by_model(spark, d):
    rows = b.numeric(spark, d)
    groups = count_groups(b.table(spark, d, "part"), ["p_name"])
    return cleaning.fill_mode(rows, ["brand"], ["model"], groups=groups).select(*KEYS, *SALES.text)


@query
def mode_fill_date_text(spark, d):
    gaps = b.facts(spark, d).withColumn(
        "sale_date", F.when(F.col("l_orderkey") % 83 != 0, F.col("sale_date")))
    return cleaning.fill_mode_date_text(gaps).select(*KEYS, "sale_date")


@query
def zscore_repair(spark, d):
    out = cleaning.repair_zscore(b.numeric(spark, d), SALES.numeric, flag=True)
    return rounded(out.select(*ROW, "sales_volume_outlier", "sales_price_outlier"))


@query
def zscore_repair_events(spark, d):
    rows = b.events(spark, d)
    groups = count_groups(rows, ["event_type"])
    return rounded(cleaning.repair_zscore(rows, ["value"], ["event_type"], flag=True, groups=groups))


@query
def range_repair(spark, d):
    return rounded(cleaning.repair_range(b.numeric(spark, d), "sales_price", 5, 95).select(*ROW))


@query
def category_standard(spark, d):
    rows = b.facts(spark, d).withColumn("spelling", F.col("energy_type"))
    return cleaning.standardise_category(rows).groupBy("spelling", "energy_type").agg(
        F.count(F.lit(1)).alias("rows"))


@query
def date_parse(spark, d):
    rows = b.facts(spark, d).withColumn("text", F.col("sale_date"))
    return cleaning.parse_dates(rows).select(*KEYS, "text", "sale_date")


@query
def invalid_entity_filter(spark, d):
    return rounded(cleaning.drop_invalid(b.numeric(spark, d)).select(*ROW))


@query
def drop_missing(spark, d):
    return rounded(cleaning.drop_missing(b.numeric(spark, d)).select(*ROW))


@query
def missing_counts(spark, d):
    return cleaning.count_missing(b.numeric(spark, d))


@query
def missing_counts_by_model(spark, d):
    return cleaning.count_missing(b.numeric(spark, d), by=["model"])


@query
def custom_fill(spark, d):
    given = {"brand": "自定义", "sales_volume": "7", "sales_price": "not a number"}
    return rounded(cleaning.fill_custom(b.numeric(spark, d), given).select(*ROW))


@query
def default_fill(spark, d):
    return rounded(cleaning.fill_defaults(b.numeric(spark, d)).select(*ROW))


@query
def store_form(spark, d):
    return cleaning.store_form(b.numeric(spark, d), keep=KEYS)


# ------------------------------------------------------------------ cleaning jobs

@query
def auto_clean_rows(spark, d):
    return rounded(jobs.auto_clean(b.raw(spark, d)).rows)


@query
def auto_clean_report(spark, d):
    report = jobs.auto_clean(b.raw(spark, d)).report
    zero = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return report.select(
        "original_rows", "duplicates_removed",
        zero(F.col("missing_filled"), "sales_volume").alias("volume_filled"),
        zero(F.col("missing_filled"), "sales_price").alias("price_filled"),
        zero(F.col("missing_filled"), "brand").alias("brand_filled"),
        zero(F.col("outliers_handled"), "sales_volume").alias("volume_outliers"),
        zero(F.col("outliers_handled"), "sales_price").alias("price_outliers"),
        "invalid_removed", "final_rows",
    )


@query
def auto_clean_totals(spark, d):
    return jobs.report_totals(jobs.auto_clean(b.raw(spark, d)).report)


@query
def auto_clean_warnings(spark, d):
    return jobs.auto_clean(b.raw(spark, d)).report.select(F.array_join("warnings", "|").alias("warnings"))


@query
def auto_clean_rows_by_model(spark, d):
    return rounded(jobs.auto_clean(b.raw(spark, d), by=["model"]).rows)


@query
def auto_clean_totals_by_model(spark, d):
    groups = count_groups(b.table(spark, d, "part"), ["p_name"])
    report = jobs.auto_clean(b.raw(spark, d), by=["model"], groups=groups).report
    return jobs.report_totals(report, ["model"])


INTERACTIVE = {
    "default": {},
    "custom": {"missing_action": "custom", "custom_fill": {"sales_volume": 9},
               "outlier_ranges": {"sales_volume": {"min": 3, "max": 45}}},
    "drop": {"missing_action": "drop"},
}


def _interactive(name: str) -> None:
    config = INTERACTIVE[name]

    def rows(spark, d):
        return rounded(jobs.interactive_clean(b.raw(spark, d), config).rows)

    def totals(spark, d):
        return jobs.report_totals(jobs.interactive_clean(b.raw(spark, d), config).report)

    rows.__name__, totals.__name__ = f"interactive_clean_{name}", f"interactive_totals_{name}"
    query(rows), query(totals)


for _name in INTERACTIVE:
    _interactive(_name)


# ------------------------------------------------------------------ filters and projections

STORED = ["user_id", "upload_id", *SALES.required]


@query
def tenant_rows(spark, d):
    return filters.rows_of_tenant(b.vehicles(spark, d).select(*STORED), 7)


@query
def category_filter(spark, d):
    return filters.filter_category(b.vehicles(spark, d).select(*STORED), "电车")


@query
def item_filter(spark, d):
    wanted = ["Brand#1 small ring", "Brand#2 red widget", "Brand#3 blue bolt"]
    return filters.filter_items(b.vehicles(spark, d).select(*STORED), wanted)


@query
def item_filter_by_table(spark, d):
    chosen = b.table(spark, d, "part").filter("p_size >= 45").select(
        F.col("p_brand").alias("brand"), F.col("p_name").alias("model"))
    return filters.filter_items_by_table(b.vehicles(spark, d).select(*STORED), chosen, ["brand", "model"])


@query
def valid_rows(spark, d):
    return rounded(filters.valid_rows(b.numeric(spark, d)).select(*ROW))


@query
def resolve_user(spark, d):
    return filters.resolve_user(b.users(spark, d), 12).select("user_id", "username")


@query
def resolve_user_by_name(spark, d):
    return filters.resolve_user(b.users(spark, d), "Customer#000000033").select("user_id", "username")


@query
def owned_upload(spark, d):
    uploads = b.uploads(spark, d)
    owner = uploads.filter("upload_id = 1").select("user_id").first()[0]
    return filters.owned_upload(uploads, owner, 1)


@query
def sales_chart(spark, d):
    return filters.sales_chart(b.vehicles(spark, d))


@query
def computed_revenue(spark, d):
    return rounded(b.vehicles(spark, d).select("upload_id", "brand", "model", filters.revenue().alias("revenue")))


@query
def detail_columns(spark, d):
    return filters.detail_columns(b.vehicles(spark, d), keep=["upload_id"])


@query
def scatter(spark, d):
    return rounded(filters.scatter(b.numeric(spark, d), keep=["l_orderkey"]))


@query
def scatter_rounded(spark, d):
    return filters.scatter_rounded(b.vehicles(spark, d), keep=["user_id"])


@query
def records_view(spark, d):
    rows = jobs.auto_clean(b.raw(spark, d)).rows
    return filters.records(rows).select("l_orderkey", "brand", "model", "sale_date", "energy_type")


# ------------------------------------------------------------------ joins

@query
def active_uploads(spark, d):
    return tenants.active_uploads(b.users(spark, d), b.uploads(spark, d))


@query
def all_uploads(spark, d):
    return tenants.all_uploads(b.uploads(spark, d), b.users(spark, d))


@query
def upload_list(spark, d):
    archive = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"))
    return tenants.upload_list(b.uploads(spark, d), archive, b.users(spark, d))


@query
def user_totals(spark, d):
    return tenants.user_totals(b.users(spark, d), b.vehicles(spark, d), b.uploads(spark, d))


@query
def user_statistics(spark, d):
    return tenants.user_statistics(b.users(spark, d), b.vehicles(spark, d), b.uploads(spark, d))


@query
def current_rows(spark, d):
    return tenants.current_rows(b.archive(spark, d).drop("sale_date"), b.users(spark, d))


def _active_requests(spark, d):
    return b.users(spark, d).filter("active_upload_id is not null").select(
        F.col("active_upload_id").alias("upload_id"), "user_id")


@query
def ownership_semi_join(spark, d):
    return tenants.owned(_active_requests(spark, d), b.uploads(spark, d))


@query
def delete_anti_join(spark, d):
    return tenants.without(b.uploads(spark, d), _active_requests(spark, d))


@query
def statistic_broadcast_back(spark, d):
    rows = b.vehicles(spark, d).select("upload_id", "brand", "sales_price")
    stats = measure_profile(rows, ["sales_price"], ["brand"])
    wide = attach(rows, stats, ["brand"], "s", "rows")
    return rounded(wide.select(
        "upload_id", "brand", (F.col("sales_price") - F.col("s.sales_price_avg")).alias("off_mean"),
        (F.col("sales_price") - F.col("s.sales_price_median")).alias("off_median")))


# ------------------------------------------------------------------ aggregates

@query
def overview(spark, d):
    return aggregates.overview(b.vehicles(spark, d))


@query
def overview_by_user(spark, d):
    return aggregates.overview(b.vehicles(spark, d), by=["user_id"])


@query
def volume_by_brand(spark, d):
    return aggregates.volume_by_dim(b.vehicles(spark, d))


@query
def volume_by_brand_by_user(spark, d):
    return aggregates.volume_by_dim(b.vehicles(spark, d), by=["user_id"])


@query
def row_and_brand_counts(spark, d):
    return aggregates.counts(b.vehicles(spark, d))


@query
def average_price(spark, d):
    return aggregates.average_price(b.vehicles(spark, d), by=["user_id"])


@query
def volume_shares(spark, d):
    return aggregates.volume_shares(b.vehicles(spark, d))


@query
def volume_shares_by_user(spark, d):
    return aggregates.volume_shares(b.vehicles(spark, d), by=["user_id"])


@query
def rows_by_category(spark, d):
    return aggregates.rows_by_category(b.vehicles(spark, d))


@query
def price_histogram(spark, d):
    return aggregates.price_histogram(b.vehicles(spark, d))


@query
def price_histogram_by_user(spark, d):
    return aggregates.price_histogram(b.vehicles(spark, d), by=["user_id"])


@query
def price_segments(spark, d):
    return aggregates.price_segments(b.vehicles(spark, d))


@query
def price_segments_wide(spark, d):
    """Prices far beyond the last bound stay in the last segment."""
    return aggregates.price_segments(b.vehicles(spark, d).withColumn("sales_price", F.col("sales_price") * 32))


@query
def overview_with_gaps(spark, d):
    """Missing volumes never win, and tenants without any have none."""
    rows = b.vehicles(spark, d).withColumn("sales_volume", F.expr("CASE WHEN upload_id % 4 <> 0 THEN sales_volume END"))
    return aggregates.overview(rows, by=["user_id"]).select(
        "user_id", "top_volume_name", "top_volume", "top_revenue_name", "top_revenue")


@query
def segment_bars(spark, d):
    segments = aggregates.price_segments(b.vehicles(spark, d)).select("bin", "label", "avg_sales")
    return ranking.share_of_largest(segments, "avg_sales")


@query
def brand_measures(spark, d):
    return rounded(aggregates.dim_measures(b.vehicles(spark, d)))


@query
def brand_category_pivot(spark, d):
    return aggregates.pivot_by_category(b.vehicles(spark, d))


@query
def chart_info(spark, d):
    rows = charts.chosen_rows(b.vehicles(spark, d), charts.ChartSpec())
    return charts.chart_info(rows).drop("error")


@query
def brand_share(spark, d):
    return aggregates.dim_share(b.vehicles(spark, d))


@query
def histogram_share(spark, d):
    return aggregates.histogram_share(b.vehicles(spark, d))


@query
def collapse_small_slices(spark, d):
    sums = b.vehicles(spark, d).groupBy("model").agg(F.sum("sales_volume").alias("v"))
    return charts.collapse_small(sums, "model", "v")


@query
def measure_ranges(spark, d):
    return aggregates.ranges(b.vehicles(spark, d), by=["energy_type"])


@query
def summary_snapshot(spark, d):
    table = aggregates.summary_snapshot(b.vehicles(spark, d))
    n = lambda k: F.coalesce(F.try_element_at("energy_distribution", F.lit(k)), F.lit(0)).cast("string")
    return table.select(
        "user_id", "record_count", "brand_count", F.array_join("brands", ",").alias("brands"),
        F.concat_ws("/", n("油车"), n("混动"), n("电车")).alias("energy_distribution"), "avg_price")


# ------------------------------------------------------------------ ranking

@query
def top_rows_per_user(spark, d):
    return ranking.top_rows_per_tenant(b.vehicles(spark, d), 10)


@query
def top_rows_per_upload(spark, d):
    return ranking.top_rows_per_upload(b.archive(spark, d), b.uploads(spark, d), b.users(spark, d), 3)


@query
def top_rows_volume(spark, d):
    return ranking.top_rows(b.vehicles(spark, d).select(*SALES.required))


@query
def top_rows_price_ascending(spark, d):
    return ranking.top_rows(b.vehicles(spark, d).select(*SALES.required), "sales_price", "asc", 20)


@query
def largest_rows(spark, d):
    return ranking.largest_rows(b.vehicles(spark, d))


@query
def largest_rows_by_user(spark, d):
    return ranking.largest_rows(b.vehicles(spark, d), 3, by=["user_id"])


@query
def chart_info_by_user(spark, d):
    rows = charts.chosen_rows(b.vehicles(spark, d), charts.ChartSpec(), by=["user_id"])
    return charts.chart_info(rows, by=["user_id"]).drop("error")


@query
def radar_brands_by_user(spark, d):
    scaled = charts.radar(b.vehicles(spark, d), by=["user_id"])
    return rounded(scaled.select("user_id", "brand", "label", "total_sales", "enough", "total_sales_scaled"))


@query
def top_brands(spark, d):
    return ranking.top_dims(b.vehicles(spark, d))


@query
def top_brands_by_user(spark, d):
    return ranking.top_dims(b.vehicles(spark, d), by=["user_id"])


@query
def radar_brands(spark, d):
    return rounded(charts.radar(b.vehicles(spark, d)).drop("label"))


@query
def stack_offsets(spark, d):
    return ranking.stack_offsets(b.vehicles(spark, d))


@query
def average_ranks(spark, d):
    """Distinct (price, volume) pairs with the average rank of both values."""
    return correlation.average_ranks(b.vehicles(spark, d)).select(
        "x", "y", F.col("c").alias("copies"), F.col("rx").alias("rank_x"), F.col("ry").alias("rank_y"))


@query
def contiguous_folds(spark, d):
    return regression.fold_sizes(b.vehicles(spark, d))


@query
def contiguous_folds_by_user(spark, d):
    return regression.fold_sizes(b.vehicles(spark, d), by=["user_id"])


@query
def sorted_rows(spark, d):
    cols = b.vehicles(spark, d).select("brand", "model", "sales_volume", "sales_price")
    return ranking.sort_by_volume(cols)


@query
def newest_uploads(spark, d):
    return ranking.optional_limit(ranking.newest_first(b.uploads(spark, d)), 25)


# ------------------------------------------------------------------ statistics

@query
def linear_fit(spark, d):
    return rounded(correlation.linear_fit(b.vehicles(spark, d)), 6)


@query
def linear_fit_by_brand(spark, d):
    return rounded(correlation.linear_fit(b.vehicles(spark, d), by=["brand"]), 6)


@query
def spearman(spark, d):
    return rounded(correlation.spearman(b.vehicles(spark, d)), 6)


@query
def spearman_by_brand(spark, d):
    return rounded(correlation.spearman(b.vehicles(spark, d), by=["brand"]), 6)


@query
def correlation_overall(spark, d):
    return correlation.overall(b.vehicles(spark, d))


@query
def correlation_wording(spark, d):
    fit = correlation.linear_fit(b.vehicles(spark, d), by=["user_id"]).filter("n >= 5")
    return fit.select("user_id", F.col("n").alias("data_points"), numbers.rounded("r", 4).alias("pearson_r"),
                      text.strength_word(F.col("r")).alias("interpretation"))


@query
def stratified_correlation(spark, d):
    table = correlation.by_category(b.vehicles(spark, d), by=["user_id"])
    return table.drop("p", "significant")


@query
def stratified_significance(spark, d):
    return correlation.by_category(b.vehicles(spark, d))


@query
def correlation_overall_by_brand(spark, d):
    return correlation.overall(b.vehicles(spark, d), by=["brand"])


@query
def stratified_p_by_user(spark, d):
    """p-values of small strata."""
    return correlation.by_category(b.vehicles(spark, d), by=["user_id"]).select("user_id", "energy_type", "n", "p", "significant")


@query
def counterexamples(spark, d):
    return rounded(correlation.counterexamples(b.vehicles(spark, d)).drop("reason"))


@query
def counterexamples_by_brand(spark, d):
    return rounded(correlation.counterexamples(b.vehicles(spark, d), by=["brand"]).drop("reason"))


@query
def regression_features(spark, d):
    return regression.features(b.vehicles(spark, d))


@query
def feature_scaling(spark, d):
    return rounded(regression.scaling(regression.features(b.vehicles(spark, d))), 6)


@query
def regression_fit(spark, d):
    return rounded(regression.fit(b.vehicles(spark, d)))


@query
def regression_fit_by_brand(spark, d):
    table = regression.fit(b.vehicles(spark, d), by=["brand"])
    return rounded(table.drop("raw_intercept", *[f"raw_{c}" for c in regression.FEATURES]))


@query
def regression_metrics(spark, d):
    model = regression.train(b.vehicles(spark, d), cross_validate=False)
    return regression.metrics(model).select("r2", "rmse", "mae", "data_points", "mode")


@query
def cross_validation(spark, d):
    return rounded(regression.cross_validation(b.vehicles(spark, d)))


@query
def model_info(spark, d):
    """Models of all users, kept on disk and read again, with users that have none."""
    rows = b.vehicles(spark, d)
    path = scratch_path(spark, "models")
    regression.save_model(regression.train(rows, by=["user_id"]), path)
    return regression.model_info(regression.load_model(spark, path), ["user_id"], b.users(spark, d).select("user_id"))


@query
def prediction(spark, d):
    rows = b.vehicles(spark, d)
    model = regression.train(rows, cross_validate=False)
    kind = None
    for name, spelling in b.RAW_SPELLING.items():
        hit = F.col("p_type") == name
        kind = F.when(hit, spelling) if kind is None else kind.when(hit, spelling)
    scenarios = b.table(spark, d, "part").select(
        "p_partkey", (F.col("p_retailprice") / 50).alias("price"), kind.alias("energy_type"),
        (F.col("p_size") % 13).alias("month"))
    return regression.predict(scenarios, model).select(
        "p_partkey", "monthly_sales", "annual_sales", "annual_method", "interval_low", "interval_high")


@query
def seasonal_annualisation(spark, d):
    monthly = b.vehicles(spark, d).groupBy(F.month("sale_date").alias("month")).agg(
        F.sum("sales_volume").alias("volume"))
    annual, method, factor = regression.annualise(F.col("volume"), F.col("month"))
    return monthly.select("month", "volume", annual.alias("annual_sales"), method.alias("annual_method"),
                          factor.alias("factor"))


GIVEN = clustering.Centroids([(20.0, 12.0), (55.0, 40.0), (85.0, 25.0)], (0.0, 0.0), (29.0, 14.0), 0.0, 0)


def _assigned(spark, d):
    return clustering.assign(b.vehicles(spark, d), GIVEN)


@query
def nearest_centroid(spark, d):
    return _assigned(spark, d).select("upload_id", "brand", "model", "sales_price", "sales_volume", "cluster")


@query
def cluster_profile(spark, d):
    return clustering.profile(_assigned(spark, d)).withColumn("brands", F.array_join("brands", ","))


@query
def cluster_categories(spark, d):
    return clustering.category_counts(_assigned(spark, d))


@query
def cluster_extremes(spark, d):
    return rounded(clustering.farthest(_assigned(spark, d), groups=len(GIVEN.centres)))


@query
def kmeans_segments(spark, d):
    return clustering.segment(b.vehicles(spark, d), 3).clusters.drop("brands")


@query
def kmeans_summary(spark, d):
    return clustering.segment(b.vehicles(spark, d), 3).summary


def _gappy(spark, d):
    """Archived rows of which a fourth of the batches has no volumes."""
    return b.vehicles(spark, d).withColumn("sales_volume", F.expr("CASE WHEN upload_id % 4 <> 0 THEN sales_volume END"))


@query
def kmeans_by_user(spark, d):
    """K-means of every user at once, and what must hold of it: every row at its nearest centre, centres that are the means
    of their rows, the stated inertia."""
    rows, by = _gappy(spark, d), ["user_id"]
    model = tenant_clusters.fit(rows, by, 3)
    assigned = tenant_clusters.assign(rows, model, by).select("user_id", "x", "y", "cluster")
    facts = model.filter("centres IS NOT NULL").select(F.col("user_id").alias("u"), "centres", "sx", "sy")
    near = assigned.join(facts, F.col("user_id") == F.col("u")).drop("u")
    gaps = F.transform("centres", lambda c: numbers.euclid((F.col("x") - c["price"]) / F.col("sx"), (F.col("y") - c["sales"]) / F.col("sy")))
    own = near.withColumn("gap", F.get(gaps, "cluster")).withColumn("least", F.array_min(gaps))
    per = own.groupBy("user_id", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > F.col("least") + 1e-9).alias("misplaced"), F.sum(F.col("gap") * F.col("gap")).alias("cost"),
        F.abs(F.avg((F.col("x") - F.get("centres", "cluster")["price"]) / F.col("sx"))).alias("dx"),
        F.abs(F.avg((F.col("y") - F.get("centres", "cluster")["sales"]) / F.col("sy"))).alias("dy"))
    held = per.groupBy(F.col("user_id").alias("u")).agg(
        F.sum("n").alias("assigned"), F.sum("misplaced").alias("misplaced"), F.sum("cost").alias("cost"),
        F.count_if(F.greatest("dx", "dy") > 1e-3).alias("off_centre"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return model.join(held, F.col("user_id") == F.col("u"), "left").select(
        "user_id", "rows", "valid_rows", "status", F.coalesce(F.size("centres"), F.lit(0)).alias("clusters"), zero("assigned"), zero("misplaced"),
        zero("off_centre"), F.coalesce(F.abs(F.col("cost") - F.col("inertia")) > 1e-6, F.lit(False)).alias("cost_differs"))


@query
def kmeans_summary_by_user(spark, d):
    return tenant_clusters.segment(_gappy(spark, d), ["user_id"], 3).summary.drop("inertia", "rounds")


# ------------------------------------------------------------------ charts and report

@query
def chart_bar(spark, d):
    return charts.chart_rows(b.vehicles(spark, d), charts.ChartSpec())


@query
def chart_filtered_line(spark, d):
    spec = charts.ChartSpec("line", top_n=12, sort_by="sales_price", energy_filter="混动")
    return charts.chart_rows(b.vehicles(spark, d), spec)


@query
def chart_pie(spark, d):
    return charts.chart_rows(b.vehicles(spark, d), charts.ChartSpec("pie", top_n=60))


@query
def chart_scatter(spark, d):
    return rounded(charts.chart_rows(b.vehicles(spark, d), charts.ChartSpec("scatter")))


@query
def chart_horizontal_bar(spark, d):
    return charts.chart_rows(b.vehicles(spark, d), charts.ChartSpec("horizontal_bar"))


@query
def chart_stacked_bar(spark, d):
    return charts.chart_rows(b.vehicles(spark, d), charts.ChartSpec("stacked_bar", top_n=0))


@query
def report_leaders_json(spark, d):
    return narrative.brand_sales_json(b.vehicles(spark, d))


@query
def narrative_report(spark, d):
    everyone = b.users(spark, d).select("user_id")
    return narrative.report(b.vehicles(spark, d), tenants=everyone)


# ------------------------------------------------------------------ batches on files

def _stored(spark, d) -> batches.BatchStore:
    """A store holding all given batches."""
    store = batches.BatchStore(scratch_path(spark, "store"))
    batches.archive_rows(store, b.archive(spark, d), "all")
    heads = b.uploads(spark, d).drop("record_count").withColumn("created_at", F.col("created_at").cast("timestamp"))
    batches.log_uploads(store, spark, heads, "all")
    return store


@query
def batch_read_back(spark, d):
    return batches.archive(spark, _stored(spark, d)).drop("run")


@query
def batch_log(spark, d):
    return batches.uploads(spark, _stored(spark, d)).select("upload_id", "user_id", "filename", "record_count")


@query
def batch_current(spark, d):
    store = _stored(spark, d)
    batches.activate(spark, store, _active_requests(spark, d))
    return batches.current(spark, store)


@query
def batch_after_delete(spark, d):
    store = _stored(spark, d)
    batches.delete_uploads(spark, store, _active_requests(spark, d))
    return batches.archive(spark, store).groupBy("upload_id").agg(F.count(F.lit(1)).alias("rows"))


@query
def replace_current_rows(spark, d):
    path = scratch_path(spark, "current")
    rows = b.vehicles(spark, d).withColumn("slot", F.col("user_id") % 8)
    batches.replace_current(rows, path, "slot")
    one = rows.filter("slot = 3").withColumn("sales_volume", F.col("sales_volume") * 2)
    batches.replace_current(one, path, "slot")
    return spark.read.parquet(path)


SCAN = ["brand", "model", "sales_volume", "energy_type", "sale_date"]
CHINESE = {"brand": "品牌", "model": "车型", "sales_volume": "销量", "sales_price": "价格", "energy_type": "能源类型",
           "sale_date": "销售日期"}


def _scan(df: DataFrame) -> DataFrame:
    return df.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("int"), *SCAN,
                     F.col("sales_price").cast("double"))


def _owned(spark, d, times: int = 1) -> DataFrame:
    """All clean rows with a multiple of their volume, of five owners."""
    rows = b.facts(spark, d).withColumn("user_id", F.col("l_orderkey") % 5)
    return rows.withColumn("sales_volume", F.col("sales_volume") * times)


def _five_owners(spark, d, times: int = 1) -> DataFrame:
    """All clean rows with a multiple of their volume, one file per owner."""
    return _owned(spark, d, times).repartition(5, "user_id")


@query
def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    batches.export_clean(b.raw(spark, d), path, "csv")
    return _scan(files.load_table(spark, f"{path}/*.csv"))


@query
def csv_scan_mixed_encodings(spark, d):
    """One folder with UTF-8 files and GB18030 files whose columns have other names and places."""
    path = scratch_path(spark, "csv")
    rows = b.raw(spark, d)
    first = F.col("l_orderkey") % 2 == 0
    keep = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.filter(first).write.options(**keep).csv(f"{path}/part=utf8")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    other = rows.filter(~first).withColumnsRenamed(CHINESE)
    other = other.select(*reversed(other.columns))
    other.write.options(**keep, encoding="GB18030").csv(f"{path}/part=gb")
    return _scan(files.read_csv(spark, f"{path}/*/*.csv"))


def _csv_lines(rows: DataFrame, before: str = "") -> DataFrame:
    """The rows as lines of CSV in ``value``; ``before`` and the header stand ahead of the first line of every task.

    Written as text, each task's lines are a file, and no file has to fit in memory.
    """
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.to_csv(F.struct(*[F.col(c) for c in rows.columns]), keep)
    return rows.select(F.when(first, F.concat(F.lit(f"{before}{','.join(rows.columns)}\n"), line)).otherwise(line).alias("value"))


@query
def csv_scan_blank_first_lines(spark, d):
    """Files that begin with blank lines, as lines of text; none of their rows is lost."""
    path = scratch_path(spark, "csv")
    _csv_lines(b.raw(spark, d), "\n \n").write.option("lineSep", "\n").text(path)
    return _scan(files.load_table(spark, f"{path}/*.txt", "csv"))


@query
def json_scan(spark, d):
    path = scratch_path(spark, "json")
    b.raw(spark, d).write.json(path)
    return _scan(files.load_table(spark, f"{path}/*.json"))


@query
def upload_job(spark, d):
    """Files of five owners, uploaded, cleaned, archived and put in effect."""
    path = scratch_path(spark, "incoming")
    rows = b.raw(spark, d).withColumn("user_id", F.col("l_orderkey") % 5)
    rows.write.partitionBy("user_id").option("header", True).csv(path)
    store = batches.BatchStore(scratch_path(spark, "store"))
    uploading.upload(spark, f"{path}/*/*.csv", store, "first", "csv")
    return aggregates.overview(batches.current(spark, store), by=["user_id"])


def _written(rows: DataFrame, line, path: str, header=None) -> None:
    """The rows as lines of text, one file per owner; ``header`` is its first line.  No other copy of the rows is written."""
    lines = rows.select("user_id", F.lit(1).alias("_at"), line.alias("value"))
    if header is not None:
        lines = rows.select("user_id").distinct().select("user_id", F.lit(0).alias("_at"), header.alias("value")).unionByName(lines)
    ordered = lines.repartition(5, "user_id").sortWithinPartitions("user_id", "_at").select("value", "user_id")
    # the text source names its files .txt; a folder of their own says what is in them
    ordered.write.partitionBy("user_id").option("lineSep", "\n").text(path)


@query
def upload_quarantine(spark, d):
    """Files with surplus cells, broken JSON lines, a header of empty cells and nothing at all, uploaded beside good rows."""
    path = scratch_path(spark, "incoming")
    rows = _owned(spark, d)
    cells = [c for c in rows.columns if c != "user_id"]
    plain, header = F.to_csv(F.struct(*cells)), F.lit(",".join(cells))
    changed = lambda text: F.regexp_replace(text, r"(?m)^(\d*7,.*)$", "$1,surplus")
    beside, blank = lambda text: F.concat(F.lit(",,,,\n"), text), F.lit("\n \n")
    _written(rows, changed(plain), f"{path}/csv/csv", changed(header))
    first = rows.filter("user_id = 0")
    _written(first, beside(plain), f"{path}/csv/user_id=20/cells", beside(header))
    _written(first, blank, f"{path}/csv/user_id=21/blank", blank)
    objects = F.regexp_replace(F.to_json(F.struct(*cells)), r'(?m)^(\{"l_orderkey":\d*3,.*)\}$', "$1")
    _written(rows.withColumn("user_id", F.col("user_id") + 10), objects, f"{path}/json/json")
    store = batches.BatchStore(scratch_path(spark, "store"))
    csv = uploading.upload(spark, f"{path}/csv", store, "first", "csv")
    json = uploading.upload(spark, f"{path}/json", store, "second", "json")
    owner = F.regexp_extract("file", r"user_id=(\d+)", 1).cast("long").alias("user_id")
    reason = F.when(F.col("message").startswith("数据缺少必需列"), "columns").otherwise(F.col("message")).alias("message")
    files = csv.files.unionByName(json.files).select(owner, "status", "stored_rows", "rejected_rows", reason)
    keys = F.sum(F.regexp_extract("text", r"(\d+)", 1).cast("long")).alias("reject_keys")
    rejects = csv.rejects.unionByName(json.rejects).withColumn("user_id", owner).groupBy("user_id", "reason").agg(keys, F.count("place").alias("placed"))
    volume = batches.current(spark, store).groupBy("user_id").agg(F.sum("sales_volume").alias("volume"))
    return files.join(rejects, "user_id", "left").join(volume, "user_id", "left")


@query
def reupload_and_delete(spark, d):
    """One path uploaded three times with other volumes, the second upload deleted in between."""
    path = scratch_path(spark, "incoming")
    store = batches.BatchStore(scratch_path(spark, "store"))
    for run, times in (("first", 1), ("second", 2), ("third", 3)):
        _five_owners(spark, d, times).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "user_id").option("header", True).csv(path)
        uploading.upload(spark, f"{path}/*/*.csv", store, run, "csv")
        if run == "second":
            done = batches.active(spark, store).select("user_id", F.col("active_upload_id").alias("upload_id"))
            batches.delete_uploads(spark, store, done)
    log = batches.uploads(spark, store).groupBy("user_id").agg(F.count("*").alias("batches"), F.sum("record_count").alias("archived"))
    now = batches.current(spark, store).groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("sales_volume").alias("volume"))
    return now.join(log, "user_id")


@query
def streaming_mixed_files(spark, d):
    """Files with two header orders and two encodings, taken up by the file stream."""
    from salesloom.streaming.ingest import start_ingest

    path = scratch_path(spark, "incoming")
    rows = _five_owners(spark, d)
    keep = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.filter("user_id < 3").write.partitionBy("user_id").options(**keep).csv(f"{path}/utf8")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    other = rows.filter("user_id >= 3").withColumnsRenamed(CHINESE)
    other.select(*reversed(other.columns)).write.partitionBy("user_id").options(**keep, encoding="GB18030").csv(f"{path}/gb")
    store = batches.BatchStore(scratch_path(spark, "store"))
    start_ingest(spark, path, store, scratch_path(spark, "progress")).awaitTermination()
    return batches.current(spark, store).groupBy("user_id").agg(
        F.count("*").alias("rows"), F.countDistinct("brand").alias("brands"), F.countDistinct("model").alias("models"),
        F.countDistinct("energy_type").alias("energy_types"))


@query
def streaming_upload(spark, d):
    """The same files taken up by the file stream."""
    from salesloom.streaming.ingest import start_ingest

    path = scratch_path(spark, "incoming")
    rows = b.raw(spark, d).withColumn("user_id", F.col("l_orderkey") % 5)
    rows.write.partitionBy("user_id").option("header", True).csv(path)
    store = batches.BatchStore(scratch_path(spark, "store"))
    start_ingest(spark, path, store, scratch_path(spark, "progress")).awaitTermination()
    return tenants.upload_list(
        batches.uploads(spark, store), batches.archive(spark, store),
        batches.users_with_active(spark, store, b.users(spark, d)),
    ).select("user_id", "record_count", "archived_count", "is_active")


@query
def summary_kept_up(spark, d):
    """Summaries and overviews after five micro-batches of files and a deletion, from what the micro-batches left."""
    from salesloom.streaming.ingest import start_ingest

    path, progress = scratch_path(spark, "incoming"), scratch_path(spark, "progress")
    store = batches.BatchStore(scratch_path(spark, "store"))
    for folder, times, users in (("one", 1, 5), ("two", 2, 3)):
        rows = _five_owners(spark, d, times).filter(F.col("user_id") < users)
        rows.write.partitionBy("user_id").option("header", True).csv(f"{path}/{folder}")
        start_ingest(spark, path, store, progress, max_files=2).awaitTermination()
    first = batches.active(spark, store).filter("user_id = 0").withColumnRenamed("active_upload_id", "upload_id")
    batches.delete_uploads(spark, store, first)
    totals = profiles.overview(batches.current_profiles(spark, store), ["user_id"])
    summary = batches.summary(spark, store).select("user_id", "record_count", "brand_count", F.array_join("brands", ",").alias("brands"), "avg_price")
    return summary.join(totals.select("user_id", "total_rows", "top_volume", "top_volume_name", "top_item_by_rows", "top_dim_by_rows"), "user_id")


@query
def flagship_brand_ranking(spark, d):
    """Dirty rows to a ranking: scan, join, dedup, medians, outliers, categories, top seven."""
    clean = jobs.auto_clean(b.raw(spark, d)).rows
    sums = clean.groupBy("brand").agg(
        F.sum("sales_volume").alias("total_sales"), F.avg("sales_price").alias("avg_price"),
        F.count(F.lit(1)).alias("rows"))
    top = sums.orderBy(F.desc("total_sales"), "brand").limit(7)
    from pyspark.sql import Window
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_sales"), "brand")))
    return rounded(ranked, 2)
