"""Market segments: K-means on scaled price and volume."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import numbers, text
from salesloom.operators.aggregates import ranges
from salesloom.operators.filters import valid_rows
from salesloom.operators.spread import attach, top_per_group, unpack
from salesloom.roles import SALES, Roles


def points(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    """Rows with both measures present, with them as ``x`` (price) and ``y`` (volume)."""
    return df.withColumns({
        "x": numbers.measure(F.col(roles.price)), "y": numbers.measure(F.col(roles.qty)),
    }).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def scaling(df: DataFrame) -> DataFrame:
    """Mean and population deviation of both measures; a constant measure scales by one."""
    dev = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                  dev("x").alias("sx"), dev("y").alias("sy"))


class Centroids(NamedTuple):
    """``k`` centres in raw units and the scaling they were found under; a handful of numbers."""

    centres: list[tuple[float, float]]
    mean: tuple[float, float]
    std: tuple[float, float]
    inertia: float
    valid_rows: int


class TooFewRows(ValueError):
    pass


def fit(df: DataFrame, k: int = 3, roles: Roles = SALES, seed: int = 42) -> Centroids:
    """Fit ``k`` centres on scaled price and volume.

    Needs at least ``k`` valid rows.  The fit runs over distinct (price, volume) pairs weighted by
    their count: the same optimum from far fewer rows, and a pair shared by a third of all rows
    is one row.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    enough = valid_rows(df, roles).count()
    if enough < k:
        raise TooFewRows(fixed.MSG_TOO_FEW % (k, enough))
    rows = points(df, roles)
    scale = scaling(rows).first()
    pairs = rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    vectors = pairs.select(
        array_to_vector(F.array((F.col("x") - scale["mx"]) / scale["sx"],
                                (F.col("y") - scale["my"]) / scale["sy"])).alias("features"), "w",
    ).persist()
    try:
        model = KMeans(k=k, seed=seed, weightCol="w", maxIter=300, tol=1e-4).fit(vectors)
        centres = [(float(c[0]) * scale["sx"] + scale["mx"], float(c[1]) * scale["sy"] + scale["my"])
                   for c in model.clusterCenters()]
        cost = float(model.summary.trainingCost)
    finally:
        vectors.unpersist()
    return Centroids(centres, (scale["mx"], scale["my"]), (scale["sx"], scale["sy"]), cost, enough)


def assign(df: DataFrame, centroids: Centroids, roles: Roles = SALES, name: str = "cluster") -> DataFrame:
    """Nearest centre of every row, by distance in scaled units; the lower number wins ties.

    The centres are ``k`` constants in the plan: no join, no shuffle, no Python.
    """
    rows = points(df, roles)
    (sx, sy) = centroids.std
    options = F.array(*[
        F.struct(
            (((F.col("x") - cx) / sx) ** 2 + ((F.col("y") - cy) / sy) ** 2).alias("d"), F.lit(i).alias("i"))
        for i, (cx, cy) in enumerate(centroids.centres)
    ])
    return rows.withColumn(name, F.array_min(options)["i"])


def profile(assigned: DataFrame, roles: Roles = SALES, by: Sequence[str] = (), name: str = "cluster") -> DataFrame:
    """One row per cluster: size, means, ranges, entity groups, rank by mean volume and label."""
    keys = [*by, name]
    cells = assigned.groupBy(*keys, roles.dim).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    named = F.when(F.trim(roles.dim) != "", F.trim(roles.dim))
    stats = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.array_sort(F.collect_set(named)).alias("brands"),
    )
    # a few rows per group: one per cluster
    ranked = stats.withColumn("rank", F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc("my"), name)))
    whole = lambda c: numbers.rounded(c, 0).cast("bigint")
    return ranked.select(
        *by, F.col(name).alias("cluster"), "rank",
        text.segment_label(F.col("rank"), F.col("mx")).alias("label"),
        F.col("n").alias("rows"),
        numbers.rounded("mx", 1).alias("avg_price"), numbers.rounded("my", 1).alias("avg_sales"),
        numbers.rounded("x0", 1).alias("price_min"), numbers.rounded("x1", 1).alias("price_max"),
        whole("y0").alias("sales_min"), whole("y1").alias("sales_max"), "brands",
    )


def farthest(assigned: DataFrame, roles: Roles = SALES, by: Sequence[str] = (), name: str = "cluster",
             groups: int | None = None) -> DataFrame:
    """The member of each cluster farthest from the cluster mean, in raw units.

    ``groups`` is the number of clusters where it is known (``k``).
    """
    keys = [*by, name]
    means = assigned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    cols = assigned.select(*keys, roles.dim, roles.item, "x", "y")
    wide = attach(cols, means, keys, "_c", "n", groups)
    # rounded far below its meaning, so equal members tie on every engine
    dist = numbers.rounded(numbers.euclid(F.col("x") - F.col("_c.mx"), F.col("y") - F.col("_c.my")), 6)
    order = [F.desc("distance"), F.asc(roles.dim), F.asc(roles.item), F.asc("x"), F.asc("y")]
    far = top_per_group(wide.withColumn("distance", dist).drop("_c"), keys, order, 1)
    label = text.display_name(F.col(roles.dim), F.col(roles.item))
    return far.select(
        *by, F.when(label == "", fixed.UNKNOWN_ITEM).otherwise(label).alias("name"),
        F.col("x").alias("price"), F.col("y").alias("sales"), F.col(name).alias("cluster"), "distance",
        F.format_string(fixed.MSG_FARTHEST, F.col(name)).alias("reason"),
    )


def category_counts(assigned: DataFrame, roles: Roles = SALES, by: Sequence[str] = (),
                    name: str = "cluster") -> DataFrame:
    """Rows per cluster and category."""
    cat = F.coalesce(F.col(roles.cat), F.lit(fixed.UNKNOWN_TEXT)).alias(roles.cat)
    return assigned.groupBy(*by, name, cat).agg(F.count(F.lit(1)).alias("rows"))


def members(assigned: DataFrame, roles: Roles = SALES, name: str = "cluster") -> DataFrame:
    """Scatter of all rows with their cluster."""
    return assigned.select(text.display_name(F.col(roles.dim), F.col(roles.item)).alias("name"),
                           "x", "y", F.col(name).alias("cluster"))


class Segments(NamedTuple):
    centroids: Centroids
    clusters: DataFrame
    scatter: DataFrame
    extremes: DataFrame
    categories: DataFrame
    summary: DataFrame


def segment(df: DataFrame, k: int = 3, roles: Roles = SALES, seed: int = 42) -> Segments:
    """All tables of the segment view."""
    found = fit(df, k, roles, seed)
    assigned = assign(df, found, roles)
    centre = F.create_map(*[
        x for i, (cx, cy) in enumerate(found.centres)
        for x in (F.lit(i), F.struct(F.lit(round(cx, 1)).alias("price"), F.lit(round(cy, 1)).alias("sales")))
    ])
    clusters = profile(assigned, roles).withColumn("_c", centre[F.col("cluster")])
    clusters = unpack(
        clusters.withColumns({"centroid_price": F.col("_c.price"), "centroid_sales": F.col("_c.sales")}), "_c", [])
    summary = ranges(points(df, roles), roles).withColumns({
        "valid_rows": F.lit(found.valid_rows), "k": F.lit(k), "inertia": numbers.rounded(F.lit(found.inertia), 1)})
    return Segments(found, clusters, members(assigned, roles), farthest(assigned, roles, groups=k),
                    category_counts(assigned, roles), summary)
