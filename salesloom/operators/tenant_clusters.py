"""K-means on scaled price and volume for all tenants at once.

Every step is one job over all groups: distinct (price, volume) pairs with their counts are joined with a
table of centres per group.  Seeds come from oversampled rounds (k-means||) whose random draws are hashes of
the pairs, so a repeated task draws the same ones; a Lloyd round is one aggregate keyed by group and
centre, so a tenant with most rows is summed by all tasks; groups whose centres stand still leave the loop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom import fixed
from salesloom.functions import numbers, text
from salesloom.operators import clustering
from salesloom.operators.aggregates import ranges
from salesloom.operators.cleaning import join_on
from salesloom.operators.spread import attach, top_per_group
from salesloom.roles import SALES, Roles
from salesloom.session import staged

#: Seeding rounds, draws of one round per centre, most Lloyd rounds, and the shift (in scaled units) that counts as none.
SEED_ROUNDS, DRAWS, ROUNDS, TOLERANCE = 3, 2, 100, 1e-4
CENTRES = T.ArrayType(T.StructType().add("u", T.DoubleType()).add("v", T.DoubleType()))


def _distance(c: Column, u: Column, v: Column) -> Column:
    return (u - c["u"]) * (u - c["u"]) + (v - c["v"]) * (v - c["v"])


def nearest(centres: Column, u: Column, v: Column) -> Column:
    """Struct of squared distance ``d`` and number ``i`` of the nearest centre; the lower number wins ties."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(_distance(c, u, v).alias("d"), i.alias("i"))))


def cells(df: DataFrame, by: Sequence[str], roles: Roles = SALES) -> DataFrame:
    """Distinct pairs of measures per group with their number of rows ``w``; the only pass over the source."""
    return clustering.points(df, roles).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


def scaling(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: ``rows``, ``valid_rows``, number of pairs ``size``, means, population deviations (one if constant)."""
    share = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    means = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"), F.sum("w").alias("rows"), share(F.col("x")).alias("mx"), share(F.col("y")).alias("my"),
        F.coalesce(F.sum(F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("w"))), F.lit(0.0)).alias("valid_rows"))
    wide = attach(pairs, means, by, "_m", "size")
    deviation = lambda c: F.sqrt(share((F.col(c) - F.col(f"_m.m{c}")) * (F.col(c) - F.col(f"_m.m{c}"))))
    some = lambda c: F.when(deviation(c) > 0, deviation(c)).otherwise(1.0)
    return wide.groupBy(*by).agg(
        *[F.max(f"_m.{c}").alias(c) for c in ("size", "mx", "my")],
        *[F.max(f"_m.{c}").cast("long").alias(c) for c in ("rows", "valid_rows")], some("x").alias("sx"), some("y").alias("sy"))


@F.pandas_udf(CENTRES)
def _reduced(drawn: pd.Series, k: pd.Series) -> pd.Series:
    """Draws ``(u, v, weight)`` of a group, a few dozen at most, to ``k`` seeds: the heaviest, then always the one
    with the most weight times squared distance."""
    out = []
    for rows, wanted in zip(drawn, k):
        at = np.array([(r["u"], r["v"]) for r in rows])
        weight = np.array([r["weight"] for r in rows])
        chosen = [int(weight.argmax())]
        far = ((at - at[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < wanted and far.max() > 0:
            chosen.append(int((weight * far).argmax()))
            far = np.minimum(far, ((at - at[chosen[-1]]) ** 2).sum(axis=1))
        out.append([{"u": float(u), "v": float(v)} for u, v in at[sorted(chosen)]])
    return pd.Series(out)


def seeds(scaled: DataFrame, by: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """``(by, size, centres)``: up to ``k`` centres per group by k-means||.

    ``scaled`` has ``u, v, w`` and the ``size`` of the group.  Every round takes, per group, ``DRAWS * k`` pairs with odds by
    weight and squared distance to the nearest draw so far: those with the smallest exponential clocks.
    """
    def clock(rate: Column, turn: int) -> Column:
        even = (F.shiftrightunsigned(F.xxhash64(*by, "u", "v", F.lit(seed), F.lit(turn)), 11) + F.lit(0.5)) / F.lit(float(2 ** 53))
        return -F.log(even) / rate

    point = F.struct("u", "v").alias("p")
    first = scaled.groupBy(*by).agg(F.min(F.struct(clock(F.col("w"), 0).alias("t"), point, F.col("size"))).alias("f"))
    drawn = staged(first.select(*by, F.col("f.size").alias("size"), F.col("f.p.u").alias("u"), F.col("f.p.v").alias("v")), "draws")

    def known() -> DataFrame:
        # 1 + SEED_ROUNDS * DRAWS * k draws at most
        table = drawn.groupBy(*by).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("u", "v"))).alias("draws"))
        return attach(scaled, table, by, "_d", "size")

    for turn in range(1, SEED_ROUNDS + 1):
        far = known().withColumn("_far", nearest(F.col("_d.draws"), F.col("u"), F.col("v"))["d"]).filter("_far > 0")
        clocks = far.select(*by, "size", "u", "v", clock(F.col("w") * F.col("_far"), turn).alias("_t"))
        more = top_per_group(clocks, by, [F.asc("_t"), F.asc("u"), F.asc("v")], DRAWS * k)
        drawn = staged(drawn.unionByName(more.select(*drawn.columns)), "draws")

    near = known().withColumn("_i", nearest(F.col("_d.draws"), F.col("u"), F.col("v"))["i"])
    weights = near.groupBy(*by, F.col("_d.draws")[F.col("_i")].alias("_p")).agg(F.sum("w").alias("weight"), F.max("size").alias("size"))
    listed = weights.groupBy(*by).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(
        F.struct(F.col("_p.u").alias("u"), F.col("_p.v").alias("v"), "weight"))).alias("drawn"))
    return staged(listed.select(*by, "size", _reduced("drawn", F.lit(k)).alias("centres")), "seeds")


def _moved(centres: Column, means: Column) -> Column:
    """Largest squared shift of a centre."""
    return F.array_max(F.zip_with(centres, means, lambda a, b: _distance(a, b["u"], b["v"])))


def _rounds(scaled: DataFrame, table: DataFrame, by: Sequence[str], rounds: int) -> Iterator[DataFrame]:
    """Lloyd rounds; yields the groups that stand still after each, with the number of rounds they took."""
    for turn in range(1, rounds + 1):
        wide = attach(scaled, table, by, "_c", "size").filter(F.col("_c").isNotNull())
        near = wide.withColumn("_n", nearest(F.col("_c.centres"), F.col("u"), F.col("v"))["i"])
        sums = near.groupBy(*by, F.col("size"), F.col("_c.centres").alias("old"), F.col("_n")).agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v"))
        mean = F.struct(F.col("_n"), F.struct((F.col("u") / F.col("w")).alias("u"), (F.col("v") / F.col("w")).alias("v")).alias("c"))
        # k rows per group; a centre without rows stays where it is
        found = sums.groupBy(*by, "size", "old").agg(F.map_from_entries(F.collect_list(mean)).alias("found"))
        new = found.withColumn("centres", F.transform("old", lambda c, i: F.coalesce(F.col("found")[i], c)))
        new = staged(new.select(*by, "size", "centres", _moved(F.col("old"), F.col("centres")).alias("moved")), "centres")
        still = F.col("moved") <= TOLERANCE ** 2
        last = turn == rounds
        yield (new if last else new.filter(still)).select(*by, "size", "centres", F.lit(turn).alias("rounds"))
        table = new.filter(~still).drop("moved")
        if last or table.isEmpty():
            return


def fit(df: DataFrame, by: Sequence[str], k: int = 3, roles: Roles = SALES, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """One row per group: ``rows``, ``valid_rows``, ``status``, ``centres`` in raw units with scaled ones beside them
    (``price, sales, u, v``), scaling ``mx, my, sx, sy``, ``inertia`` in scaled units and ``rounds``.

    A group with fewer than ``k`` rows with both measures positive has a status that says so and no centres; a group
    with fewer than ``k`` different pairs has one centre for each.  Rows without a measure are left out; null keys are a group.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    if not by:
        raise ValueError("clustering.fit is for one whole table")
    by = list(by)
    pairs = staged(cells(df, by, roles), "pairs")
    scale = staged(scaling(pairs, by), "scaling")
    wide = attach(pairs, scale, by, "_s", "size").filter(F.col("_s.valid_rows") >= k)
    scaled = staged(wide.select(
        *by, F.col("_s.size").alias("size"), "w", ((F.col("x") - F.col("_s.mx")) / F.col("_s.sx")).alias("u"),
        ((F.col("y") - F.col("_s.my")) / F.col("_s.sy")).alias("v")), "scaled")

    finished = list(_rounds(scaled, seeds(scaled, by, k, seed), by, rounds))
    table = finished[0]
    for more in finished[1:]:
        table = table.unionByName(more)
    table = staged(table, "centres")
    near = attach(scaled, table, by, "_c", "size").withColumn("_n", nearest(F.col("_c.centres"), F.col("u"), F.col("v")))
    cost = near.groupBy(*by).agg(F.sum(F.col("w") * F.col("_n.d")).alias("inertia"))
    model = join_on(join_on(scale, table.drop("size"), by, "left"), cost, by, "left")
    raw = F.transform("centres", lambda c: F.struct(
        (c["u"] * F.col("sx") + F.col("mx")).alias("price"), (c["v"] * F.col("sy") + F.col("my")).alias("sales"),
        c["u"].alias("u"), c["v"].alias("v")))
    status = F.when(F.col("valid_rows") < k, F.format_string(fixed.MSG_TOO_FEW, F.lit(k), F.col("valid_rows"))).otherwise("ok")
    return staged(model.select(*by, "rows", "valid_rows", status.alias("status"), raw.alias("centres"),
                               "mx", "my", "sx", "sy", "inertia", "rounds"), "model")


def assign(df: DataFrame, model: DataFrame, by: Sequence[str], roles: Roles = SALES, name: str = "cluster") -> DataFrame:
    """Rows of the fitted groups with both measures, as ``x`` and ``y``, and their nearest centre; further columns stay."""
    rows = clustering.points(df, roles)
    wide = attach(rows, model.select(*by, "rows", "centres", "mx", "my", "sx", "sy"), by, "_m", "rows").filter(F.col("_m.centres").isNotNull())
    u, v = (F.col("x") - F.col("_m.mx")) / F.col("_m.sx"), (F.col("y") - F.col("_m.my")) / F.col("_m.sy")
    return wide.withColumn(name, nearest(F.col("_m.centres"), u, v)["i"]).drop("_m")


class Segments(NamedTuple):
    model: DataFrame
    clusters: DataFrame
    scatter: DataFrame
    extremes: DataFrame
    categories: DataFrame
    summary: DataFrame


def segment(df: DataFrame, by: Sequence[str], k: int = 3, roles: Roles = SALES, seed: int = 42) -> Segments:
    """All tables of the segment view for all groups; ``summary`` has a row for every group, with its status."""
    by = list(by)
    model = fit(df, by, k, roles, seed)
    assigned = assign(df, model, by, roles)
    centres = model.filter(F.col("centres").isNotNull()).select(*by, F.posexplode("centres").alias("cluster", "_c"))
    centres = centres.select(*by, "cluster", numbers.rounded("_c.price", 1).alias("centroid_price"), numbers.rounded("_c.sales", 1).alias("centroid_sales"))
    clusters = join_on(clustering.profile(assigned, roles, by), centres, [*by, "cluster"], "left")
    name = text.display_name(F.col(roles.dim), F.col(roles.item))
    scatter = assigned.select(*by, name.alias("name"), "x", "y", "cluster")
    status = model.select(*by, "valid_rows", "status", F.lit(k).alias("k"), numbers.rounded("inertia", 1).alias("inertia"), "rounds")
    spans = ranges(clustering.points(df, roles), roles, by)
    return Segments(model, clusters, scatter, clustering.farthest(assigned, roles, by), clustering.category_counts(assigned, roles, by),
                    join_on(spans, status, by, "left"))
