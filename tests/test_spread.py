"""Building blocks against brute force, with hot groups and hot values."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from salesloom.operators import spread


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, null keys, repeated values."""
    r = random.Random(5)
    rows = [(("hot" if i % 3 == 0 else (None if i % 17 == 0 else f"g{i % 40}")), r.choice([None, 7.5, r.gauss(0, 9)]), i % 5)
            for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, v double, w long").cache()


def groups_of(rows):
    out = {}
    for g, v, _ in rows:
        out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("groups", [None, 50])
def test_attach_reaches_every_row(skewed, groups):
    rows, df = skewed
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    got = spread.attach(df, stats, ["g"], "st", "n", groups).select("g", "st.n").collect()
    sizes = {g: len(v) for g, v in groups_of(rows).items()}
    assert len(got) == len(rows)
    assert all(r["n"] == sizes[r["g"]] for r in got)


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_profile_is_exact(skewed, accuracy):
    rows, df = skewed
    got = {r["g"]: r for r in spread.measure_profile(df, ["v"], ["g"], accuracy).collect()}
    for g, values in groups_of(rows).items():
        known = [v for v in values if v is not None]
        assert (got[g]["rows"], got[g]["v_n"]) == (len(values), len(known))
        assert got[g]["v_median"] == pytest.approx(statistics.median(known))
        assert got[g]["v_var"] == pytest.approx(statistics.pvariance(known))


def test_global_median_with_coarse_sketch(spark):
    values = [float((i * 7919) % 10007) for i in range(10007)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert spread.measure_profile(df, ["v"], accuracy=50).first()["v_median"] == statistics.median(values)


def test_bracket_keeps_few_values(spark):
    """The exact step sees only the values inside the bracket and its two ends."""
    df = spark.range(100_000).select((F.col("id") * 1.0).alias("v"))
    b = df.agg(spread.median_bracket(F.col("v"), 1000)).first()[0]
    inside = df.filter(F.col("v").between(*b)).count()
    assert b[0] <= 49999.5 <= b[1] and inside <= 2000


def test_missed_bracket_fails_loudly(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("v"), F.array(F.lit(80.0), F.lit(90.0)).alias("b"))
    with pytest.raises(Exception, match="accuracy"):
        df.agg(spread.clipped_median(F.col("v"), F.col("b"))).collect()


def test_modes_take_smallest_of_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None)], "x string, y string")
    assert spread.modes(df, ["x", "y"]).first()["x_mode"] == "a"
    assert spread.modes(df, ["x", "y"]).first()["y_mode"] is None


@pytest.mark.parametrize("n", [2, 5])
def test_top_per_group(skewed, n):
    rows, df = skewed
    order = [F.desc("v"), F.asc("w")]
    plain = spread.top_per_group(df, ["g"], order, n).select("g", "v", "rank").collect()
    df.sparkSession.conf.set(spread.GROUP_LIMIT_SETTING, "1")
    salted = spread.top_per_group(df, ["g"], order, n).select("g", "v", "rank").collect()
    df.sparkSession.conf.unset(spread.GROUP_LIMIT_SETTING)
    key = lambda r: (str(r["g"]), r["rank"])
    assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, salted), key=str)
    best = {g: sorted((v for v in vs if v is not None), reverse=True)[:n] for g, vs in groups_of(rows).items()}
    for g, want in best.items():
        assert [r["v"] for r in sorted(plain, key=key) if r["g"] == g][: len(want)] == want


def test_top_limits_before_the_shuffle(spark, skewed):
    plan = spread.top_per_group(skewed[1], ["g"], [F.desc("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_start(skewed, by):
    rows, df = skewed
    cells = df.filter("v is not null").groupBy(*by, "v").agg(F.sum(F.col("w") + 1).alias("w"))
    got = spread.running_start(cells, ["v"], "w", by, partitions=7).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (str(r["g"]) if by else "", r["v"])):
        k = r["g"] if by else None
        assert r["start"] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + r["w"]
    assert len(got) == cells.count()


def test_equal_rows_of_a_hot_group_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 200_000, 1, 16).select(F.lit("hot").alias("g"), F.lit(1.0).alias("v"))
        stats = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
        out = spread.attach(rows, stats, ["g"], "s", "n").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
        assert sum(sizes) == 200_000 and len(sizes) > 1 and max(sizes) < 150_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_per_group_has_the_same_columns_for_every_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)], "g string, v int")
    for n in (-1, 0, 1, 5, 5000):
        got = spread.top_per_group(df, ["g"], [df["v"].asc()], n)
        assert got.columns == ["g", "v", "rank"] and got.count() == (n if 0 < n < 9 else 9)
