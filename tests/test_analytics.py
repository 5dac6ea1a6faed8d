import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.operators import (
    aggregates, charts, clustering, correlation, filters, narrative, ranking, regression, tenants,
)

SCHEMA = "user_id long, brand string, model string, sales_volume long, sales_price double, energy_type string"


@pytest.fixture(scope="module")
def cars(spark):
    r = random.Random(11)
    kinds = ["油车", "电车", "混动"]
    data = [(i % 4, f"b{i % 5}", f"m{i % 11}", r.randint(1, 60), round(r.uniform(3, 70), 2), kinds[i % 3])
            for i in range(400)]
    return data, spark.createDataFrame(data, SCHEMA).cache()


def test_overview_of_nothing(spark, cars):
    empty = cars[1].limit(0)
    got = aggregates.overview(empty).first().asDict()
    assert got["total_rows"] == 0 and got["top_volume_name"] == "-" and got["oil_ratio"] == 0.0
    wanted = spark.createDataFrame([(1,), (99,)], "user_id long")
    by_user = {r["user_id"]: r for r in aggregates.overview(cars[1], by=["user_id"], tenants=wanted).collect()}
    assert by_user[99]["total_rows"] == 0 and by_user[99]["top_item_by_rows"] == "-"
    assert by_user[1]["total_rows"] == 100


def test_overview_of_groups_without_measures(spark):
    rows = [(1, "a", "x", None, 2.0, "油车"), (2, "a", "x", 5, None, "油车"), (3, None, "y", 4, 1.5, "油车"), (4, None, None, 4, 1.5, "油车")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["user_id"]: r for r in aggregates.overview(df, by=["user_id"]).collect()}
    assert [got[1][c] for c in ("top_volume_name", "top_volume", "top_revenue_name", "top_revenue", "avg_price")] == ["-", 0, "-", 0.0, 2.0]
    assert [got[2][c] for c in ("top_volume_name", "top_volume", "top_revenue_name", "top_revenue")] == ["a x", 5, "-", 0.0]
    assert [got[3][c] for c in ("top_volume_name", "top_revenue_name", "top_dim_by_rows")] == ["y", "y", "-"]
    assert got[4]["top_volume_name"] == "" and got[4]["top_volume"] == 4


def test_shares_never_exceed_whole(cars):
    for r in aggregates.volume_shares(cars[1], by=["user_id"]).collect():
        assert sum(r[c] for c in ("oil", "electric", "hybrid")) == pytest.approx(100, abs=0.2)


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(5.0,), (9.99,), (10.0,), (1e6,)], "sales_price double")
    assert [r["rows"] for r in aggregates.price_histogram(df).orderBy("bin").collect()] == [2, 1, 0, 0, 1]


def test_ties_go_to_first_name(spark):
    df = spark.createDataFrame([(1, "b", "x", 5, 2.0, "油车"), (1, "a", "y", 5, 2.0, "油车")], SCHEMA)
    got = aggregates.overview(df).first()
    assert (got["top_volume_name"], got["top_item_by_rows"], got["top_dim_by_rows"]) == ("a y", "x", "a")


def test_distinct_counts(cars):
    assert aggregates.counts(cars[1]).first()["dims"] == 5
    assert aggregates.counts(cars[1], approximate=True).first()["dims"] == 5


def test_top_rows(cars):
    data, df = cars
    want = sorted((d[3] for d in data), reverse=True)[:6]
    assert [r["sales_volume"] for r in ranking.top_rows(df, n=6).collect()] == want
    assert [r["sales_volume"] for r in ranking.top_rows(df, order="asc", n=6).collect()] == want[::-1]
    prices = sorted((d[4] for d in data), reverse=True)[:6]
    assert [r["sales_price"] for r in ranking.top_rows(df, "sales_price", n=6).collect()] == prices
    assert ranking.top_rows(df, n=0).count() == 400
    assert "TakeOrderedAndProject" in ranking.top_rows(df, n=6)._jdf.queryExecution().executedPlan().toString()


def test_scaling_to_range(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 3.0), ("c", 3.0, 3.0)], "k string, v double, w double")
    got = ranking.scale_groups(df, ["v", "w"]).orderBy("k").collect()
    assert [r["v_scaled"] for r in got] == [20.0, 60.0, 100.0] and {r["w_scaled"] for r in got} == {50.0}


def test_filters(spark, cars):
    df = cars[1]
    assert filters.filter_category(df, "all").count() == 400
    assert filters.filter_items(df, []).count() == 400
    assert filters.filter_items(df, ["b0 m0"]).count() == sum(d[1] == "b0" and d[2] == "m0" for d in cars[0])
    users = spark.createDataFrame([(5, "7"), (7, "x")], "user_id long, username string")
    assert filters.resolve_user(users, "7").first()["user_id"] == 7
    assert filters.resolve_user(users, "x").first()["user_id"] == 7
    assert filters.resolve_user(users.filter("user_id = 5"), 7).first()["user_id"] == 5
    df = spark.createDataFrame([("a", None)], "n string, d date")
    assert filters.records(df).first().asDict() == {"n": "a", "d": ""}


# ---------------------------------------------------------------- statistics

def test_correlation_of_known_data(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    y = [2.0, 1, 4, 3, 7, 8, 6, 9]
    df = spark.createDataFrame([(0, "b", "m", int(v), p, "油车") for p, v in zip(x, y)], SCHEMA)
    got = correlation.overall(df).first()
    r = np.corrcoef(x, y)[0, 1]
    rho = np.corrcoef(x, np.argsort(np.argsort(y)))[0, 1]
    assert got["pearson_r"] == pytest.approx(r, abs=1e-4) and got["spearman_rho"] == pytest.approx(rho, abs=1e-4)
    # two-sided Student t by numerical integration
    t = r * np.sqrt(6 / (1 - r * r))
    grid = np.linspace(t, 4000, 4_000_001)
    dens = (1 + grid ** 2 / 6) ** -3.5
    half = np.linspace(0, 4000, 8_000_001)
    p = np.trapezoid(dens, grid) / np.trapezoid((1 + half ** 2 / 6) ** -3.5, half)
    assert float(got["pearson_p"]) == pytest.approx(p, abs=2e-4)
    assert got["interpretation"] == "强正相关" and got["success"]


def test_correlation_needs_points(spark):
    df = spark.createDataFrame([(0, "b", "m", 1, float(i), "油车") for i in range(5)], SCHEMA)
    got = correlation.overall(df).first()
    assert not got["success"] and got["pearson_r"] is None and got["error"] == "有效数据不足（需 ≥5 条，当前 4 条）"
    assert correlation.counterexamples(df).count() == 0


def test_spearman_with_ties_and_hot_value(spark):
    r = random.Random(2)
    pts = [(float(r.choice([1, 1, 1, 2, 3, 4])), r.randint(1, 5)) for _ in range(500)]
    df = spark.createDataFrame([(0, "b", "m", v, p, "油车") for p, v in pts], SCHEMA)

    def average_rank(v):
        v = np.asarray(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    want = np.corrcoef(average_rank([p for p, _ in pts]), average_rank([v for _, v in pts]))[0, 1]
    assert correlation.spearman(df).first()["rho"] == pytest.approx(want, abs=1e-12)


def test_strata(cars, spark):
    small = spark.createDataFrame([(0, "b", "m", 3, 4.0, "氢能")], SCHEMA)
    got = {r["energy_type"]: r for r in correlation.by_category(cars[1].unionByName(small)).collect()}
    assert got["氢能"]["note"] == "样本不足" and got["氢能"]["r"] is None and not got["氢能"]["significant"]
    assert got["油车"]["n"] == 134 and got["油车"]["p"] is not None


def test_bundle(cars):
    b = correlation.analyze(cars[1], "energy")
    assert b.by_category.count() == 3 and b.counterexamples.count() == 4 and b.scatter.count() == 400
    assert correlation.analyze(cars[1]).by_category is None


def design(data):
    return (np.array([[d[4], float("电" in d[5]), float("混" in d[5])] for d in data]),
            np.array([float(d[3]) for d in data]))


def fit_by_hand(X, y):
    A = np.column_stack([np.ones(len(X)), X])
    return np.linalg.lstsq(A, y, rcond=None)[0]


def r2_of(X, y, beta):
    res = y - np.column_stack([np.ones(len(X)), X]) @ beta
    return 1 - (res ** 2).sum() / ((y - y.mean()) ** 2).sum()


def folds_by_hand(data, k=5):
    data = sorted(data, key=lambda d: (d[1], d[2], d[4], d[3], "电" in d[5], "混" in d[5]))
    X, y = design(data)
    X = (X - X.mean(0)) / np.where(X.std(0) > 0, X.std(0), 1)
    parts = np.array_split(np.arange(len(data)), k)
    out = []
    for part in parts:
        rest = np.setdiff1d(np.arange(len(data)), part)
        # least squares about the training means, minimum norm, as a linear model with intercept is fitted
        mx, my = X[rest].mean(0), y[rest].mean()
        w = np.linalg.lstsq(X[rest] - mx, y[rest] - my, rcond=1e-10)[0]
        res = y[part] - (my + (X[part] - mx) @ w)
        out.append(1 - (res ** 2).sum() / ((y[part] - y[part].mean()) ** 2).sum())
    return float(np.mean(out))


def test_regression_against_lstsq(cars):
    data, df = cars
    model = regression.train(df).first()
    X, y = design(data)
    beta = fit_by_hand(X, y)
    assert [model["raw_intercept"], model["raw_price"], model["raw_is_electric"], model["raw_is_hybrid"]] == \
        pytest.approx(list(beta), abs=1e-8)
    assert model["coef_price"] == pytest.approx(beta[1] * X[:, 0].std(), abs=1e-8)
    res = y - np.column_stack([np.ones(len(X)), X]) @ beta
    assert model["r2"] == pytest.approx(r2_of(X, y, beta), abs=1e-10)
    assert model["rmse"] == pytest.approx(np.sqrt((res ** 2).mean())) and model["mae"] == pytest.approx(np.abs(res).mean())
    assert model["cv_r2_mean"] == pytest.approx(folds_by_hand(data), abs=1e-8)


def test_regression_against_spark_ml(cars):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    feats = regression.features(cars[1])
    ready = VectorAssembler(inputCols=regression.FEATURES, outputCol="features").transform(feats)
    ml = LinearRegression(labelCol="y", solver="normal").fit(ready)
    ours = regression.fit(cars[1]).first()
    assert [ours[f"raw_{c}"] for c in regression.FEATURES] == pytest.approx(list(ml.coefficients), abs=1e-6)


def test_models_per_user_and_missing_category(cars, spark):
    """One user lacks a category in one fold; the solve is singular there."""
    data, _ = cars
    mine = [(9, f"b{i}", "m", 10 + i * i % 7, 5.0 + i, "电车" if i < 2 else "油车") for i in range(10)]
    few = [(8, "b", "m", 1, 1.0, "油车")] * 4
    df = spark.createDataFrame(data + mine + few, SCHEMA)
    got = {r["user_id"]: r for r in regression.train(df, by=["user_id"]).collect()}
    assert set(got) == {0, 1, 2, 3, 9}
    for u in (0, 3):
        assert got[u]["cv_r2_mean"] == pytest.approx(folds_by_hand([d for d in data if d[0] == u]), abs=1e-8)
    assert got[9]["cv_r2_mean"] == pytest.approx(folds_by_hand(mine), abs=1e-6)
    users = spark.createDataFrame([(8,), (9,)], "user_id long")
    info = {r["user_id"]: r for r in regression.model_info(regression.train(df, by=["user_id"]), ["user_id"], users).collect()}
    assert info[9]["ready"] and not info[8]["ready"]
    assert (info[8]["mode"], info[8]["warning"], info[8]["data_points"]) == ("no_data", "请先上传数据", 0)


def test_copies_split_over_folds(spark):
    """A single row repeated many times covers several folds."""
    data = [(0, "a", "m", 5, 10.0, "油车")] * 30 + [(0, "b", f"m{i}", i + 1, 5.0 + i, "电车") for i in range(20)]
    sizes = regression.fold_sizes(spark.createDataFrame(data, SCHEMA)).orderBy("fold").collect()
    assert [r["rows"] for r in sizes] == [10] * 5
    twelve = spark.createDataFrame([(0, f"b{i}", "m", 1, 1.0, "油车") for i in range(12)], SCHEMA)
    assert [r["rows"] for r in regression.fold_sizes(twelve).orderBy("fold").collect()] == [3, 3, 2, 2, 2]


def test_prediction(spark, cars):
    model = regression.train(cars[1], cross_validate=False)
    ask = spark.createDataFrame([(20.0, "纯电动", 2), (20.0, "纯电动", None), (1e6, "油车", 12)],
                                "price double, energy_type string, month int")
    m = model.first()
    got = regression.predict(ask, model).collect()
    monthly = m["raw_intercept"] + m["raw_price"] * 20 + m["raw_is_electric"]
    assert got[0]["monthly_sales"] == round(monthly) and got[0]["annual_sales"] == round(monthly * 12 * 0.55)
    assert (got[1]["annual_method"], got[1]["factor"]) == ("naive", 1.005)
    half = round(m["rmse"], 1) * 1.96
    assert (got[0]["interval_low"], got[0]["interval_high"]) == (round(max(0, monthly - half)), round(monthly + half))
    assert got[2]["monthly_sales"] == 0 or m["raw_price"] > 0
    none = regression.predict(ask, model.limit(0)).first()
    assert not none["success"] and none["error"] == "模型未就绪，请先上传数据"


# ---------------------------------------------------------------- clusters

def planted(spark):
    r = random.Random(4)
    rows = []
    for c, (p, q) in enumerate([(10, 500), (30, 100), (80, 20)]):
        rows += [(c, f"b{c}", f"m{i}", int(q + r.uniform(-5, 5)), p + r.uniform(-1, 1), "油车") for i in range(10)]
    return spark.createDataFrame(rows, SCHEMA)


def test_kmeans_finds_planted_clusters(spark):
    df = planted(spark)
    found = clustering.segment(df, 3)
    got = clustering.assign(df, found.centroids).groupBy("user_id").agg(F.collect_set("cluster").alias("c")).collect()
    assert all(len(r["c"]) == 1 for r in got) and len({r["c"][0] for r in got}) == 3
    first = found.clusters.orderBy("rank").collect()
    assert [r["label"] for r in first] == ["簇1·高销量主力", "簇2·高端车型", "簇3·高端车型"]
    assert [r["rows"] for r in first] == [10, 10, 10] and found.summary.first()["valid_rows"] == 30
    assert found.extremes.count() == 3 and found.scatter.count() == 30


def test_kmeans_inertia_is_the_assignment_cost(spark):
    df = planted(spark)
    c = clustering.fit(df, 3)
    rows = clustering.assign(df, c).select("x", "y", "cluster").collect()
    cost = sum(((r["x"] - c.centres[r["cluster"]][0]) / c.std[0]) ** 2
               + ((r["y"] - c.centres[r["cluster"]][1]) / c.std[1]) ** 2 for r in rows)
    assert c.inertia == pytest.approx(cost, rel=1e-6)


def test_kmeans_gates(spark):
    df = planted(spark)
    with pytest.raises(ValueError):
        clustering.fit(df, 1)
    with pytest.raises(clustering.TooFewRows):
        clustering.fit(df.limit(2), 3)


# ---------------------------------------------------------------- charts, report, joins

@pytest.mark.parametrize("kind", charts.CHART_TYPES)
def test_every_chart_type(cars, kind):
    assert charts.chart_rows(cars[1], charts.ChartSpec(kind)).count() > 0


def test_chart_requests_are_checked():
    for bad in ({"chart_type": "cube"}, {"sort_by": "colour"}, {"sort_order": "up"}):
        with pytest.raises(ValueError):
            charts.ChartSpec(**bad)
    assert charts.chart_config()["default_params"]["top_n"] == 15


def test_small_slices(spark):
    df = spark.createDataFrame([("a", 97), ("b", 1), ("c", 2)], "n string, v long")
    got = {r["slice"]: r["size"] for r in charts.collapse_small(df, "n", "v").collect()}
    assert got == {"a": 97, "c": 2, "其他": 1}


def test_chart_without_rows(cars):
    rows = charts.chosen_rows(cars[1], charts.ChartSpec(energy_filter="氢能"))
    assert charts.chart_info(rows).first()["error"] == "筛选条件下无数据"


def test_dashboard(cars):
    board = charts.dashboard(cars[1])
    assert board.records.count() == 400 and board.top_models.count() == 10 and board.price_bins.count() == 5


def test_report(cars, spark):
    users = spark.createDataFrame([(0,), (77,)], "user_id long")
    got = {r["user_id"]: r for r in narrative.report(cars[1], tenants=users).collect()}
    assert not got[77]["success"] and got[77]["message"] == "请先上传数据" and got[77]["report"] is None
    text = got[0]["report"]
    assert "共覆盖 100 条" in text and "{" not in text and text.count("### ") == 7
    top = aggregates.volume_by_dim(cars[1].filter("user_id = 0")).first()
    assert f"{top['brand']}({top['total_sales']}辆), " in text


def test_joins_keep_users_without_anything(spark, cars):
    users = spark.createDataFrame([(0, "a", "2024-01-01", 5), (50, "z", "2024-02-01", None)],
                                  "user_id long, username string, created_at string, active_upload_id long")
    uploads = spark.createDataFrame([(5, 0, "f.csv", 3, "2024-01-02"), (6, 0, "g.csv", 0, "2024-01-02")],
                                    "upload_id long, user_id long, filename string, record_count long, created_at string")
    archive = spark.createDataFrame([(5,), (5,)], "upload_id long")
    totals = {r["user_id"]: r for r in tenants.user_statistics(users, cars[1], uploads).collect()}
    assert totals[50]["vehicle_count"] == 0 and totals[0]["vehicle_count"] == 100 and totals[0]["upload_count"] == 2
    listed = tenants.upload_list(uploads, archive, users).collect()
    assert [(r["upload_id"], r["archived_count"], r["is_active"]) for r in listed] == [(6, 0, False), (5, 2, True)]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(0, "b", "m", i + 1, 5.0, "油车") for i in range(8)], SCHEMA)
    got = correlation.overall(df).first()
    assert got["success"] and got["pearson_r"] is None and got["spearman_rho"] is None
    assert correlation.by_category(df).first()["r"] is None
