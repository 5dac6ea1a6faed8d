import random

import pytest
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.operators import clustering, tenant_clusters

ROW = "user_id long, brand string, model string, sales_volume double, sales_price double, energy_type string"


def table(spark, users):
    """``users``: {key: [(price, volume), ...]}."""
    rows = [(u, f"b{i % 3}", f"m{i}", v, p, "油车") for u, points in users.items() for i, (p, v) in enumerate(points)]
    return spark.createDataFrame(rows, ROW).repartition(5)


def planted(rng, centres, each=25):
    return [(rng.gauss(x, 0.3), rng.gauss(y, 0.4)) for x, y in centres for _ in range(each)]


@pytest.fixture(scope="module")
def users():
    rng = random.Random(3)
    places = lambda: [(rng.uniform(2, 90), rng.uniform(3, 60)) for _ in range(3)]
    apart = lambda c: all(abs(a[0] - b[0]) + abs(a[1] - b[1]) > 25 for a in c for b in c if a is not b)
    given = {}
    while len(given) < 8:
        c = places()
        if apart(c):
            given[len(given) + 1] = planted(rng, c)
    given |= {20: [(5.0, 5.0)] * 40, 21: [(1.0, 2.0)] * 30 + [(9.0, 2.0)], 22: [(3.0, 4.0), (5.0, 6.0)],
              23: [(None, 4.0), (5.0, 1.0), (float("nan"), 2.0), (7.0, 3.0), (0.0, 9.0), (-1.0, 2.0)], None: planted(rng, [(5, 5), (50, 9), (9, 60)], 8)}
    return given


@pytest.fixture(scope="module")
def fitted(spark, users):
    df = table(spark, users)
    return df, tenant_clusters.fit(df, ["user_id"], 3)


def test_planted_groups_are_found(fitted):
    df, model = fitted
    found = {r["user_id"]: r for r in model.collect()}
    assigned = tenant_clusters.assign(df, model, ["user_id"]).groupBy("user_id", "cluster").count().collect()
    for user in range(1, 9):
        assert sorted(r["count"] for r in assigned if r["user_id"] == user) == [25, 25, 25]
        assert found[user]["status"] == "ok" and len(found[user]["centres"]) == 3
    assert sorted(r["count"] for r in assigned if r["user_id"] is None) == [8, 8, 8]
    assert len(found[20]["centres"]) == 1 and len(found[21]["centres"]) == 2
    assert found[20]["inertia"] == 0 and found[21]["inertia"] == pytest.approx(0)


def test_groups_with_too_few_rows_say_so(fitted):
    found = {r["user_id"]: r for r in fitted[1].collect()}
    for user, valid in ((22, 2), (23, 2)):
        assert found[user]["status"] == fixed.MSG_TOO_FEW % (3, valid)
        assert found[user]["centres"] is None and found[user]["inertia"] is None
    assert found[23]["rows"] == 4


def test_centres_are_means_and_inertia_is_the_cost(fitted):
    df, model = fitted
    found = {r["user_id"]: r for r in model.collect()}
    rows = tenant_clusters.assign(df, model, ["user_id"]).select("user_id", "x", "y", "cluster").collect()
    for user, m in found.items():
        own = [r for r in rows if r["user_id"] == user]
        if m["centres"] is None:
            assert not own
            continue
        scaled = [((r["x"] - m["mx"]) / m["sx"], (r["y"] - m["my"]) / m["sy"], r["cluster"]) for r in own]
        cost = 0.0
        for u, v, c in scaled:
            distances = [(u - z["u"]) ** 2 + (v - z["v"]) ** 2 for z in m["centres"]]
            assert distances[c] == min(distances)
            cost += distances[c]
        assert cost == pytest.approx(m["inertia"], abs=1e-9)
        for i, z in enumerate(m["centres"]):
            mean = [sum(s[a] for s in scaled if s[2] == i) / sum(s[2] == i for s in scaled) for a in (0, 1)]
            assert mean == pytest.approx([z["u"], z["v"]], abs=1e-3)


def test_same_quality_as_the_whole_table_fit(spark, users):
    """On one tenant with overlapping groups, against Spark's own K-means on the same rows."""
    rng = random.Random(8)
    df = table(spark, {1: [(rng.uniform(1, 50), rng.gauss(20, 9)) for _ in range(600)]}).filter("sales_volume > 0")
    mine = tenant_clusters.fit(df, ["user_id"], 4).first()
    other = clustering.fit(df, 4)
    assert mine["inertia"] <= 1.15 * other.inertia
    assert mine["rounds"] < tenant_clusters.ROUNDS


def test_repeated_fit_is_equal_and_order_does_not_matter(fitted):
    df, model = fitted
    key = lambda r: (r["user_id"] is None, r["user_id"])
    again = sorted(tenant_clusters.fit(df.repartition(3, "model"), ["user_id"], 3).collect(), key=key)
    for a, b in zip(sorted(model.collect(), key=key), again, strict=True):
        assert [(round(c["price"], 6), round(c["sales"], 6)) for c in a["centres"] or []] == [
            (round(c["price"], 6), round(c["sales"], 6)) for c in b["centres"] or []]


def test_one_tenant_with_most_rows_is_spread(spark, monkeypatch):
    """No shuffle of rows by tenant alone: the aggregate of a round is keyed by centre as well, its rows combined before."""
    df = table(spark, {1: [(float(i % 997) + 1, float(i % 89) + 1) for i in range(30_000)], 2: [(1.0, 2.0), (8.0, 9.0), (4.0, 4.0)] * 3})
    model = tenant_clusters.fit(df, ["user_id"], 3, rounds=4)
    sizes = {r["user_id"]: r["n"] for r in tenant_clusters.assign(df, model, ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {1: 30_000, 2: 9}
    assert max(r["rounds"] for r in model.collect()) <= 4


def test_all_tables_of_the_view(spark, users):
    found = tenant_clusters.segment(table(spark, users), ["user_id"], 3)
    clusters = found.clusters.collect()
    assert {c["user_id"] for c in clusters} == {*range(1, 9), 20, 21, None}
    assert all(c["rank"] == 1 for c in clusters if c["label"] and c["user_id"] == 20)
    ones = [c for c in clusters if c["user_id"] == 1]
    assert sorted(c["rank"] for c in ones) == [1, 2, 3] and sum(c["rows"] for c in ones) == 75
    assert all(abs(c["centroid_price"] - c["avg_price"]) <= 0.11 for c in ones)
    assert found.extremes.filter("user_id = 1").count() == 3 and found.scatter.filter("user_id = 1").count() == 75
    summary = {r["user_id"]: r for r in found.summary.collect()}
    assert summary[22]["status"] == fixed.MSG_TOO_FEW % (3, 2) and summary[1]["valid_rows"] == 75
    with pytest.raises(ValueError):
        tenant_clusters.fit(table(spark, users), ["user_id"], 1)
    assert tenant_clusters.fit(table(spark, {1: [(1.0, 2.0)]}).limit(0), ["user_id"], 3).count() == 0
