import pytest
from pyspark.sql import functions as F

from salesloom.operators import cleaning
from salesloom.plans.clean import auto_clean, interactive_clean, report_totals
from salesloom.roles import SALES, Roles

NUM = "brand string, model string, sales_volume double, sales_price double, energy_type string"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_headers(spark):
    df = spark.createDataFrame([("a", "b", "1", "2", "c", "x")], [" 品牌", "Model ", "销量", "价格(万)", "FUEL", "extra"])
    assert cleaning.harmonise(df).columns == SALES.required + ["extra"]


def test_alias_collision(spark):
    with pytest.raises(ValueError, match="sales_volume"):
        cleaning.harmonise(spark.createDataFrame([("1", "2")], ["sales", "销量"]))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="model, sales_price"):
        cleaning.check_columns(spark.createDataFrame([("a", 1, "c")], ["brand", "sales_volume", "energy_type"]))


def test_copies(spark, sales):
    df = sales([("a", "m", "1", "1", "x")] * 3 + [("a", "m", "2", "1", "x"), (None, "m", "1", "1", "x")] * 2)
    assert cleaning.copies_report(df).first().asDict() == {
        "original_rows": 7, "distinct_rows": 3, "duplicates_removed": 4}
    by = {r["brand"]: r["duplicates_removed"] for r in cleaning.copies_report(df, ["brand"]).collect()}
    assert by == {"a": 3, None: 1}


def test_ids_do_not_make_rows_distinct(spark):
    df = spark.createDataFrame([(7, "a"), (3, "a"), (9, "b")], "id long, brand string")
    assert rows(cleaning.drop_copies(df, ["id"]), "id", "brand") == [(3, "a"), (9, "b")]


def test_median_fill(spark):
    df = spark.createDataFrame([("a", "m", v, None, "x") for v in (1.0, 2.0, 10.0, 11.0, None)], NUM)
    got = rows(cleaning.fill_median(df, SALES.numeric), "sales_volume", "sales_price")
    assert got == [(1.0, 0.0), (2.0, 0.0), (6.0, 0.0), (10.0, 0.0), (11.0, 0.0)]


def test_median_fill_per_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, 8.0), (None, None)],
                               "brand string, v double")
    assert sorted(cleaning.fill_median(df, ["v"], ["brand"]).collect(), key=str) == sorted(
        [("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 0.0), (None, 8.0), (None, 8.0)], key=str)


def test_mode_fill(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    assert rows(cleaning.fill_mode(df, ["x", "y"]), "x", "y")[:3] == [("a", "未知"), ("a", "未知"), ("a", "未知")]
    assert rows(cleaning.fill_mode_date_text(df, "y"), "y")[0] == ("2024-01",)


@pytest.mark.parametrize("values", [[1.0, 1.0, 100.0], [5.0] * 5, [None] * 5])
def test_zscore_leaves_small_and_constant_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert cleaning.repair_zscore(df, ["v"], flag=True).filter("v_outlier").count() == 0


def test_zscore_repairs_with_median(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4] * 5 + [1000]], "v double")
    out = cleaning.repair_zscore(df, ["v"], flag=True)
    assert out.filter("v_outlier").collect() == [(3.0, True)]
    assert out.filter("v > 4").count() == 0


@pytest.mark.parametrize("lo, hi, wanted", [
    (2, None, [2.5, 2.0, 3.0, 4.0]), (None, 3, [1.0, 2.0, 3.0, 2.5]), (2, 3, [2.5, 2.0, 3.0, 2.5]),
    (None, None, [1.0, 2.0, 3.0, 4.0]),
])
def test_range_repair(spark, lo, hi, wanted):
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "i int, v double")
    got = [r["v"] for r in cleaning.repair_range(df, "v", lo, hi).orderBy("i").collect()]
    assert got == wanted


def test_invalid_entities(spark, sales):
    names = ["", "未知", "unknown", "Unknown", "NaN", "nan", "真"]
    df = sales([(n, "m", "1", "1", "x") for n in names] + [("真", n, "1", "1", "x") for n in names])
    assert rows(cleaning.drop_invalid(df), "brand", "model") == [("真", "m"), ("真", "真")]


def test_fills(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("b", "m", 4.0, 2.0, "x")], NUM)
    assert rows(cleaning.fill_defaults(df), *SALES.required)[1] == ("未知品牌", "未知车型", 0.0, 0.0, "油车")
    got = rows(cleaning.fill_custom(df, {"brand": "B", "sales_volume": "12", "sales_price": "?"}), *SALES.required)
    assert got[0] == ("B", "m", 12.0, 2.0, "x")
    assert cleaning.count_missing(df).first()["rows_with_missing"] == 1
    assert cleaning.drop_missing(df).count() == 1


def messy(sales):
    good = [(f"b{i % 3}", f"m{i}", str(100 + i), f"{10 + i % 7}", "ev" if i % 2 else " 汽油") for i in range(40)]
    bad = [("b1", "m1", "101", "11", "ev"),                      # copy
           (None, "x1", "abc", "12", "混动"),                     # missing brand and volume
           ("b2", "x2", "103", None, None),                      # missing price and category
           ("b2", "x3", "99999", "12", "混动"),                   # outlier
           ("unknown", "x4", "104", "12", "混动")]                # invalid
    return sales(good + bad)


def test_auto_clean(spark, sales):
    rows_, report = auto_clean(messy(sales))
    r = report.first().asDict()
    assert (r["original_rows"], r["duplicates_removed"], r["final_rows"], r["invalid_removed"]) == (45, 1, 43, 1)
    assert r["missing_filled"] == {"sales_volume": 1, "sales_price": 1, "brand": 1, "energy_type": 1}
    assert r["outliers_handled"] == {"sales_volume": 1}
    assert [w[:2] for w in r["warnings"]] == ["删除", "sa", "删除"]
    assert r["columns_original"] == r["columns_final"] == SALES.required
    out = rows_.cache()
    assert out.filter(" or ".join(f"{c} is null" for c in SALES.required)).count() == 0
    assert {x[0] for x in out.select("energy_type").distinct().collect()} == {"油车", "电车", "混动"}
    assert out.agg(F.max("sales_volume")).first()[0] < 200
    again = auto_clean(rows_).report.first()
    assert (again["duplicates_removed"], again["invalid_removed"], again["missing_filled"]) == (0, 0, {})
    assert again["warnings"][-2:] == ["未检测到缺失值", "未检测到异常值"]
    totals = report_totals(report).first().asDict()
    assert totals == {"original_rows": 45, "missing_filled": 4, "outliers_detected": 1, "rows_removed": 1,
                      "invalid_removed": 1, "final_rows": 43}


def test_auto_clean_equals_step_by_step(spark, sales):
    """The fused statistics give what separate passes give."""
    df = messy(sales)
    steps = cleaning.drop_copies(cleaning.coerce_measures(df))
    steps = cleaning.fill_mode(cleaning.fill_median(steps, SALES.numeric), SALES.text)
    steps = cleaning.repair_zscore(steps, SALES.numeric)
    steps = cleaning.drop_invalid(cleaning.standardise_category(steps))
    assert rows(auto_clean(df).rows, *SALES.required) == rows(steps, *SALES.required)


@pytest.mark.parametrize("groups", [None, 2])
def test_auto_clean_per_batch_equals_each_batch_alone(spark, sales, groups):
    df = messy(sales)
    both = df.withColumn("batch", F.lit("p")).unionByName(
        df.withColumn("batch", F.lit("q")).withColumn("sales_price", F.col("sales_price") * 2))
    done = auto_clean(both, by=["batch"], groups=groups)
    for name in "pq":
        alone = auto_clean(both.filter(F.col("batch") == name))
        assert rows(done.rows.filter(F.col("batch") == name), *SALES.required) == rows(alone.rows, *SALES.required)
        mine = done.report.filter(F.col("batch") == name).drop("batch", "columns_original", "columns_final").first()
        assert mine == alone.report.drop("columns_original", "columns_final").first()


def test_statistics_and_rows_share_one_shuffle(spark, sales):
    report = auto_clean(messy(sales)).report
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Reused" in plan or "ReusedExchange" in plan


def test_other_roles(spark):
    roles = Roles("shop", "article", "units", "cost", "kind", "day")
    df = spark.createDataFrame([("s", f"a{i}", str(i), "2", "ev", "2024-1-2") for i in range(6)],
                               "shop string, article string, units string, cost string, kind string, day string")
    out = auto_clean(df, roles).rows
    assert out.columns == df.columns and str(out.first()["day"]) == "2024-01-02"


def test_all_missing_columns(spark, sales):
    out = auto_clean(sales([(f"b{i}", "m", None, None, None) for i in range(4)])).rows
    assert rows(out, "sales_volume", "sales_price", "energy_type") == [(0.0, 0.0, "未知")] * 4


def test_empty_input(spark, sales):
    done = auto_clean(sales([]))
    r = done.report.first()
    assert (r["original_rows"], r["final_rows"], r["warnings"]) == (0, 0, ["输入 DataFrame 为空"])
    assert done.rows.count() == 0
    assert interactive_clean(sales([]), {"missing_action": "drop"}).report.first()["warnings"] == ["输入 DataFrame 为空"]


def test_interactive_default(spark, sales):
    done = interactive_clean(messy(sales), {})
    r = done.report.first()
    assert r["missing_count_total"] == 2 and r["missing_action"] == "default"
    assert {k: tuple(v) for k, v in r["missing_filled"].items()} == {
        "brand": (1, "未知品牌"), "sales_volume": (1, "0.0"), "sales_price": (1, "0.0"), "energy_type": (1, "油车")}
    assert r["final_rows"] == 44 and done.rows.count() == 44
    assert r["outliers_detail"]["sales_volume"]["method"] == "zscore"


def test_interactive_drop(spark, sales):
    done = interactive_clean(messy(sales), {"missing_action": "drop"})
    r = done.report.first()
    assert (r["missing_dropped"], r["final_rows"], r["missing_filled"]) == (2, 42, {})
    assert done.rows.count() == 42
    assert interactive_clean(done.rows, {"missing_action": "drop"}).report.first()["warnings"][:2] == [
        "未检测到缺失值，无需舍弃", "未检测到缺失值"]


def test_interactive_custom_with_range(spark, sales):
    config = {"missing_action": "custom", "custom_fill": {"sales_volume": "oops", "sales_price": 3, "brand": "B"},
              "outlier_ranges": {"sales_volume": {"min": None, "max": 130}}}
    r = interactive_clean(messy(sales), config).report.first()
    assert tuple(r["missing_filled"]["sales_price"]) == (1, "3.0")
    assert tuple(r["missing_filled"]["brand"]) == (1, "B")
    d = r["outliers_detail"]["sales_volume"]
    assert (d["min"], d["max"], d["method"], d["count"]) == ("不限", "130.0", "range", 10)
    # the price filled with 3 is itself far off the others (10 to 16) and is repaired by z-score
    assert (r["outliers_detail"]["sales_price"]["method"], r["outliers_detail"]["sales_price"]["count"]) == ("zscore", 1)
    assert r["outliers_handled"] == r["outliers_detected"] == 11


def test_interactive_ignores_ids(spark, sales):
    df = sales([("a", "m", "1", "1", "ev")] * 3).withColumn("id", F.monotonically_increasing_id())
    assert interactive_clean(df, {}).rows.count() == 3
    assert interactive_clean(df, {}, ignore=["id"]).rows.count() == 1
