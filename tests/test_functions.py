import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import bins, dates, numbers, text
from salesloom.functions.student import corr_p_value, incomplete_beta


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_numeric_text(spark):
    given = ["12.5", " 12 ", "abc", "", "1,200", "nan", "inf", "12d", None, "-3e2", "+.5", "1e999"]
    assert column(spark, given, "string", numbers.to_number) == [
        12.5, 12.0, None, None, None, None, None, None, None, -300.0, 0.5, None]


def test_measure_drops_nan_and_infinity(spark):
    assert column(spark, [1.0, math.nan, math.inf, -math.inf, None], "double", numbers.measure) == [
        1.0, None, None, None, None]


@pytest.mark.parametrize("given, wanted", [
    ("2024-3-5", "2024-03-05"), ("2024/03/05", "2024-03-05"), ("2024.3.5", "2024-03-05"), ("2024-3", "2024-03-01"),
    ("2024/12", "2024-12-01"), ("2024.7", "2024-07-01"), ("2024年3月", "2024-03-01"), ("2024年3月5日", "2024-03-05"),
    ("3/5/2024", "2024-03-05"), ("13/02/2024", "2024-02-13"), ("2024-13-45", None), ("2024", "2024-01-01"),
    ("20240305", "2024-03-05"), ("2024-03-05 10:11:12", "2024-03-05"), ("2024-03-05T10:11:12", "2024-03-05"),
    ("Mar 5, 2024", "2024-03-05"), ("Mar 5 2024", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("  2024-3-5 ", "2024-03-05"),
    ("2024-003-05", None), ("soon", None), ("nan", None), (None, None),
])
def test_dates(spark, given, wanted):
    [got] = column(spark, [given], "string", dates.parse_date)
    assert (str(got) if got else None) == wanted


def test_date_parse_is_idempotent(spark):
    texts = ["2024-3-5", "2024年3月", "13/02/2024"]
    once = column(spark, texts, "string", dates.parse_date)
    assert column(spark, [str(d) for d in once], "string", dates.parse_date) == once


def test_category_spellings(spark):
    every = [(w, name) for name, words in fixed.CATEGORY_SPELLINGS.items() for w in words]
    assert column(spark, [f" {w} " for w, _ in every], "string", text.standard_category) == [n for _, n in every]
    assert column(spark, ["EV", " 氢能 "], "string", text.standard_category) == ["EV", "氢能"]
    assert column(spark, ["EV"], "string", lambda c: text.standard_category(c, ignore_case=True)) == ["电车"]


def test_markers(spark):
    kinds = ["纯电动", "油电混合", "DM-i", "PHEV", "油车", None]
    assert column(spark, kinds, "string", text.is_electric) == [1, 1, 0, 0, 0, 0]
    assert column(spark, kinds, "string", text.is_hybrid) == [0, 1, 1, 1, 0, 0]


def test_labels(spark):
    assert column(spark, ["0123456789", "0123456789A"], "string", text.ellipsis) == ["0123456789", "012345678..."]
    df = spark.createDataFrame([("一二三四五", "abcdefgh"), ("a", "")], "b string, m string")
    got = df.select(text.compact_label(F.col("b"), F.col("m")), text.display_name(F.col("b"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("一二三四abcdef", "一二三四五 abcdefgh"), ("a", "a")]


def test_wording(spark):
    assert column(spark, [0.9, -0.8, 0.5, -0.3, 0.29, 0.0], "double", text.strength_word) == [
        "强正相关", "强负相关", "中等正相关", "弱负相关", "几乎无线性相关", "几乎无线性相关"]
    assert column(spark, [0.0001, 0.001, 0.04999], "double", numbers.p_text) == ["<0.001", "0.001", "0.05"]
    df = spark.createDataFrame([(1, 30.0), (2, 30.0), (2, 11.9), (3, 20.0)], "r int, p double")
    assert [r[0] for r in df.select(text.segment_label(F.col("r"), F.col("p"))).collect()] == [
        "簇1·高销量主力", "簇2·高端车型", "簇2·经济车型", "簇3·中端均衡"]


def test_rounding_ignores_summation_noise(spark):
    assert column(spark, [10.015, 10.014999999999999], "double", lambda c: numbers.rounded(c, 2)) == [10.02, 10.02]


def test_storage_form(spark):
    assert column(spark, [1.9, None, -1.9], "double", numbers.stored_qty) == [1, 0, -1]
    assert column(spark, [1.005, None], "double", numbers.stored_price) == [1.01, 0.0]
    assert column(spark, [1234567], "long", numbers.grouped_digits) == ["1,234,567"]


def test_season(spark):
    assert column(spark, [1, 2, 12, 13, None], "int", numbers.season_factor) == [0.95, 0.55, 1.18, 1.005, 1.005]


def test_bin_edges(spark):
    ids = column(spark, [0.0, 9.99, 10.0, 50.0, 1e9, -1.0, None], "double",
                 lambda c: bins.bin_id(c, fixed.PRICE_BINS))
    assert ids == [0, 0, 1, 4, 4, None, None]


def test_incomplete_beta_known_values():
    assert incomplete_beta([1, 2, 0.5], [1, 3, 0.5], [0.3, 0.5, 0.5]) == pytest.approx([0.3, 0.6875, 0.5], abs=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 400), st.floats(0.5, 50), st.floats(0.001, 0.999))
def test_incomplete_beta_symmetry(a, b, x):
    assert incomplete_beta([a], [b], [x])[0] == pytest.approx(1 - incomplete_beta([b], [a], [1 - x])[0], abs=1e-9)


def test_incomplete_beta_matches_integral():
    grid = np.linspace(0, 0.37, 200001)
    dens = grid ** 2.5 * (1 - grid) ** 1.25
    area = np.sum((dens[1:] + dens[:-1]) / 2) * (grid[1] - grid[0])
    full = math.gamma(3.5) * math.gamma(2.25) / math.gamma(5.75)
    assert incomplete_beta([3.5], [2.25], [0.37])[0] == pytest.approx(area / full, abs=1e-8)


def test_p_values_in_the_plan_equal_the_numpy_ones(spark):
    rs = [0.0, 1e-4, 0.01, 0.05, 0.2, 0.5, 0.77, 0.95, 0.999999, 1.0]
    cases = [(s * r, n) for r in rs for s in (1, -1) for n in (3, 4, 5, 7, 12, 30, 101, 1000, 60_000, 10_000_000)]
    got = spark.createDataFrame(cases, "r double, n long").select("r", "n", corr_p_value(F.col("r"), F.col("n")).alias("p")).collect()
    want = incomplete_beta([(g["n"] - 2) / 2 for g in got], [0.5] * len(got), [1 - g["r"] ** 2 for g in got])
    for g, w in zip(got, want):
        assert g["p"] == pytest.approx(float(w), rel=2e-7, abs=1e-12), g
    tiny = spark.createDataFrame([(1e-9, 10_000_000)], "r double, n long").select(corr_p_value(F.col("r"), F.col("n"))).first()[0]
    assert tiny == pytest.approx(math.erfc(1e-9 * math.sqrt(1e7) / math.sqrt(2)), rel=1e-9)
    odd = spark.createDataFrame([(0.5, 2), (0.5, 0), (None, 9), (0.5, None), (1.5, 9)], "r double, n long")
    assert [r[0] for r in odd.select(corr_p_value(F.col("r"), F.col("n"))).collect()] == [None, None, None, None, 0.0]


def test_p_values_need_no_python(spark):
    plan = spark.createDataFrame([(0.5, 9)], "r double, n long").select(corr_p_value(F.col("r"), F.col("n")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_p_values_of_very_many_groups(spark):
    """A group costs microseconds: 300,000 of them took minutes with the continued fraction."""
    groups = spark.range(300_000).select((F.col("id") % 199 / 200.0).alias("r"), (3 + F.col("id") % 60).alias("n"))
    begun = time.monotonic()
    p = corr_p_value(F.col("r"), F.col("n"))
    low, high, missing = groups.select(p.alias("p")).agg(F.min("p"), F.max("p"), F.count_if(F.col("p").isNull())).first()
    assert time.monotonic() - begun < 20
    assert 0 <= low < 1e-40 and high == pytest.approx(1) and missing == 0


def test_p_values_keep_their_digits_in_the_tail(spark):
    """Closed forms for four and six points: 1 - |r| and 1 - |r| (3 - r^2) / 2."""
    rs = [k / 1000 for k in range(1, 1000, 7)]
    four, six = (spark.createDataFrame([(r, n) for r in rs], "r double, n long").select(
        "r", corr_p_value(F.col("r"), F.col("n")).alias("p")).collect() for n in (4, 6))
    assert [g["p"] for g in four] == pytest.approx([1 - g["r"] for g in four], rel=1e-11)
    assert [g["p"] for g in six] == pytest.approx([(1 - g["r"]) ** 2 * (2 + g["r"]) / 2 for g in six], rel=1e-11)
