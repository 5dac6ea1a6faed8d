"""Text report, one row per tenant, written from aggregates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import numbers
from salesloom.operators import aggregates
from salesloom.operators.cleaning import join_on
from salesloom.operators.spread import shared, top_per_group
from salesloom.roles import SALES, Roles

# --- fixed values: wording of the report
REPORT = """## 汽车销售数据综合分析报告

### 一、数据概况
本次分析共覆盖 {total} 条车辆销售记录，涉及 {dims} 个汽车品牌。

### 二、销量分析
- **销量冠军**: {top_car}，表现最为突出
- **最畅销车型类别**: {top_item}
- **车型矩阵最丰富品牌**: {top_dim}，产品线覆盖最广

### 三、品牌格局
销量排名前五品牌为: {leaders}。头部品牌集中度较高，呈现明显的马太效应。

### 四、价格分析
- **平均售价**: {avg_price}万元
- **价格分布**: {prices}
- 整体市场价格带分布合理，覆盖经济型到豪华型各细分市场。

### 五、能源结构
- 燃油车占比: {oil}%
- 电动车占比: {electric}%
- 混动车型占比: {hybrid}%

### 六、趋势研判
{trend}

### 七、建议
1. 重点关注{top_dim}品牌动向，其产品策略对市场影响较大
2. {avg_price}万元价位段为兵家必争之地，建议加强该区间产品布局
3. {advice}"""
TREND_ELECTRIC = "当前新能源渗透率已达{pct}%，市场正加速向电动化转型。"
TREND_FUEL = "传统燃油车仍占据主导地位，但新能源转型趋势明显。"
ADVICE_EARLY = "抓住新能源转型窗口期，加大电动化投入"
ADVICE_LATE = "新能源已成主流，需关注充电基础设施配套及二手车残值管理"
TREND_LIMIT = 30
ADVICE_LIMIT = 50


def _render(template: str, values: dict):
    """Column that fills the named places of a text with columns."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def report(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ("user_id",),
           tenants: DataFrame | None = None, leaders: int = 5) -> DataFrame:
    """Report text per group.  With ``tenants``, groups without rows get an error text instead."""
    by = list(by)
    head = aggregates.overview(df, roles, by)
    # the same entity level as in the overview, so it is computed once
    level = shared(aggregates.entity_level(df, roles, by))
    sums = level.groupBy(*by, roles.dim).agg(F.sum("volume").alias("v"))
    first = top_per_group(sums, by, [F.desc("v"), F.asc(roles.dim)], leaders)
    # at most `leaders` entries per group
    entry = F.struct("rank", F.concat(F.col(roles.dim), F.lit("("), F.col("v").cast("bigint").cast("string"),
                                      F.lit("辆)")).alias("t"))
    listed = first.groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), ", ").alias("leaders"))
    bins = aggregates.price_histogram(df, roles, by).filter(F.col("rows") > 0)
    bin_entry = F.struct("bin", F.concat("label", F.lit("("), F.col("rows").cast("string"), F.lit("款)")).alias("t"))
    prices = bins.groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(bin_entry)), lambda e: e["t"]), ", ").alias("prices"))
    wide = join_on(join_on(head, listed, by, "left"), prices, by, "left")
    if tenants is not None:
        wide = join_on(tenants.select(*by), wide, by, "left")
    new_energy = numbers.rounded(F.col("electric_ratio") + F.col("hybrid_ratio"), 1)
    trend = F.when(new_energy > TREND_LIMIT, _render(TREND_ELECTRIC, {"pct": new_energy})).otherwise(TREND_FUEL)
    advice = F.when(new_energy < ADVICE_LIMIT, ADVICE_EARLY).otherwise(ADVICE_LATE)
    body = _render(REPORT, {
        "total": F.col("total_rows"), "dims": F.col("dim_count"), "top_car": F.col("top_volume_name"),
        "top_item": F.col("top_item_by_rows"), "top_dim": F.col("top_dim_by_rows"),
        "leaders": F.coalesce("leaders", F.lit("")), "prices": F.coalesce("prices", F.lit("")),
        "avg_price": F.col("avg_price"), "oil": F.col("oil_ratio"), "electric": F.col("electric_ratio"),
        "hybrid": F.col("hybrid_ratio"), "trend": trend, "advice": advice,
    })
    some = F.coalesce(F.col("total_rows") > 0, F.lit(False))
    return wide.select(*by, some.alias("success"), F.when(~some, fixed.MSG_UPLOAD_FIRST).alias("message"),
                       F.when(some, body).alias("report"))


def brand_sales_json(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ("user_id",), n: int = 10) -> DataFrame:
    """The ``n`` largest entity groups of every group as a JSON list."""
    sums = df.groupBy(*by, roles.dim).agg(F.sum(roles.qty).cast("bigint").alias("sales"))
    first = top_per_group(sums, by, [F.desc("sales"), F.asc(roles.dim)], n)
    items = F.sort_array(F.collect_list(F.struct("rank", F.struct(F.col(roles.dim).alias("brand"), "sales").alias("e"))))
    return first.groupBy(*by).agg(F.to_json(F.transform(items, lambda x: x["e"])).alias("brand_sales"))
