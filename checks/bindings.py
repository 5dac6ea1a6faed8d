"""The given tables seen as sales tables.

``facts`` are clean sales rows, ``raw`` the same made dirty by fixed rules, ``vehicles`` the archived
rows with owner and batch, ``users`` and ``uploads`` the batch log.  ``checks.oracles`` states the
same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions import dates, text

RAW_SPELLING = {
    "ECONOMY": "汽油", "SMALL": " 油车", "MEDIUM": "ev", "LARGE": "纯电动", "PROMO": "插混", "STANDARD": "混动",
}
IDS = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    kind = None
    for name, spelling in RAW_SPELLING.items():
        hit = F.col("p_type") == name
        kind = F.when(hit, spelling) if kind is None else kind.when(hit, spelling)
    y, m, d = (f("l_shipdate").cast("string") for f in (F.year, F.month, F.dayofmonth))
    slot = F.col("l_linenumber") % 3
    day = (
        F.when(slot == 0, F.concat(y, F.lit("/"), m, F.lit("/"), d))
        .when(slot == 1, F.concat(y, F.lit("年"), m, F.lit("月")))
        .otherwise(F.concat(y, F.lit("-"), m, F.lit("-"), d))
    )
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "l_orderkey", "l_linenumber",
        F.col("p_brand").alias("brand"), F.col("p_name").alias("model"),
        F.col("l_quantity").alias("sales_volume"),
        (F.floor(F.col("l_extendedprice") / 10 + 0.5) / 100).alias("sales_price"),
        kind.alias("energy_type"), day.alias("sale_date"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with missing and unusable values, outliers, unknown entities and duplicates."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    every = lambda c, n: c % n == 0
    dirty = facts(spark, sf_dir).select(
        "l_orderkey", "l_linenumber",
        F.when(every(key, 97), F.lit(None)).when(every(key, 301), "unknown").otherwise(F.col("brand")).alias("brand"),
        "model",
        F.when(every(key + line, 101), "abc").otherwise(F.col("sales_volume").cast("string")).alias("sales_volume"),
        F.when(every(key, 89), F.lit(None)).when(every(key, 211), F.col("sales_price") * 50)
        .otherwise(F.col("sales_price")).alias("sales_price"),
        "energy_type", "sale_date",
    )
    copies = F.when(every(key, 50), 2).otherwise(1)
    return dirty.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with numeric measures and without duplicates."""
    from salesloom.operators import cleaning

    return cleaning.drop_copies(cleaning.coerce_measures(raw(spark, sf_dir)))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("record_count"),
        F.col("o_orderdate").cast("date").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; the batch in effect is the one with the highest number.

    Customers in arrears have none.
    """
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    customers = table(spark, sf_dir, "customer")
    return customers.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("created_at"),
        F.when(F.col("c_acctbal") >= 0, F.col("last")).alias("active_upload_id"),
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived rows per batch, with standard categories and dates."""
    return facts(spark, sf_dir).select(
        F.col("l_orderkey").alias("upload_id"), "brand", "model",
        F.col("sales_volume").cast("bigint").alias("sales_volume"), "sales_price",
        text.standard_category(F.col("energy_type")).alias("energy_type"),
        dates.parse_date(F.col("sale_date")).alias("sale_date"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived rows with their owner."""
    owner = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("user_id"))
    return archive(spark, sf_dir).join(owner, "upload_id").select(
        "user_id", "upload_id", "brand", "model", "sales_volume", "sales_price", "energy_type", "sale_date")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value")
