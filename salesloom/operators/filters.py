"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import dates, numbers, text
from salesloom.roles import SALES, Roles


def rows_of_tenant(df: DataFrame, tenant, roles: Roles = SALES, tenant_col: str = "user_id") -> DataFrame:
    """One tenant's rows in display order."""
    return df.filter(F.col(tenant_col) == tenant).orderBy(roles.dim, roles.item)


def filter_category(df: DataFrame, category: str = "all", roles: Roles = SALES) -> DataFrame:
    """Rows of one category; ``all`` keeps everything."""
    return df if category == "all" else df.filter(F.col(roles.cat) == category)


def filter_items(df: DataFrame, selected: Sequence[str], roles: Roles = SALES) -> DataFrame:
    """Rows of the selected entities; an empty selection keeps everything."""
    name = text.display_name(F.col(roles.dim), F.col(roles.item))
    return df.filter(name.isin(list(selected))) if selected else df


def filter_items_by_table(df: DataFrame, selection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for a selection too long to list: a semi join on ``keys``."""
    return df.join(selection.select(*keys), list(keys), "left_semi")


def valid_rows(df: DataFrame, roles: Roles = SALES) -> DataFrame:
    """Rows whose measures are both numbers above zero."""
    return df.filter(numbers.valid_measures(F.col(roles.qty).try_cast("double"),
                                            F.col(roles.price).try_cast("double")))


def resolve_user(users: DataFrame, wanted) -> DataFrame:
    """A user by id or, failing that, by name; a number is tried as an id first."""
    hit = F.col("username") == F.lit(str(wanted))
    by_id = F.lit(False)
    if str(wanted).isdigit():
        by_id = F.col("user_id") == F.lit(int(wanted))
    return users.filter(by_id | hit).orderBy(by_id.desc(), "user_id").limit(1)


def owned_upload(uploads: DataFrame, user_id: int, upload_id: int) -> DataFrame:
    """One upload, only if it belongs to the user."""
    return uploads.filter((F.col("upload_id") == upload_id) & (F.col("user_id") == user_id))


def revenue(roles: Roles = SALES) -> Column:
    return F.col(roles.qty) * F.col(roles.price)


def sales_chart(df: DataFrame, roles: Roles = SALES, keep: Sequence[str] = ()) -> DataFrame:
    """Name, volume and price of every row, largest volume first."""
    return (
        df.select(
            *keep, text.display_name(F.col(roles.dim), F.col(roles.item)).alias("name"),
            F.col(roles.qty).alias("volume"), F.col(roles.price).alias("price"),
        )
        .withColumn("label", text.ellipsis(F.col("name")))
        .orderBy(F.desc("volume"), "name", "price")
    )


def detail_columns(df: DataFrame, roles: Roles = SALES, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *roles.required)


def scatter(df: DataFrame, roles: Roles = SALES, keep: Sequence[str] = ()) -> DataFrame:
    """Price and whole-unit volume of every row; missing values plot as zero."""
    return df.select(
        *keep,
        numbers.or_zero(F.col(roles.price).cast("double")).alias("price"),
        numbers.stored_qty(F.col(roles.qty)).alias("volume"),
    )


def scatter_rounded(df: DataFrame, roles: Roles = SALES, keep: Sequence[str] = ()) -> DataFrame:
    """Scatter of the valid rows for the correlation view."""
    return valid_rows(df, roles).select(
        *keep,
        numbers.rounded(F.col(roles.price), 1).alias("price"),
        numbers.rounded(F.col(roles.qty), 0).cast("bigint").alias("sales"),
        F.coalesce(F.col(roles.cat), F.lit(fixed.UNKNOWN_CATEGORY)).alias("energy"),
    )


def records(df: DataFrame) -> DataFrame:
    """Every column as display text: days as ``yyyy-MM-dd``, missing as the empty string."""
    out = []
    for c, kind in df.dtypes:
        value = dates.day_text(F.col(c)) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c)
        out.append(text.printable(value).alias(c))
    return df.select(*out)
