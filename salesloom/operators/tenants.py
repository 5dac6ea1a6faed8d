"""Joins between users, uploads and archived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.roles import SALES, Roles


def active_uploads(users: DataFrame, uploads: DataFrame) -> DataFrame:
    """Every user with the batch in effect, if any."""
    heads = uploads.select(F.col("upload_id").alias("_id"), "filename", "record_count")
    return (
        users.join(heads, F.col("active_upload_id") == F.col("_id"), "left")
        .select("user_id", "username", "active_upload_id", "filename", "record_count")
    )


def all_uploads(uploads: DataFrame, users: DataFrame) -> DataFrame:
    """Every upload with its owner's name, newest first."""
    return (
        uploads.join(users.select("user_id", "username"), "user_id")
        .select(*uploads.columns, "username")
        .orderBy(F.desc("created_at"), F.desc("upload_id"))
    )


def upload_list(uploads: DataFrame, archive: DataFrame, users: DataFrame,
                user_id: int | None = None) -> DataFrame:
    """Upload history with the number of archived rows and whether the batch is in effect.

    The archive is counted per batch before the join, so the join is one row to one row.
    """
    if user_id is not None:
        uploads = uploads.filter(F.col("user_id") == user_id)
    counted = archive.groupBy("upload_id").agg(F.count(F.lit(1)).alias("archived_count"))
    owner = users.select("user_id", "username", "active_upload_id")
    return (
        uploads.join(counted, "upload_id", "left").join(owner, "user_id")
        .select(
            *uploads.columns, "username",
            F.coalesce("archived_count", F.lit(0)).alias("archived_count"),
            F.col("upload_id").eqNullSafe(F.col("active_upload_id")).alias("is_active"),
        )
        .orderBy(F.desc("created_at"), F.desc("upload_id"))
    )


def user_totals(users: DataFrame, vehicles: DataFrame, uploads: DataFrame) -> DataFrame:
    """Rows and uploads of every user, newest user first; both sides are counted before joining."""
    rows = vehicles.groupBy("user_id").agg(F.count(F.lit(1)).alias("vehicle_count"))
    batches = uploads.groupBy("user_id").agg(F.count(F.lit(1)).alias("upload_count"))
    return (
        users.join(rows, "user_id", "left").join(batches, "user_id", "left")
        .select("user_id", "username", "created_at",
                F.coalesce("vehicle_count", F.lit(0)).alias("vehicle_count"),
                F.coalesce("upload_count", F.lit(0)).alias("upload_count"))
        .orderBy(F.desc("created_at"), "user_id")
    )


def user_statistics(users: DataFrame, vehicles: DataFrame, uploads: DataFrame,
                    roles: Roles = SALES) -> DataFrame:
    """Rows, distinct entity groups and uploads of every user.

    Distinct groups are counted over (user, group) cells, so a user with very many rows is reduced
    by many tasks first.
    """
    cells = vehicles.groupBy("user_id", roles.dim).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("user_id").agg(F.sum("n").alias("v"), F.count(roles.dim).alias("b"))
    batches = uploads.groupBy("user_id").agg(F.count(F.lit(1)).alias("u"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        users.join(rows, "user_id", "left").join(batches, "user_id", "left")
        .select("user_id", "username", zero("v").alias("vehicle_count"),
                zero("b").alias("brand_count"), zero("u").alias("upload_count"))
        .orderBy("user_id")
    )


def current_rows(archive: DataFrame, users: DataFrame) -> DataFrame:
    """Rows in effect: the archived rows of every user's active batch."""
    active = users.filter(F.col("active_upload_id").isNotNull()).select(
        "user_id", F.col("active_upload_id").alias("upload_id"))
    return archive.join(active, "upload_id").select("user_id", *archive.columns)


def owned(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """The requests (upload_id, user_id) that name an upload of that very user."""
    return requests.join(uploads.select("upload_id", "user_id"), ["upload_id", "user_id"], "left_semi")


def without(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of batches that are not asked to be deleted."""
    return df.join(requests.select("upload_id"), "upload_id", "left_anti")
