"""Building blocks that keep work spread out however the rows fall on the keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesloom.session import staged

# Groups holding more than 1/HOT_SHARE of all rows get their own treatment (with many partitions,
# smaller ones too).  Fewer than HOT_SHARE groups can, so the list of them is safe to broadcast.
HOT_SHARE = 200
SALTS = 4096
# Per-group tables of at most this many rows (some tens of MB) may be broadcast whole.
BROADCAST_GROUPS = 100_000
# Up to this many rows per group, unless set otherwise, Spark cuts groups on the map side of a ranking window.
GROUP_LIMIT_SETTING, GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold", "1000"
MEDIAN_ACCURACY = 10_000


def _same_keys(by: Sequence[str], keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)])


def shared(df: DataFrame) -> DataFrame:
    """Mark a table that one query reads several times.

    Spark runs equal parts of a plan once, but column pruning makes the uses of a table unequal
    first.  The condition is true for every row and needs every column, so all uses stay equal and
    share one scan and one shuffle.
    """
    return df.filter(F.hash(*[F.col(c) for c in df.columns]) >= F.lit(-(2 ** 31)))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_salt(df: DataFrame, salts: int) -> Column:
    """Spreads rows over ``salts`` numbers, equal rows as well.

    The number of the task that holds a row goes in, which a repeated task has again, so rows fall
    the same way when work is lost and done anew.
    """
    return F.pmod(F.xxhash64(*[F.col(c) for c in df.columns], F.spark_partition_id()), F.lit(salts)).cast("int")


def count_groups(df: DataFrame, by: Sequence[str]) -> int:
    """Number of groups, from a scan of the key columns alone (a sketch, good to a few percent)."""
    key = F.xxhash64(*[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
    return df.agg(F.approx_count_distinct(key)).first()[0] if by else 1


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], name: str, weight: str,
           groups: int | None = None) -> DataFrame:
    """Add to every row the statistics of its group, packed into the struct column ``name``.

    ``stats`` has one row per group and ``weight`` is its column with the group's row count.

    * No keys: ``stats`` is one aggregate row and comes in as a scalar subquery, without a join.
    * Keys, and the caller knows there are at most ``BROADCAST_GROUPS`` groups (``groups``, for
      example from ``count_groups``): the table is broadcast and the rows are not moved.
    * Keys otherwise: groups with more rows than half a partition's share are served by a broadcast
      of their statistics (by arithmetic at most twice as many as there are partitions); their rows
      are then spread over all partitions of the ordinary equi-join that serves the other groups.
      One pass over ``df``, and no partition holds a hot group.
    """
    packed = F.struct(*[F.col(c) for c in stats.columns if c not in by]).alias(name)
    if not by:
        return df.withColumn(name, stats.select(packed).scalar())

    columns = df.columns
    keys = [f"_key{i}" for i in range(len(by))]
    side = stats.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], packed,
                        F.col(weight).alias("_weight"))
    if groups is not None and groups <= BROADCAST_GROUPS:
        return df.join(F.broadcast(side), _same_keys(by, keys), "left").select(*columns, name)

    side = shared(side)
    total = side.agg(F.sum("_weight").alias("_total")).scalar()
    share = max(HOT_SHARE, 2 * partitions_of(df.sparkSession))
    hot = side.filter(F.col("_weight") * share > total).select(*keys, F.col(name).alias("_hot"))
    cold = side.select(*keys, F.col(name).alias("_cold"), F.lit(0).alias("_slot0"))
    salt = row_salt(df, SALTS) + 1
    tagged = (
        df.join(F.broadcast(hot), _same_keys(by, keys), "left")
        .drop(*keys)
        .withColumn("_slot", F.when(F.col("_hot").isNotNull(), salt).otherwise(0))
    )
    joined = tagged.join(cold, _same_keys(by, keys) & (F.col("_slot") == F.col("_slot0")), "left")
    return joined.select(*columns, F.coalesce("_hot", "_cold").alias(name))


def median_bracket(c: Column, accuracy: int = MEDIAN_ACCURACY) -> Column:
    """Two values around the median, from a mergeable sketch of bounded size.

    The sketch is off by at most 1/accuracy of the rows; the bracket leaves four times that.
    """
    gap = 4.0 / accuracy
    return F.percentile_approx(c, [0.5 - gap, 0.5 + gap], accuracy)


def clipped_median(c: Column, bracket: Column) -> Column:
    """Exact median of ``c`` given a bracket around it.

    Values outside the bracket are moved to its ends, which leaves the median where it is.  The
    exact percentile then only has the few distinct values inside the bracket to keep, not all
    distinct values of the group.  A bracket that missed the median fails the job.
    """
    lo, hi = bracket[0], bracket[1]
    clipped = F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))
    middle = F.floor((F.count(c) - 1) / 2)
    holds = (F.count_if(c < lo) <= middle) & (F.count_if(c > hi) <= middle)
    return F.when(F.count(c) == 0, F.lit(None).cast("double")).when(
        holds, F.percentile(clipped, 0.5)
    ).otherwise(F.raise_error(F.lit("median outside its bracket: raise the accuracy")).cast("double"))


def measure_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                    accuracy: int = MEDIAN_ACCURACY, groups: int | None = None) -> DataFrame:
    """Per group: ``rows``, and for each column ``{c}_n``, ``{c}_avg``, ``{c}_var``, ``{c}_median``.

    Missing values are left out; the variance is the population variance; the median is exact.
    All columns share two passes: one for the brackets, one for everything else.
    """
    by = list(by)
    narrow = df.select(*by, *columns)
    brackets = narrow.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[median_bracket(F.col(c), accuracy).alias(c) for c in columns],
    )
    ready = attach(narrow, brackets, by, "_bracket", "rows", groups)
    return ready.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            e
            for c in columns
            for e in (
                F.count(c).alias(f"{c}_n"),
                F.avg(c).alias(f"{c}_avg"),
                F.var_pop(c).alias(f"{c}_var"),
                clipped_median(F.col(c), F.col("_bracket")[c]).alias(f"{c}_median"),
            )
        ],
    )


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group the most frequent value of each column (smallest of tied ones), as ``{c}_mode``.

    Values of all columns are counted in one pass keyed by value, so a hot group is counted by many
    tasks; only the counts of distinct values meet per group.  A group without any value is absent.
    """
    by = list(by)
    pairs = F.array(*[
        F.struct(F.lit(i).alias("slot"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(columns)
    ])
    counts = (
        df.select(*by, F.explode(pairs).alias("_p"))
        .select(*by, F.col("_p.slot").alias("_slot"), F.col("_p.value").alias("_value"))
        .filter(F.col("_value").isNotNull())
        .groupBy(*by, "_slot", "_value")
        .agg((-F.count(F.lit(1))).alias("_rank"))
    )
    best = F.struct("_rank", "_value")
    return counts.groupBy(*by).agg(*[
        F.min(F.when(F.col("_slot") == i, best))["_value"].alias(f"{c}_mode")
        for i, c in enumerate(columns)
    ])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group, numbered; ``n <= 0`` keeps all rows, sorted, with null numbers.

    Where Spark does not cut each group to ``n`` rows before the shuffle, a first round over salted
    groups does it, so a hot group never meets whole in one task.
    """
    by, order = list(by), list(order)
    if n <= 0:
        return df.orderBy(*by, *order).withColumn(rank, F.lit(None).cast("int"))
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING, str(GROUP_LIMIT))):
        first = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", row_salt(df, partitions_of(df.sparkSession)))
            .withColumn("_first", F.row_number().over(first))
            .filter(F.col("_first") <= n)
            .drop("_salt", "_first")
        )
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def running_start(cells: DataFrame, order: Sequence[str], weight: str, by: Sequence[str] = (),
                  name: str = "start", partitions: int | None = None) -> DataFrame:
    """Sum of ``weight`` over all earlier rows of the same group, in the order of ``order``.

    A prefix sum without a window over a whole group: rows are range-partitioned on keys and
    order, summed inside each range, and shifted by the totals of the earlier ranges.  The ranges
    are written out with the rows, since both passes must see the same ones.  Rows of a group must be
    distinct on ``order``.
    """
    by, order = list(by), list(order)
    spark = cells.sparkSession
    if partitions is None:
        partitions = partitions_of(spark)
    ranged = staged(
        cells.repartitionByRange(partitions, *by, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = (
        Window.partitionBy(*by, "_range").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per group and range: at most (number of ranges + number of groups) rows
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*by, "_range").agg(F.sum(weight).alias("_in_range"))
        .withColumn("_shift", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)))
    )
    keys = [f"_key{i}" for i in range(len(by) + 1)]
    shifts = shifts.select(*[F.col(b).alias(k) for b, k in zip(by + ["_range"], keys)], "_shift")
    local = ranged.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        local.join(shifts, _same_keys(by + ["_range"], keys), "left")
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .drop("_range", "_local", "_shift", *keys)
    )


def unpack(df: DataFrame, struct: str, names: Sequence[str]) -> DataFrame:
    """Turn chosen fields of a struct column into columns and drop the struct."""
    return df.select(
        *[c for c in df.columns if c != struct], *[F.col(f"{struct}.{n}").alias(n) for n in names]
    )
