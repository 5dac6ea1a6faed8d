"""URL filters by a sort-merge range join, with DataFrame operations only.

A host's labels are turned round (``a.example.org`` is ``org/example/a/``), so that a host and all
its subdomains are one interval of sorted keys; paths that begin alike are one interval as they
are.  Intervals of prefixes nest.  Rules become marks where an interval opens and where it closes;
each mark carries the stack of intervals open after it, which depends on the rules alone.  URLs
and marks are sorted together over range partitions, and every URL takes the stack of the last mark
before it, from its own partition or carried over from the partitions before.

Two sweeps: over hosts, which gives each URL the rule hosts it falls under (at most one per
label), and over (rule host, path), whose innermost open rule has the longest fitting path.

Defined results: a null URL and one without ``://`` have empty host and path and no rule; rules
with a null host or path fit nothing; of rules with the same host and path the verdict ``block``
counts; repeated URLs are judged each on its own; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.session import staged

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
OTHERWISE = "allow"
#: Sorts after every character that a key can have.
LAST = "\U0010ffff"
#: Stands between rule host and path in the keys of the second sweep.
BETWEEN = "\x00"


def fold_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return fold_ascii(host), path


def turned(host: Column) -> Column:
    """The labels in reverse order, each closed by a slash, which no host has."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def nested_stacks(intervals: DataFrame, key: str, value: str) -> DataFrame:
    """Marks ``(key, stack)`` of intervals given by distinct prefixes.

    The stack after a prefix opens is the values of all prefixes of that prefix, outermost first;
    after it closes, the same without its own.  Prefixes are found by equality with every
    beginning of a key, so the work is linear in the rules' length.
    """
    own = intervals.select(F.col(key).alias("own"), F.col(value).alias("value"))
    begun = own.select("own", F.explode(F.sequence(F.lit(1), F.length("own"))).alias("size"))
    begun = begun.withColumn("begin", F.substring("own", F.lit(1), F.col("size")))
    outer = intervals.select(F.col(key).alias("begin"), F.col(value).alias("held"))
    found = begun.join(outer, "begin").groupBy("own").agg(F.sort_array(F.collect_list(F.struct("size", "held"))).alias("s"))
    stacks = found.select("own", F.transform("s", lambda x: x["held"]).alias("stack"))
    return stacks.select(F.explode(F.array(
        F.struct(F.col("own").alias("key"), F.col("stack")),
        F.struct(F.concat("own", F.lit(LAST)).alias("key"),
                 F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack")))).alias("m")).select("m.key", "m.stack")


def sweep(points: DataFrame, marks: DataFrame, key: str, into: str) -> DataFrame:
    """``points`` with the stack of the last mark at or before their ``key`` (null before any).

    Points and marks are dealt over range partitions; equal keys may fall into several.  Only the
    last mark of each partition is carried on, one row per partition.
    """
    tie = F.xxhash64(*[F.col(c) for c in points.columns])
    rows = points.select(F.col(key).alias("_key"), F.lit(1).alias("_kind"), tie.alias("_tie"),
                         F.struct(*points.columns).alias("_point"), F.lit(None).cast(marks.schema["stack"].dataType).alias("_stack"))
    opened = marks.select(F.col("key").alias("_key"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"),
                          F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"), F.col("stack").alias("_stack"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.union(opened).repartitionByRange(parts, "_key", "_kind", "_tie")
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "swept")

    last = dealt.filter("_kind = 0").groupBy("_part").agg(F.max_by(F.struct("_stack"), "_key").alias("_last"))
    everywhere = points.sparkSession.range(parts).select(F.col("id").cast("int").alias("_part")).join(last, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = everywhere.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))

    inside = Window.partitionBy("_part").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("_seen", F.last(F.when(F.col("_kind") == 0, F.struct("_stack")), ignorenulls=True).over(inside))
    found = seen.filter("_kind = 1").join(F.broadcast(carried), "_part")
    stack = F.coalesce("_seen", "_carried")["_stack"]
    return found.select("_point.*", stack.alias(into))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block).  A rule fits its host and all
    subdomains where the path begins with its own; the longest fitting rule decides.
    ``pages`` must not have columns of the four names; ``select`` what is needed before.
    """
    host, path = host_and_path(F.col(url_col))
    named = staged(pages.select(*pages.columns, host.alias("host"), path.alias("path")), "urls")
    places = named.select("host", "path").filter("host != ''").distinct().withColumn("_host", turned(F.col("host")))
    rules = (rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
             .groupBy(fold_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
             .agg(F.max("verdict").alias("rule_verdict")).withColumn("_rule_host", turned(F.col("rule_host"))))
    rules = staged(rules, "rules")

    hosts = nested_stacks(rules.select("_rule_host").distinct().withColumn("held", F.col("_rule_host")), "_rule_host", "held")
    under = sweep(places, hosts, "_host", "_under").select("host", "path", F.explode("_under").alias("_rule_host"))
    under = under.withColumn("_place", F.concat("_rule_host", F.lit(BETWEEN), "path"))
    rule = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), "rule_host", "rule_path", "rule_verdict")
    prefixes = rules.select(F.concat("_rule_host", F.lit(BETWEEN), "rule_path").alias("_prefix"), rule.alias("held"))
    fitting = sweep(under, nested_stacks(prefixes, "_prefix", "held"), "_place", "_rules")
    best = (fitting.filter(F.size("_rules") > 0).groupBy("host", "path")
            .agg(F.max(F.element_at("_rules", -1)).alias("_best")))
    judged = named.join(best, ["host", "path"], "left")
    return judged.select(
        *pages.columns, "host", "path",
        F.concat("_best.rule_host", "_best.rule_path").alias("rule"),
        F.coalesce("_best.rule_verdict", F.lit(otherwise)).alias("verdict"))
