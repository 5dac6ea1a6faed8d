"""Prefix trie of conversations from vertical bitmaps.

A node of depth d stands for one sequence of first d turns (role and text); its members are the
conversations that begin with it, the root has all.  Conversations with equal turns are one class with
its number of members, so copies are worked on once.

Within a shard classes are numbered by their smallest conversation; for every position and turn there
is a bitset of the classes that have it.  Depth first, the bitset of a node intersected with the bitset
of a turn at the next position is a child: its population, weighted by bit slices of the class sizes,
is the number of members, its lowest bit the smallest member, and the bitset of classes that end
there says which conversations end.

A shard holds whole subtrees of at most ``CLASSES`` classes each.  Nodes with more classes (few: a path
has one more of them only while ``CLASSES`` classes agree) are summed up from the subtrees below by
grouping, so a first turn or a long beginning that most conversations share is spread.

Turns are told apart by 128-bit digests.  Defined results: a null role or text is empty; null turns come
first, turns with one number follow each other by role and digest; rows without a conversation id belong
to no conversation; conversations without turns are members of the root; an empty table gives no rows;
further columns are left out.  Only digests of texts enter Python, so very long texts cost nothing there;
a conversation's turns pass one task in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from salesloom.llm.common import attach_by_key, cells
from salesloom.llm.ordered import batches_of, rows_of, sorted_digest
from salesloom.session import staged

#: Most classes below a node that a shard takes whole, and turns that a shard has on average.
CLASSES, SHARD_TURNS = 256, 1024
ROOT = hashlib.blake2b(b"", digest_size=16).digest()

_PATH = (T.StructType().add("conv_id", T.LongType()).add("depth", T.LongType()).add("node", T.BinaryType()).add("parent", T.BinaryType())
         .add("turn", T.BinaryType()).add("bytes", T.LongType()).add("last", T.BooleanType()))


def _paths(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From rows ``(conv_id, turn digest, bytes)`` in order: the nodes on the way of every conversation.

    A row without a digest, the first of its conversation, stands for the root.
    """
    held = None
    for conv, turn, size in rows:
        if turn is None:
            if held:
                yield (*held, True)
            held = (conv, 0, ROOT, None, None, 0)
        else:
            yield (*held, False)
            node = hashlib.blake2b(held[2] + turn, digest_size=16).digest()
            held = (conv, held[1] + 1, node, held[2], bytes(turn), size)
    if held:
        yield (*held, True)


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows ``(conv_id, depth, node, parent, turn, bytes, last)`` from ``turns`` ``(conv_id, at, role, text)``.

    ``ids`` may name conversations that have no turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("kind"), "at", role.alias("role"),
                        F.unhex(F.md5(said.cast("binary"))).alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    starts = ids.select(F.col("conv_id").cast("long").alias("conv_id")).union(rows.select("conv_id")).distinct().select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["at"].dataType).alias("at"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("bytes"))
    both = rows.unionByName(starts).filter(F.col("conv_id").isNotNull())
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "kind", "at", "role", "turn")
    schema = to_arrow_schema(_PATH)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_paths(rows_of(batches)), schema)

    return ordered.select("conv_id", "turn", "bytes").mapInArrow(walked, _PATH)


# --- one shard ----------------------------------------------------------------------------------------

_NODE = (T.StructType().add("node", T.BinaryType()).add("conv_id", T.LongType()).add("depth", T.LongType()).add("parent", T.BinaryType())
         .add("parent_conv_id", T.LongType()).add("n_convs", T.LongType()).add("n_children", T.LongType()).add("n_leaves", T.LongType())
         .add("saved_tokens", T.LongType()).add("top", T.BooleanType()))


class Shard:
    """Bitsets of the classes of a shard by position and turn."""

    def __init__(self, ways: dict[int, list[tuple]], weights: dict[int, int]):
        """``ways``: per class, named by its smallest conversation, the rows ``(depth, node, parent, turn, bytes)`` in order."""
        self.names = sorted(ways)
        self.ways = [ways[n] for n in self.names]
        self.postings: dict[tuple[int, bytes], int] = {}
        self.alive: dict[int, int] = {}
        self.tops: dict[bytes, int] = {}
        self.slices = [0] * max((weights[n].bit_length() for n in self.names), default=0)
        for k, name in enumerate(self.names):
            bit = 1 << k
            way = self.ways[k]
            self.tops[way[0][1]] = self.tops.get(way[0][1], 0) | bit
            for depth, _, _, turn, _ in way:
                self.postings[depth, turn] = self.postings.get((depth, turn), 0) | bit
                self.alive[depth] = self.alive.get(depth, 0) | bit
            for j in range(weights[name].bit_length()):
                if weights[name] >> j & 1:
                    self.slices[j] |= bit

    def members(self, bits: int) -> int:
        """Population of a bitset, every class counting as often as it has conversations."""
        return sum((bits & s).bit_count() << j for j, s in enumerate(self.slices))

    def nodes(self) -> Iterator[tuple]:
        for top in sorted(self.tops):
            yield from self.subtree(self.tops[top])

    def subtree(self, top: int) -> list[tuple]:
        """The nodes below and with a top, a parent before its children."""
        found, stack = [], [(top, self._row(top, 0), None)]
        while stack:
            bits, (depth, node, parent, _, size), above = stack.pop()
            name, n = self.names[_lowest(bits)], self.members(bits)
            # node, smallest member, depth, parent, place of the parent, members, children, leaves, saved
            place = len(found)
            found.append([node, name, depth, parent, above, n, 0, 0, (n - 1) * size])
            if above is not None:
                found[above][6] += 1
            rest = bits & self.alive.get(depth + 1, 0)
            while rest:
                row = self._row(rest, depth + 1)
                child = bits & self.postings[depth + 1, row[3]]
                stack.append((child, row, place))
                rest &= ~child
        for row in reversed(found):
            row[7] = row[7] or 1
            if row[4] is not None:
                found[row[4]][7] += row[7]
                found[row[4]][8] += row[8]
        return [(r[0], r[1], r[2], r[3], None if r[4] is None else found[r[4]][1], r[5], r[6], r[7], r[8], r[4] is None) for r in found]

    def _row(self, bits: int, depth: int) -> tuple:
        """The row at a depth (0: the first) of the lowest class of a bitset."""
        way = self.ways[_lowest(bits)]
        return way[depth - way[0][0] if depth else 0]


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _shard_nodes(table: pa.Table) -> pa.Table:
    ways: dict[int, list[tuple]] = {}
    weights: dict[int, int] = {}
    names = ("conv_id", "weight", "depth", "node", "parent", "turn", "bytes")
    for conv, weight, *row in zip(*(table.column(n).to_pylist() for n in names)):
        ways.setdefault(conv, []).append(tuple(row))
        weights[conv] = weight
    for way in ways.values():
        way.sort(key=lambda r: r[0])
    schema = to_arrow_schema(_NODE)
    rows = list(Shard(ways, weights).nodes())
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- the trie -----------------------------------------------------------------------------------------


def prefix_nodes(turns: DataFrame, ids: DataFrame, classes: int = CLASSES, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``turns`` has rows ``(conv_id, at, role, text)``, in the order of ``at``; ``ids`` all conversations.
    ``n_leaves`` and ``saved_tokens`` are sums over the subtree; a node saves its last text for all members but one.
    ``ends_sha256`` is the digest of the members that end there, ascending, joined by commas.
    """
    ways = staged(paths(turns, ids), "ways")
    last = ways.filter("last")
    firsts = last.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")).drop("node")
    # one conversation of each class goes on
    kept = ways.join(firsts, "conv_id").select("conv_id", "depth", "node", "parent", "turn", "bytes", "weight")
    counts = kept.filter("depth > 0").groupBy("node").agg(F.count(F.lit(1)).alias("n_classes"), F.count(F.lit(1)).alias("_n"))
    below = attach_by_key(kept.filter("depth > 0"), counts, "node", "_n")
    own = Window.partitionBy("conv_id")
    top = F.min(F.when(F.col("n_classes") <= classes, F.struct("depth", "node"))).over(own)
    above = kept.filter("depth = 0").withColumn("n_classes", F.lit(None).cast("long"))
    rows = staged(above.unionByName(below).withColumn("top", top["node"]), "nodes")

    lower = rows.filter(F.col("n_classes") <= classes)
    shards = cells(lower.count(), shard_turns)
    found = lower.withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards))).groupBy("shard").applyInArrow(_shard_nodes, _NODE)
    found = staged(found, "subtrees")

    # nodes above the shards: what a subtree or such a node adds counts for all nodes on the way to it
    upper = rows.filter((F.col("depth") == 0) | (F.col("n_classes") > classes))
    nodes = upper.groupBy("node", "depth", "parent", "bytes").agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"))
    tops = found.filter("top").select("conv_id", "depth", "parent", "n_leaves", "saved_tokens")
    adds = tops.select("conv_id", "depth", "n_leaves", "saved_tokens").unionByName(nodes.select(
        "conv_id", "depth", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")))
    way = upper.select("conv_id", "depth", "node").join(adds, ["conv_id", "depth"], "full_outer")
    deeper = own.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = way.select("node", F.sum("n_leaves").over(deeper).alias("n_leaves"), F.sum("saved_tokens").over(deeper).alias("saved_tokens"))
    sums = sums.filter(F.col("node").isNotNull()).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = tops.select("parent").unionByName(nodes.select("parent")).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = nodes.join(sums, "node", "left").join(children, "node", "left").select(
        "node", "conv_id", "depth", "parent", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero("n_children"),
        F.when(F.coalesce("n_children", F.lit(0)) == 0, F.lit(1).cast("long")).otherwise(F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"),
        zero("saved_tokens"), F.lit(True).alias("top"))

    named = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"), F.col("n_children").alias("_n"))
    hung = attach_by_key(found.filter("top").unionByName(whole), named, "parent", "_n").withColumn("parent_conv_id", F.col("_above"))
    every = found.filter(~F.col("top")).unionByName(hung.select(*found.columns))
    ends = sorted_digest(last.select("node", "conv_id"), "node", ["conv_id"], F.col("conv_id").cast("string"), ",", "ends_sha256")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
