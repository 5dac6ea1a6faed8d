"""Near-duplicate documents by b-bit MinHash.

Equal word sequences are first folded into one class by a combining count, so copies cost
nothing further and large groups of copies meet in no task.  Every class gets the minima of
``BANDS * ROWS`` hash functions over its word shingles.  Bands of minima propose candidates; of
each minimum only the low ``BITS`` bits are kept, packed into longs.  The similarity of a candidate
pair is estimated by counting equal groups of bits, less those that agree by chance, and pairs
that may reach the threshold are confirmed on the full shingle sets.

Within a bucket of a band, members are first compared with a few pivots, one after the other; what
is linked anywhere has one label everywhere.  Buckets that still hold several labels are put together
to families, so that no pair meets twice.  In a family only members that share one of their rarest
shingles with another label go on: of two sets with a similarity of t, the smaller
one has one of its ``size - ceil(2 * t / (1 + t) * size) + 1`` rarest among the ``size - ceil(t * size) + 1`` rarest of the
larger one, in any order of all shingles.  Members that may be the smaller one are compared with each
other and with those that may be the larger one, in cells of bounded size, by counting common shingles.  So each pair
that shares a band is compared, already connected, or known to lie below the threshold.  A pair at the threshold shares no band with probability 3e-5 (0.8)
or 3e-8 (0.85), and some fifteen bands on average.

Defined results: texts without words and null texts have an empty set and are linked with nothing;
rows with one ``doc_id`` count as one document; rows without ``doc_id`` never stand for a group;
an empty table gives no rows; further columns are ignored by ``link`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, WordTable, attach_by_key, free_name, let_go, mixed, rows_in, shingle_hashes, text_bytes
from salesloom.llm.components import components
from salesloom.session import staged

BANDS, ROWS, BITS = 45, 7, 4
FUNCTIONS = 320
#: Groups of bits in one long, and the lowest bit of each group.
PER_LONG = 64 // BITS
LOW_BITS = sum(1 << (BITS * k) for k in range(PER_LONG))
#: Rounds in which buckets are compared with one pivot.
PIVOTS = 3
#: Shingles of open members are counted in a table of this many places, whatever their number.
SKETCH_BITS, SKETCH_BLOCK = 20, 16_384
#: Members of larger buckets meet in cells of about so many rows or bytes of shingles.
CELL_ROWS, CELL_BYTES = 512, 2_000_000
#: Standard deviations of the estimate that a candidate may lie below the threshold.
SLACK = 5

SIGNED = "doc_id long, key binary, n_shingles long, bands array<long>, signature array<long>"


def _functions(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2 ** 31, FUNCTIONS, "uint32") * np.uint32(2) + np.uint32(1),
            rng.integers(0, 2 ** 32, FUNCTIONS, "uint32"))


def minima(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    values = (shingles >> np.uint64(32)).astype("uint32")[:, None]
    least = np.full(FUNCTIONS, 2 ** 32 - 1, "uint32")
    for at in range(0, len(values), 512):
        np.minimum(least, (values[at:at + 512] * factor + shift).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band of a matrix of minima."""
    parts = least[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).astype("uint64")
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype="uint64"), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view("int64")


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into longs."""
    low = (least & np.uint32((1 << BITS) - 1)).reshape(len(least), -1, PER_LONG).astype("uint64")
    shifts = np.arange(PER_LONG, dtype="uint64") * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=2).view("int64")


def sign(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table, (factor, shift) = WordTable(), _functions()
        for batch in rows_in(batches):
            keys, counts, least = [], [], np.zeros((batch.num_rows, FUNCTIONS), "uint32")
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = text.lower().split()
                shingles = shingle_hashes(table.hashes(words), size)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                counts.append(len(shingles))
                least[k] = minima(shingles, factor, shift)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                _lists(band_keys(least)), _lists(packed(least))], names=["doc_id", "key", "n_shingles", "bands", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, SIGNED)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype="int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def estimated(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for bits that agree by chance."""
    def unequal(u: Column, v: Column) -> Column:
        y = u.bitwiseXOR(v)
        for k in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(u.bitwiseXOR(v), k))
        return F.bit_count(y.bitwiseAND(F.lit(_signed(LOW_BITS))))

    differing = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    agreeing = 1 - differing / F.lit(FUNCTIONS)
    chance = 2.0 ** -BITS
    return (agreeing - chance) / (1 - chance)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _cut(percent: int) -> float:
    """Estimates below this are not confirmed."""
    chance, share = 2.0 ** -BITS, percent / 100
    p = share + (1 - share) * chance
    return share - SLACK * (p * (1 - p) / FUNCTIONS) ** 0.5 / (1 - chance)


def _shingle_sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(rid, set)``: packed sorted shingle hashes of the wanted documents."""
    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        table = WordTable()
        for texts in batches:
            yield pa.array([shingle_hashes(table.hashes(t.as_py().lower().split()), size).tobytes()
                            for t in texts], pa.binary())

    texts = docs.select(F.col(id_col).cast("long").alias("rid"), text_bytes(text_col).alias("text"))
    return texts.join(ids, "rid", "left_semi").select("rid", pack("text").alias("set"))


def _confirm(percent: int):
    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        let_go()
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return similar


def link(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row: documents linked at ``percent`` similarity or more."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(sign(docs, size, id_col, text_col), "signed")
    classes = scratch.keep(signed.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("rid"), F.count("*").alias("n"),
        F.first(F.struct("bands", "signature")).alias("of")).select("key", "rid", "n", "of.bands", "of.signature"), "classes")
    known = classes.filter(F.col("rid").isNotNull())
    rows = known.select(F.explode("bands").alias("bucket"), "rid")
    pivots = rows.groupBy("bucket").agg(F.min("rid").alias("pivot"), F.max("rid").alias("last"), F.count("*").alias("n"))
    members = scratch.keep(rows.join(pivots.filter("pivot < last").drop("last"), "bucket").withColumns(
        {"label": F.col("rid"), "pivot_label": F.col("pivot")}), "members")
    near = members.select("rid").distinct()
    signs = scratch.keep(known.select("rid", "bands", "signature").join(near, "rid", "left_semi"), "signs")
    sets = scratch.keep(_shingle_sets(docs, near, size, id_col, text_col), "sets")
    documents = scratch.keep(signed.select("doc_id", "n_shingles", "key"), "documents")
    names = scratch.keep(classes.select("key", "rid", "n"), "names")
    scratch.drop(signed, classes)

    labels = names.select(F.col("rid").alias("node"), F.col("rid").alias("component")).limit(0)
    for turn in range(PIVOTS):
        most = members.count()
        if not most:
            break
        links = scratch.keep(_links(_pivot_pairs(members), signs, sets, percent), "links", most)
        edges = scratch.keep(_spokes(links), "spokes", most)
        labels = _joined(labels, components(edges), scratch)
        before, members = members, scratch.keep(_next_members(members, labels, turn), "members", most)
        scratch.drop(before, links, edges)
    if not members.isEmpty():
        links = scratch.keep(_links_of_cells(_families(members, sets, percent, scratch), sets, percent), "links")
        edges = scratch.keep(_between(links, labels), "between", links.count())
        labels = _joined(labels, components(edges), scratch)
        scratch.drop(links, edges)
    scratch.drop(members, signs, sets)

    where = names.join(labels, names["rid"] == labels["node"], "left").select(
        "key", "n", F.coalesce("component", "rid").alias("component"))
    placed = attach_by_key(documents, where, "key", "n")
    return placed.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a member and its pivot, with their labels."""
    return members.filter("label != pivot_label").select(
        F.col("rid").alias("a"), F.col("pivot").alias("b"), "label", "pivot_label").distinct()


def _spokes(links: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between labels that connect what the links of members ``(a, label, pivot_label)`` connect.

    A member has a link in each of its buckets, BANDS at most.  One of them, to the smallest label, becomes an edge of its own;
    that the other labels hang together with this one is the same edge for all members of a group.
    """
    near = links.groupBy("a", "label").agg(F.sort_array(F.collect_set("pivot_label")).alias("near"))
    edge = F.transform("near", lambda to, k: F.struct(F.when(k == 0, F.col("label")).otherwise(to).alias("a"), F.col("near")[0].alias("b")))
    return near.select(F.inline(edge)).distinct()


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the labels of linked members."""
    of = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
    to = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
    return links.join(of, "a", "left").join(to, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()


def _joined(labels: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of the members in ``labels`` and of those new in ``found``, the components of labels."""
    to = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = found.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return scratch.keep(known.union(new), "labels", labels.count() + found.count())


def _slots(shingles: np.ndarray, family: int) -> np.ndarray:
    """Shingles of one family as 64-bit keys; the highest SKETCH_BITS are the place in the table of counts."""
    return mixed(shingles ^ mixed(np.array([family], "int64").view("uint64")))


def _counts(sets: DataFrame) -> np.ndarray:
    """How many members have the shingles of a place, at most; a table of 4 MB.

    Every task counts its own, a block of the table is summed by one task.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, "int64")
        for batch in rows_in(batches):
            for family, packed_set in zip(batch.column(0).to_pylist(), batch.column(1)):
                slots = _slots(np.frombuffer(packed_set.as_buffer(), "uint64"), family) >> np.uint64(64 - SKETCH_BITS)
                np.add.at(table, slots, 1)
        for block in range(len(table) // SKETCH_BLOCK):
            part = table[block * SKETCH_BLOCK:(block + 1) * SKETCH_BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                payload = at.astype("<u2").tobytes() + np.minimum(part[at], 2 ** 31 - 1).astype("<i4").tobytes()
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([payload], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        out = np.zeros(SKETCH_BLOCK, "int64")
        for payload in table.column("counts").to_pylist():
            n = len(payload) // 6
            out[np.frombuffer(payload, "<u2", n)] += np.frombuffer(payload, "<i4", n, 2 * n)
        return pa.table({"block": table.column("block").slice(0, 1),
                         "counts": pa.array([np.minimum(out, 2 ** 31 - 1).astype("<i4").tobytes()], pa.binary())})

    schema = "block int, counts binary"
    whole = np.zeros(1 << SKETCH_BITS, "<i4")
    for block, counts in sets.select("family", "set").mapInArrow(count, schema).groupBy("block").applyInArrow(total, schema).collect():
        whole[block * SKETCH_BLOCK:(block + 1) * SKETCH_BLOCK] = np.frombuffer(counts, "<i4")
    return whole


def _families(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``(bucket, rid, label, short)``: members of open buckets, by family, that share one of their rarest shingles with another
    label; ``short`` where that is one of the few that the smaller set of a pair must share."""
    # buckets of one family mostly have one of its smallest ids, so few different edges remain
    most = members.count()
    least = members.groupBy("bucket").agg(F.min("rid").alias("b"))
    edges = scratch.keep(_spokes(members.join(least, "bucket").select(
        F.col("rid").alias("a"), F.col("rid").alias("label"), F.col("b").alias("pivot_label"))), "spokes", most)
    family = components(edges)
    named = members.select("rid", "label").distinct().join(family.toDF("rid", "family"), "rid")
    rows = scratch.keep(named.join(sets, "rid").select("family", "set", "rid", "label"), "open")
    counts = _counts(rows)

    def rarest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            tokens, owner, short = [], [], []
            for k, (of, packed_set) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                keys = _slots(np.frombuffer(packed_set.as_buffer(), "uint64"), of)
                often = counts[keys >> np.uint64(64 - SKETCH_BITS)]
                first = np.lexsort((keys, often))[:len(keys) - -(-percent * len(keys) // 100) + 1]
                # the smaller set of a pair needs no more than this to meet the larger one's
                few = np.arange(len(first)) < len(keys) - -(-2 * percent * len(keys) // (100 + percent)) + 1
                # a place that one member has is shared with nobody
                some = often[first] > 1
                tokens.append(keys[first[some]])
                short.append(few[some])
                owner.append(np.full(int(some.sum()), k))
            at = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view("int64")), batch.column(2).take(at), batch.column(3).take(at), pa.array(np.concatenate(short))],
                names=["token", "rid", "label", "short"])

    tokens = scratch.keep(rows.mapInArrow(rarest, "token long, rid long, label long, short boolean"), "tokens")
    shared = tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("short").alias("short"))
    shared = shared.filter("lo < hi and short").select("token")
    alive = tokens.join(shared, "token", "left_semi").groupBy("rid").agg(F.bool_or("short").alias("short"))
    kept = scratch.keep(rows.select(F.col("family").alias("bucket"), "rid", "label").join(alive, "rid"), "alive", most)
    scratch.drop(rows, tokens, edges)
    return kept


def _links(pairs: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that the full sets confirm, with their further columns."""
    of = signs.select("rid", "signature")
    likely = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b").filter(
        estimated(F.col("sa"), F.col("sb")) >= _cut(percent)).select(*pairs.columns)
    found = likely.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    return found.filter(_confirm(percent)("set_a", "set_b")).select(*pairs.columns)


def _next_members(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that have not come together, with their labels and new pivots.

    A bucket of two was decided by its one comparison, and of buckets with the same members one is kept.
    """
    after = members.select("bucket", "rid", "n").join(labels, F.col("rid") == F.col("node"), "left").select(
        "bucket", "rid", "n", F.coalesce("component", "rid").alias("label"))
    mark = F.xxhash64("rid", F.lit(turn)).cast("decimal(20,0)")
    choice = F.min(F.struct(F.xxhash64("rid", "bucket", F.lit(turn)), F.col("rid").alias("rid"), F.col("label").alias("label")))
    wide = after.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("n").alias("n"),
                                       F.min("rid").alias("first"), F.max("rid").alias("last"), F.sum(mark).alias("marks"), choice.alias("p"))
    still = wide.filter("lo < hi and n > 2").groupBy("n", "first", "last", "marks").agg(F.min(F.struct("bucket", "p")).alias("of"))
    chosen = still.select("of.bucket", F.col("of.p.rid").alias("pivot"), F.col("of.p.label").alias("pivot_label"))
    return after.join(chosen, "bucket").select("bucket", "rid", "n", "label", "pivot", "pivot_label")


def _links_of_cells(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect whatever similar members of one bucket connect, one of them ``short``.

    ``members``: rows ``(bucket, rid, label, short)``.  A label with many members has cells of its own, which need not
    meet each other; small labels share cells.  Short members have cells apart; cells without them do not meet.
    """
    weight = F.octet_length("set") / F.lit(float(CELL_BYTES)) + F.lit(1.0 / CELL_ROWS)
    rows = members.select("bucket", "rid", "label", "short").join(sets.select("rid", weight.alias("weight")), "rid")
    of_label = rows.groupBy("bucket", "short", "label").agg(F.sum("weight").alias("weight"))
    shared = of_label.filter("weight <= 1").groupBy("bucket", "short").agg(F.ceil(F.sum("weight")).alias("shared"))
    dealt = of_label.join(shared, ["bucket", "short"], "left").select("bucket", "short", "label", "shared", F.when(
        F.col("weight") > 1, F.ceil("weight")).alias("own"))
    cell = F.when(F.col("own").isNull(), F.xxhash64("short", F.pmod(F.xxhash64("label"), F.col("shared")))).otherwise(
        F.xxhash64("short", "label", F.pmod(F.xxhash64("rid"), F.col("own"))))
    placed = rows.join(dealt, ["bucket", "short", "label"]).select("bucket", "rid", "label", "short", cell.alias("cell"), F.when(
        F.col("own").isNotNull(), F.col("label")).alias("only"))
    cells = placed.select("bucket", "cell", "only", "short").distinct()
    meet = cells.toDF("bucket", "c", "oc", "sc").join(cells.toDF("bucket", "d", "od", "sd"), "bucket").filter(
        "c <= d and (sc or sd) and (oc is null or od is null or oc != od)").select("bucket", "c", "d")
    task = F.xxhash64("bucket", "c", "d").alias("task")
    left = meet.select("bucket", F.col("c").alias("cell"), task, F.lit(0).alias("side"))
    right = meet.filter("c < d").select("bucket", F.col("d").alias("cell"), task, F.lit(1).alias("side"))
    sent = placed.join(left.union(right), ["bucket", "cell"]).select("task", "side", "rid", "label").join(sets, "rid")

    def run(table: pa.Table) -> pa.Table:
        side, rid, label = (table.column(c).to_numpy() for c in ("side", "rid", "label"))
        found = connecting([np.frombuffer(x.as_buffer(), "uint64") for x in table.column("set")], side, label, percent)
        a, b = (np.array([p[k] for p in found], "int64") for k in (0, 1))
        return pa.table({"a": pa.array(np.maximum(rid[a], rid[b])), "b": pa.array(np.minimum(rid[a], rid[b]))})

    return sent.select("task", "side", "rid", "label", "set").groupBy("task").applyInArrow(run, "a long, b long")


def common_shingles(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 2048) -> np.ndarray:
    """How many shingles each of the sets ``rows`` shares with each of the sets ``columns``."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    group = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1
    several = np.bincount(group)[group] > 1
    group, owner = np.unique(group[several], return_inverse=True)[1], owner[several]
    both = np.zeros((len(rows), len(columns)))
    for at in range(0, int(group[-1]) + 1 if len(group) else 0, width):
        i, j = np.searchsorted(group, (at, at + width))
        holds = np.zeros((len(sets), width), "float32")
        holds[owner[i:j], group[i:j] - at] = 1
        both += holds[rows] @ holds[columns].T
    return both


def connecting(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Similar pairs of the two sides (of the one, if there is one) that connect different labels, no more than needed."""
    rows = np.flatnonzero(side == 0)
    columns = np.flatnonzero(side == 1) if side.any() else rows
    size = np.array([len(s) for s in sets])
    both = common_shingles(sets, rows, columns)
    alike = 100 * both >= percent * (size[rows][:, None] + size[columns][None, :] - both)
    alike &= label[rows][:, None] != label[columns][None, :]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    found = []
    for k, m in np.argwhere(alike).tolist():
        a, b = int(rows[k]), int(columns[m])
        x, y = top(int(label[a])), top(int(label[b]))
        if x != y:
            root[x] = y
            found.append((a, b))
    return found


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates (the smallest id), with all its columns.

    Rows without an id are kept.  Where ids repeat, every row is a document of its own: of several rows with one id
    those whose texts are near duplicates become one, others stay.
    """
    mark = free_name(docs, "_kept_id")
    with_id, without = docs.filter(F.col(id_col).isNotNull()), docs.filter(F.col(id_col).isNull())
    if with_id.groupBy(id_col).count().filter("count > 1").isEmpty():
        linked = link(docs, size, percent, id_col, text_col)
        kept = linked.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(mark))
        return with_id.join(kept, F.col(id_col) == F.col(mark), "left_semi").union(without)
    numbered = staged(with_id.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    linked = link(numbered, size, percent, mark, text_col).withColumnRenamed("doc_id", mark)
    order = F.struct(F.col(id_col), F.xxhash64(text_col), F.col(mark))
    best = linked.join(numbered.select(mark, id_col, text_col), mark).groupBy("component_id").agg(F.min(order).alias("best"))
    return numbered.join(best.select(F.col("best")[mark].alias(mark)), mark, "left_semi").select(*docs.columns).union(without)
