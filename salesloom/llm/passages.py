"""Removal of passages that an earlier document has already: every byte covered by a run of SIZE
bytes that also starts in a document with a smaller id.

Suffixes are not sorted one by one; a sample of positions that depends on the text alone stands for
all of them.  Of the hashes of all GRAM-byte runs in a window of SIZE bytes, the least one is the
window's anchor, so equal windows have equal anchors wherever they stand.  Neighbouring windows
with one anchor form a stretch (some 14 windows).  Then

1. equal stretches are found by their hashes: in all but the smallest document that has it, every
   window of the stretch has been seen;
2. where stretches share an anchor but differ, the windows themselves are compared by hash: these
   are the edges of common passages and anchors met by chance, a few hundredths of all.

Documents are dealt into blocks of some MB by their id; a block names each of its stretches and
windows once, with its smallest document, so a passage that a third of all documents share costs one
entry per block.  Anchors with many stretches in one block go straight to the second step.
Hashes of 64 bits of their bytes stand for stretches and windows (xxh3); half the anchor travels beside a
stretch's, to find those that share it.

Defined results: null and empty texts have no bytes; rows with one id leave each other alone; rows
without an id come after all others and leave each other alone; an empty table gives no rows;
further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.llm.common import cells, free_name, let_go, mixed, text_bytes

SIZE = 50
GRAM = 24
BLOCK_BYTES, BUCKET_BYTES = 3_000_000, 8_000_000
#: Texts are hashed so many bytes at a time, or one by one where they are longer.
PIECE_BYTES = 32_768
#: Anchors with more different stretches in a block are settled window by window.
MANY = 16
NO_ID = np.iinfo("int64").max

_TABLE = np.random.default_rng(7).integers(0, 2 ** 63, 256, "int64").astype("uint64") * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes, by doubling."""
    part, length, factor = _TABLE[text], 1, _FACTOR
    whole, covered = None, 0
    while True:
        if size & length:
            if whole is None:
                whole = part
            else:
                count = len(text) - covered - length + 1
                whole = whole[:count] * factor + part[covered:covered + count]
            covered += length
        if 2 * length > size:
            return mixed(whole)
        count = len(part) - length
        part, factor, length = part[:count] * factor + part[length:], factor * factor, 2 * length


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, anchor, name, first and last window of every stretch of some texts.

    The name is a hash of the bytes.
    """
    whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    if len(whole) < SIZE:
        return tuple(np.zeros(0, kind) for kind in ("int64", "uint64", "uint64", "int64", "int64"))
    with np.errstate(over="ignore"):
        least = least_in_windows(gram_hashes(np.frombuffer(whole, "uint8"), GRAM), SIZE - GRAM + 1)
    # no window crosses the end of a text
    inside = np.ones(len(least), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - SIZE + 1):end] = False
    at = np.flatnonzero(inside)
    kept = least[at]
    cut = np.flatnonzero((kept[1:] != kept[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    begin = np.concatenate([[0], cut]) if len(at) else cut
    first, last, anchors = at[begin], at[np.concatenate([cut - 1, [len(at) - 1]])] if len(at) else at, kept[begin]
    digest = xxhash.xxh3_64_intdigest
    names = np.fromiter((digest(whole[i:j]) for i, j in zip(first.tolist(), (last + SIZE).tolist())), "uint64", len(first))
    doc = np.searchsorted(ends, first, side="right")
    start = (ends - [len(t) for t in texts])[doc]
    return doc, anchors, names, first - start, last - start


def window_hashes(text: bytes, first: int, last: int) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [digest(text[a:a + SIZE]) for a in range(first, last + 1)]


class Block:
    """Stretches of the documents of one block, documents in the order of their ids."""

    def __init__(self, table: pa.Table):
        let_go()
        ids = table.column("id").to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        texts = table.column("text")
        self.texts = [texts[int(k)].as_py() for k in self.order]
        parts, at = [stretches([])], 0
        while at < len(self.texts):
            stop, size = at, 0
            while stop < len(self.texts) and (stop == at or size + len(self.texts[stop]) <= PIECE_BYTES):
                size += len(self.texts[stop])
                stop += 1
            doc, *rest = stretches(self.texts[at:stop])
            parts.append((doc + at, *rest))
            at = stop
        self.doc, self.anchor, self.name, self.first, self.last = (np.concatenate(c) for c in zip(*parts))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries for other blocks and their anchors; names of crowded anchors; entries of names that
        several documents of the block have, with the place of the smallest.

        Of a crowded anchor two names are sent, enough to show others that it has several.
        """
        names, place, count = np.unique(self.name, return_index=True, return_counts=True)
        anchor = self.anchor[place]
        order = np.argsort(anchor, kind="stable")
        starts = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(starts) - 1
        rank = np.empty(len(order), "int64")
        rank[order] = np.arange(len(order)) - np.flatnonzero(starts)[group]
        many = np.empty(len(order), bool)
        many[order] = (np.bincount(group) > MANY)[group]
        sent = ~many | (rank < 2)
        entries = np.zeros(int(sent.sum()), _STRETCH)
        entries["anchor"] = anchor[sent] >> _HALF
        entries["name"], entries["id"] = names[sent], self.ids[self.doc[place[sent]]]
        again = count > 1
        local = np.zeros(int(again.sum()), _ENTRY)
        local["name"], local["id"] = names[again], self.doc[place[again]]
        return entries, anchor[sent], names[many], local

    def windows(self, open_names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and start of the windows at the first places of these names."""
        found = np.flatnonzero(_among(self.name, open_names))
        _, first = np.unique(self.name[found], return_index=True)
        hashes, docs, starts = [], [], []
        for k in found[first].tolist():
            got = window_hashes(self.texts[self.doc[k]], int(self.first[k]), int(self.last[k]))
            hashes += got
            docs += [int(self.doc[k])] * len(got)
            starts += range(int(self.first[k]), int(self.last[k]) + 1)
        return np.array(hashes, "uint64"), np.array(docs, "int64"), np.array(starts, "int64")


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the wanted ones."""
    wanted = np.unique(wanted)
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    return wanted[np.minimum(at, len(wanted) - 1)] == values


SENT = "bucket int, block int, kind int, payload binary"
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: What a payload holds: entries for other blocks, names seen, names still open, windows seen, names of
#: several documents of the block with the first of these.
ENTRIES, SEEN_NAMES, OPEN_NAMES, SEEN_WINDOWS, OWN_NAMES = range(5)
_ENTRY = np.dtype([("name", "<u8"), ("id", "<i8")])
_STRETCH = np.dtype([("name", "<u8"), ("id", "<i8"), ("anchor", "<u4")])


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _packed(entries: np.ndarray) -> bytes:
    """The ids that occur and how many entries each has, then names, and anchors where there are any, in their order."""
    entries = entries[np.argsort(entries["id"], kind="stable")]
    ids, count = np.unique(entries["id"], return_counts=True)
    width = next(w for w in (1, 2, 4) if not len(count) or count.max() < 256 ** w)
    sizes = np.array([len(entries), len(ids), width, "anchor" in entries.dtype.names], "<i8")
    anchors = entries["anchor"].tobytes() if sizes[3] else b""
    return b"".join([sizes.tobytes(), ids.tobytes(), entries["name"].tobytes(), anchors, count.astype(f"<u{width}").tobytes()])


def _unpacked(payload: bytes) -> np.ndarray:
    count, different, width, anchors = np.frombuffer(payload, "<i8", 4).tolist()
    at = 32 + 8 * different
    out = np.zeros(count, _STRETCH if anchors else _ENTRY)
    out["name"] = np.frombuffer(payload, "<u8", count, at)
    at += 8 * count
    if anchors:
        out["anchor"] = np.frombuffer(payload, "<u4", count, at)
        at += 4 * count
    out["id"] = np.repeat(np.frombuffer(payload, "<i8", different, 32), np.frombuffer(payload, f"<u{width}", different, at))
    return out


def _dealt(entries: np.ndarray, bucket: np.ndarray, block: int) -> list[tuple[int, int, int, bytes]]:
    """One row per bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    buckets, begin = np.unique(bucket[order], return_index=True)
    ends = [*begin[1:].tolist(), len(order)]
    return [(int(b), block, ENTRIES, _packed(entries[order[i:j]])) for b, i, j in zip(buckets, begin.tolist(), ends)]


def _gathered(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a bucket and the block of each."""
    let_go()
    parts, blocks = [np.zeros(0, kind)], [np.zeros(0, "int64")]
    for block, what, payload in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "payload"))):
        if what == ENTRIES:
            parts.append(_unpacked(payload))
            blocks.append(np.full(len(parts[-1]), block))
    return np.concatenate(parts), np.concatenate(blocks)


def _not_first(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a smaller id under the same name elsewhere, and which are a name's first."""
    order = np.lexsort((ids, names))
    starts = np.concatenate([[True], names[order][1:] != names[order][:-1]]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(starts) - 1
    later = np.zeros(len(order), bool)
    later[order] = ids[order] > ids[order][starts][group]
    head = np.zeros(len(order), bool)
    head[order[starts]] = True
    return later, head


def _back(names: np.ndarray, blocks: np.ndarray, kind: int) -> list[tuple[int, int, int, bytes]]:
    order = np.argsort(blocks, kind="stable")
    found, begin = np.unique(blocks[order], return_index=True)
    ends = [*begin[1:].tolist(), len(order)]
    return [(-1, int(b), kind, names[order[i:j]].tobytes()) for b, i, j in zip(found, begin.tolist(), ends)]


def _passed(table: pa.Table) -> pa.Table:
    """What blocks tell themselves."""
    return table.filter(pa.compute.not_equal(table.column("kind"), ENTRIES)).cast(_SENT)


def _received(table: pa.Table, kind: int) -> np.ndarray:
    parts = [np.frombuffer(p, "uint64") for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()) if k == kind]
    return np.concatenate([*parts, np.zeros(0, "uint64")])


def _name_entries(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        entries, anchors, crowded, own = Block(table).entries()
        rows = _dealt(entries, (anchors & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), number)
        home = number % buckets
        return _sent(rows + [(home, number, OPEN_NAMES, crowded.tobytes()), (home, number, OWN_NAMES, _packed(own))])

    return run


def _match_names(table: pa.Table) -> pa.Table:
    entries, blocks = _gathered(table, _STRETCH)
    later, head = _not_first(entries["name"], entries["id"])
    anchor = entries["anchor"]
    found, count = np.unique(anchor[head], return_counts=True)
    several = np.isin(anchor, found[count > 1])
    still = several & ~later
    rows = _back(entries["name"][later], blocks[later], SEEN_NAMES) + _back(entries["name"][still], blocks[still], OPEN_NAMES)
    return pa.concat_tables([_sent(rows), _passed(table)])


def _window_entries(buckets: int):
    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent([])
        number, block = table.column("block")[0].as_py(), Block(table)
        hashes, docs, _ = block.windows(_received(verdicts, OPEN_NAMES))
        order = np.lexsort((docs, hashes))
        hashes, begin = np.unique(hashes[order], return_index=True)
        entries = np.zeros(len(hashes), _ENTRY)
        entries["name"], entries["id"] = hashes, block.ids[docs[order][begin]]
        rows = _dealt(entries, hashes % np.uint64(buckets), number)
        kept = zip(verdicts.column("kind").to_pylist(), verdicts.column("payload").to_pylist())
        return _sent(rows + [(number % buckets, number, k, p) for k, p in kept])

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    entries, blocks = _gathered(table, _ENTRY)
    later, _ = _not_first(entries["name"], entries["id"])
    return pa.concat_tables([_sent(_back(entries["name"][later], blocks[later], SEEN_WINDOWS)), _passed(table)])


def removed_runs(block: Block, verdicts: pa.Table) -> list[np.ndarray]:
    """Per document of the block, in its order: rows (start, end) of the bytes to remove, ascending."""
    whole = _among(block.name, _received(verdicts, SEEN_NAMES))
    own = np.sort(np.concatenate([np.zeros(0, _ENTRY), *[_unpacked(p) for k, p in zip(
        verdicts.column("kind").to_pylist(), verdicts.column("payload").to_pylist()) if k == OWN_NAMES]]), order="name")
    shared = np.flatnonzero(_among(block.name, own["name"]))
    least = block.ids[own["id"][np.searchsorted(own["name"], block.name[shared])]]
    whole[shared] |= least < block.ids[block.doc[shared]]

    hashes, docs, starts = block.windows(_received(verdicts, OPEN_NAMES))
    elsewhere = _among(hashes, _received(verdicts, SEEN_WINDOWS))
    later, _ = _not_first(hashes, block.ids[docs]) if len(docs) else (elsewhere, None)
    hit = elsewhere | later
    # a window of a name's first place stands at the same distance in all places of that name in rows with its id;
    # rows with larger ids have seen the whole name
    marks: list[list[tuple[int, int]]] = [[] for _ in block.texts]
    for d, a, b in zip(block.doc[whole].tolist(), block.first[whole].tolist(), block.last[whole].tolist()):
        marks[d].append((a, b + SIZE))
    places = _places(block, docs[hit], starts[hit])
    for d, a in places:
        marks[d].append((a, a + SIZE))
    return [_joined(m) for m in marks]


def _places(block: Block, docs: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """All places, in the rows with the same id, of windows that are given at the first place of a stretch."""
    if not len(docs):
        return
    key = block.doc.astype("int64") * (1 << 40) + block.first
    order = np.argsort(key, kind="stable")
    at = order[np.searchsorted(key[order], docs * (1 << 40) + starts, side="right") - 1]
    offsets = starts - block.first[at]
    # the same stretch may stand in its document more than once, and rows may share an id
    some = np.flatnonzero(_among(block.name, block.name[at]))
    ids = block.ids[block.doc]
    by = some[np.lexsort((ids[some], block.name[some]))]
    pairs = np.empty(len(by), [("name", "<u8"), ("id", "<i8")])
    pairs["name"], pairs["id"] = block.name[by], ids[by]
    wanted = np.empty(len(at), pairs.dtype)
    wanted["name"], wanted["id"] = block.name[at], block.ids[docs]
    lo, hi = np.searchsorted(pairs, wanted, side="left"), np.searchsorted(pairs, wanted, side="right")
    for offset, i, j in zip(offsets.tolist(), lo.tolist(), hi.tolist()):
        for d, a in zip(block.doc[by[i:j]].tolist(), block.first[by[i:j]].tolist()):
            yield d, a + offset


def _joined(spans: list[tuple[int, int]]) -> np.ndarray:
    if not spans:
        return np.zeros((0, 2), "int64")
    table = np.array(sorted(spans), "int64")
    reach = np.maximum.accumulate(table[:, 1])
    starts = np.concatenate([[True], table[1:, 0] > reach[:-1]])
    ends = np.concatenate([np.flatnonzero(starts)[1:] - 1, [len(table) - 1]])
    return np.stack([table[starts, 0], reach[ends]], axis=1)


_FOUND = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("kept", pa.binary())])
_SPAN = T.StructType().add("start", T.LongType()).add("size", T.LongType())
FOUND = (T.StructType().add("n_bytes", T.LongType()).add("n_removed", T.LongType())
         .add("spans", T.ArrayType(_SPAN)).add("kept", T.BinaryType()))


def _finish(table: pa.Table, verdicts: pa.Table, whole: bool = False) -> pa.Table:
    if not table.num_rows:
        return pa.table({"rest": table.column("rest"), "found": pa.array([], _FOUND)})
    block = Block(table)
    out = []
    for text, runs in zip(block.texts, removed_runs(block, verdicts)):
        at, kept = 0, []
        for a, b in runs.tolist():
            kept.append(text[at:a])
            at = b
        kept = b"".join([*kept, text[at:]])
        out.append({"n_bytes": len(text), "n_removed": len(text) - len(kept),
                    "kept": kept.decode("utf-8", "ignore").encode() if whole else kept,
                    "spans": [{"start": a, "size": b - a} for a, b in runs.tolist()]})
    return pa.table({"rest": table.column("rest").take(pa.array(block.order)), "found": pa.array(out, _FOUND)})


def find_passages(docs: DataFrame, into: str = "passages", id_col: str = "doc_id", text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """``docs`` without the text, with a column of ``FOUND``: bytes, removed bytes, removed stretches, kept bytes.

    ``whole``: of the kept bytes only those of whole characters; they still count as kept.

    The texts are shuffled once, by block; the three passes over them read that one shuffle.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets = cells(size, block_bytes), cells(size, BUCKET_BYTES)
    rest = [c for c in docs.columns if c != text_col]
    number = F.pmod(F.coalesce(F.xxhash64(F.col(id_col).cast("long")), F.lit(0)), F.lit(blocks))
    without_id = F.pmod(F.xxhash64(F.col(text_col), F.lit(1)), F.lit(blocks))
    texts = docs.select(
        F.when(F.col(id_col).isNull(), without_id).otherwise(number).cast("int").alias("block"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        text_bytes(text_col).alias("text"), F.struct(*rest).alias("rest")).repartition(blocks, "block")

    names = texts.groupBy("block").applyInArrow(_name_entries(buckets), SENT)
    verdicts = names.groupBy("bucket").applyInArrow(_match_names, SENT)
    windows = texts.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_window_entries(buckets), SENT)
    verdicts = windows.groupBy("bucket").applyInArrow(_match_windows, SENT)
    schema = T.StructType().add("rest", texts.schema["rest"].dataType).add("found", FOUND)
    found = texts.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(
        lambda table, verdicts: _finish(table, verdicts, whole), schema)
    return found.select("rest.*", F.col("found").alias(into))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without passages that an earlier one has; those with nothing left are dropped.

    Bytes that are left of a character cut in two are dropped with it.  ``length_col``, where there is
    one, is the length of what is left.  Texts that lose nothing stay as they are, empty ones too.
    """
    into = free_name(docs, "_passages")
    # characters are mended where passages are cut: a second Python step would keep two more workers on every executor
    found = find_passages(docs, into, id_col, text_col, whole=True).filter(
        (F.col(into)["n_removed"] == 0) | (F.col(into)["n_removed"] < F.col(into)["n_bytes"]))
    found = found.withColumn(text_col, F.col(into)["kept"].cast("string"))
    if length_col in docs.columns:
        cut = F.when(F.col(into)["n_removed"] > 0, F.length(text_col)).otherwise(F.col(length_col))
        found = found.withColumn(length_col, cut.cast(docs.schema[length_col].dataType))
    return found.select(*docs.columns)
