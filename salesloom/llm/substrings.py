"""Removal of words that repeat an earlier passage, by a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window whose words also
start earlier (in a smaller id, or in the same document further to the front) is found, judged on the whole
input.  Words are compared byte by byte.

1. Documents are dealt into blocks by their id.  Of the hashes of all runs of ``GRAM`` words in a window the
   least is its anchor, so equal windows have equal anchors wherever they stand.  Anchors that the corpus has once
   hold no repeated window.
2. Neighbouring windows of one repeated anchor form a stretch; a block sends each different stretch of words once, with
   its earliest place, to the shard of the anchor.  Windows of an anchor that very many places share (the edges of a
   passage that a third of all documents have) are sent one by one, to the shard of the whole window.
3. Every shard builds an FM-index of its stretches (wavelet matrix over their Burrows-Wheeler transform) and streams
   them through it by backward search; of the range of each window the earliest place says whether others come later.
4. Blocks cover what has been found.

So all windows that could be equal meet in one shard, whatever documents they are from, and the work grows with
the input.  A passage costs one entry per block that has it.

Defined results: null texts have no words; rows that share an id are one document, in which a window is
earlier where its start is; equal places leave each other alone; rows without an id come after all others and
are one document in that sense; an empty table gives no rows; further columns pass through untouched.  Very
long texts are read in pieces of some ``PIECE_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.llm.common import cells, mixed, text_bytes
from salesloom.llm.fm_index import FmIndex

WINDOW, GRAM = 20, 8
BLOCK_BYTES, BUCKET_BYTES, SHARD_BYTES = 4_000_000, 8_000_000, 8_000_000
PIECE_WORDS, PIECE_BYTES = 60_000, 400_000
#: Anchors with more places are settled window by window; longer stretches are cut.
CROWDED, LONGEST = 4096, 256
NO_ID = np.iinfo("int64").max

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` hashes."""
    count = len(values) - size + 1
    out = np.full(max(count, 0), size, "uint64")
    for k in range(size if count > 0 else 0):
        out = mixed(out * _FACTOR + values[k:k + count])
    return out


def least_of_runs(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some hundred thousand bytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


_BYTES = np.random.default_rng(13).integers(0, 2 ** 63, 256, "int64").astype("uint64") * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 2 ** 64))


class Piece:
    """Words of one or several documents one after the other, and what is known of their windows.

    ``anchors``, after ``windows``: the anchor at each of its places, also where windows share one."""

    #: powers of the base and of its inverse, as far as they were needed
    powers = backwards = np.ones(1, "uint64")

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0
        #: per document: its number, its first word here, and which of its words that is
        self.docs: list[tuple[int, int, int]] = []

    def add(self, words: list[bytes]) -> None:
        if words:
            self.parts.append(b" ".join(words))
            self.size += len(words)

    def text(self, word: int, count: int) -> bytes:
        """``count`` words from a word on, joined by spaces."""
        return self.buffer[self.starts[word]:self.ends[word + count - 1]]

    def hashes(self) -> np.ndarray:
        """Hashes of all words: sums of byte values times powers of a base, moved to the word's start."""
        cls = Piece
        if len(cls.powers) <= len(self.buffer):
            room = np.ones(2 * len(self.buffer) + 1, "uint64")
            room[1:] = _BASE
            cls.powers = np.multiply.accumulate(room)
            room[1:] = _BACK
            cls.backwards = np.multiply.accumulate(room)
        sums = np.zeros(len(self.buffer) + 1, "uint64")
        np.cumsum(_BYTES[np.frombuffer(self.buffer, "uint8")] * cls.powers[:len(self.buffer)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * cls.backwards[self.starts])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the windows, their anchors, and hashes of all words."""
        self.buffer = b" ".join(self.parts)
        spaces = np.flatnonzero(np.frombuffer(self.buffer, "uint8") == 32)
        self.starts, self.ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(self.buffer))
        self.anchors = np.zeros(0, "uint64")
        if self.size < WINDOW:
            return np.zeros(0, "int64"), self.anchors, self.anchors
        hashes = self.hashes()
        runs, wide = run_hashes(hashes, GRAM), WINDOW - GRAM + 1
        least = least_of_runs(runs, wide)
        inside = np.ones(len(least), bool)
        for _, begin, _ in self.docs[1:]:
            inside[max(0, begin - WINDOW + 1):begin] = False
        # a run is an anchor where it is the least of some window that holds it
        edge = np.zeros(wide - 1, "uint64")
        most = ~least_of_runs(~np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), wide)
        self.anchors = runs[most == runs]
        at = np.flatnonzero(inside)
        return at, least[at], hashes

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and number of the words at these places."""
        docs, begins, firsts = (np.array(c, "int64") for c in zip(*self.docs))
        k = np.searchsorted(begins, at, side="right") - 1
        return docs[k], at - begins[k] + firsts[k]


def pieces(texts: list[bytes]) -> Iterator[Piece]:
    """Short documents together, long ones cut so that every window is whole in one piece."""
    piece = Piece()
    for number, text in enumerate(texts):
        done, tail = 0, []
        for words in word_pieces(text):
            if piece.size >= PIECE_WORDS:
                yield piece
                piece = Piece()
            if not piece.docs or piece.docs[-1][0] != number:
                piece.docs.append((number, piece.size, done - len(tail)))
                piece.add(tail)
            piece.add(words)
            done += len(words)
            tail = [*tail, *words[-WINDOW + 1:]][-WINDOW + 1:]
    if piece.docs:
        yield piece


def _runs(at: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of every stretch, as a place in ``at``, and its number of windows; none longer than LONGEST."""
    if not len(at):
        return at, at
    begin = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(begin, len(at)))
    parts = -(-count // LONGEST)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(begin, parts) + nth * LONGEST
    return first, np.minimum(np.repeat(begin + count, parts) - first, LONGEST)


# --- what blocks and shards tell each other -------------------------------------------------------------

SENT = "shard int, block int, kind int, payload binary"
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Anchors of a block; those that are repeated; those that are crowded; stretches; places of a block's own
#: stretches; windows that have an earlier place.
ANCHORS, REPEATED, CROWD, STRETCHES, PLACES, EARLIER = range(6)
_ANCHOR = np.dtype([("anchor", "<u8"), ("count", "u1")])
_PLACE = np.dtype([("entry", "<i4"), ("doc", "<i4"), ("start", "<i8")])
_ENTRY = np.dtype([("entry", "<i4"), ("windows", "<i4"), ("id", "<i8"), ("start", "<i8")])


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every different key and where it stands."""
    order = np.argsort(keys, kind="stable")
    found, begin = np.unique(keys[order], return_index=True)
    for key, i, j in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        yield key, order[i:j]


def _payloads(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    columns = (table.column(c).to_pylist() for c in ("block", "kind", "payload"))
    return [(block, payload) for block, k, payload in zip(*columns) if k == kind]


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, texts and order of the rows of a block; the same however the rows come."""
    ids, texts = table.column("id").to_numpy(), table.column("text").to_pylist()
    order = np.array(sorted(range(len(texts)), key=lambda k: (ids[k], texts[k])), "int64")
    return ids[order], [texts[k] for k in order], order


def _anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        found, counts = np.zeros(0, "uint64"), np.zeros(0, "int64")
        for piece in pieces(_texts(table)[1]):
            piece.windows()
            found, back = np.unique(np.concatenate([found, piece.anchors]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(len(piece.anchors))]), len(found))
        out = np.empty(len(found), _ANCHOR)
        out["anchor"], out["count"] = found, np.minimum(counts, 255)
        bucket = (found % np.uint64(buckets)).astype("int64")
        return _sent([(b, number, ANCHORS, out[k].tobytes()) for b, k in _split(bucket)])

    return run


def _judge_anchors(table: pa.Table) -> pa.Table:
    """To every block those of its anchors that stand elsewhere or several times in it."""
    parts = [(block, np.frombuffer(p, _ANCHOR)) for block, p in _payloads(table, ANCHORS)]
    every = np.concatenate([p for _, p in parts])
    found, back = np.unique(every["anchor"], return_inverse=True)
    total = np.bincount(back, every["count"], len(found))[back]
    rows, at = [], 0
    for block, part in parts:
        own = total[at:at + len(part)]
        at += len(part)
        rows += [(-1, block, kind, part["anchor"][k].tobytes()) for kind, k in (
            (REPEATED, (own > 1) & (own <= CROWDED)), (CROWD, own > CROWDED)) if k.any()]
    return _sent(rows)


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the wanted, sorted ones."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _stretches(shards: int):
    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent([])
        number = table.column("block")[0].as_py()
        ids, texts, _ = _texts(table)
        repeated, crowd = (np.sort(np.concatenate([np.zeros(0, "uint64"), *[np.frombuffer(p, "<u8") for _, p in _payloads(verdicts, k)]]))
                           for k in (REPEATED, CROWD))
        entries: dict[bytes, int] = {}
        home, windows, places = [], [], []
        for piece in pieces(texts):
            at, anchors, hashes = piece.windows()
            first, count = _runs(at, anchors)
            alone = _among(anchors, crowd)
            kept = _among(anchors[first], repeated)
            begin = np.concatenate([at[first[kept]], at[alone]])
            size = np.concatenate([count[kept], np.ones(int(alone.sum()), "int64")])
            # a window that is dealt alone goes by the hash of all its words
            whole = run_hashes(hashes, WINDOW)[at[alone]] if alone.any() else np.zeros(0, "uint64")
            shard_of = (np.concatenate([anchors[first[kept]], whole]) % np.uint64(shards)).astype("int64")
            if not len(begin):
                continue
            docs, starts = piece.where(begin)
            for a, n, shard, doc, start in zip(begin.tolist(), size.tolist(), shard_of.tolist(), docs.tolist(), starts.tolist()):
                text = piece.text(a, n + WINDOW - 1)
                entry = entries.setdefault(text, len(entries))
                if entry == len(home):
                    home.append(shard)
                    windows.append(n)
                places.append((entry, doc, start))
        if not entries:
            return _sent([])
        placed = np.array(places, _PLACE)
        # in the order of documents and words, so the first place of an entry is its earliest
        placed = placed[np.lexsort((placed["start"], ids[placed["doc"]], placed["entry"]))]
        _, earliest = np.unique(placed["entry"], return_index=True)
        told = np.empty(len(entries), _ENTRY)
        told["entry"], told["windows"] = np.arange(len(entries)), windows
        told["id"], told["start"] = ids[placed["doc"][earliest]], placed["start"][earliest]
        every = list(entries)
        rows = [(shard, number, STRETCHES, b"\n".join([len(k).to_bytes(8, "little") + told[k].tobytes(), *[every[e] for e in k.tolist()]]))
                for shard, k in _split(np.array(home))]
        return _sent([*rows, (number % shards, number, PLACES, len(told).to_bytes(8, "little") + told.tobytes() + placed.tobytes())])

    return run


def _unpacked(payload: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Entries and their words, each entry's joined by spaces."""
    count = int.from_bytes(payload[:8], "little")
    end = 8 + count * _ENTRY.itemsize
    return np.frombuffer(payload, _ENTRY, count, 8), payload[end + 1:].split(b"\n")


class _Numbers(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_NTH = np.dtype([("entry", "<i4"), ("nth", "<i4")])
#: Stands for all windows of a stretch.
ALL = -1


def _match(table: pa.Table) -> pa.Table:
    """The index of one shard, and the windows of its stretches that have an earlier place.

    Equal stretches of several blocks are indexed and searched once, at the earliest of their places.
    """
    passed = [(-1, block, PLACES, payload) for block, payload in _payloads(table, PLACES)]
    told, blocks, same, distinct = [], [], [], _Numbers()
    for block, payload in _payloads(table, STRETCHES):
        entries, texts = _unpacked(payload)
        told.append(entries)
        blocks.append(np.full(len(entries), block))
        same.append(np.fromiter(map(distinct.__getitem__, texts), "int64", len(texts)))
    if not told:
        return _sent(passed)
    told, blocks, same = np.concatenate(told), np.concatenate(blocks), np.concatenate(same)
    order = np.lexsort((told["start"], told["id"], same))
    _, head = np.unique(same[order], return_index=True)
    first = told[order[head]]
    later = (told["id"] != first["id"][same]) | (told["start"] != first["start"][same])

    numbers, words = _Numbers(), b" ".join(distinct).split(b" ")
    codes, sizes = np.fromiter(map(numbers.__getitem__, words), "int64", len(words)), first["windows"].astype("int64") + WINDOW - 1
    del words, distinct
    index = FmIndex(codes, sizes, len(numbers), WINDOW)
    nth = _spread(np.zeros(len(sizes), "int64"), sizes)
    ids, starts = np.repeat(first["id"], sizes), np.repeat(first["start"], sizes) + nth
    order = np.lexsort((starts, ids))
    rank = np.empty(len(codes), "int64")
    rank[order] = np.cumsum(np.concatenate([[False], (ids[order][1:] != ids[order][:-1]) | (starts[order][1:] != starts[order][:-1])]))
    weights = np.full(index.size, len(codes), "int64")
    weights[index.places] = rank
    least = index.least(weights)
    found = index.search(codes, sizes)
    earlier = np.flatnonzero((found >= 0) & (least[found] < rank))

    # windows found, for every stretch that stands at the earliest place of its words; the others are found whole
    of = np.repeat(np.arange(len(sizes)), sizes)[earlier]
    edge = np.searchsorted(of, np.arange(len(sizes) + 1))
    own = np.flatnonzero(~later)
    many = (edge[1:] - edge[:-1])[same[own]]
    entry = np.concatenate([np.flatnonzero(later), np.repeat(own, many)])
    out = np.empty(len(entry), _NTH)
    out["entry"] = told["entry"][entry]
    out["nth"] = np.concatenate([np.full(int(later.sum()), ALL), nth[earlier][_spread(edge[:-1][same[own]], many)]])
    return _sent([*passed, *[(-1, block, EARLIER, out[k].tobytes()) for block, k in _split(blocks[entry])]])


def _spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from every ``begin`` on, ``many`` of each."""
    return np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def _covered(ids: np.ndarray, verdicts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the windows of a block that have an earlier place, in the order of documents."""
    docs, starts = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    earlier = np.concatenate([np.zeros(0, _NTH), *[np.frombuffer(p, _NTH) for _, p in _payloads(verdicts, EARLIER)]])
    earlier = earlier[np.argsort(earlier["entry"], kind="stable")]
    whole, earlier = earlier["entry"][earlier["nth"] == ALL], earlier[earlier["nth"] != ALL]
    for _, payload in _payloads(verdicts, PLACES):
        count = int.from_bytes(payload[:8], "little")
        told = np.frombuffer(payload, _ENTRY, count, 8)
        placed = np.frombuffer(payload, _PLACE, offset=8 + count * _ENTRY.itemsize)
        begin = np.searchsorted(earlier["entry"], placed["entry"], "left")
        many = np.searchsorted(earlier["entry"], placed["entry"], "right") - begin
        docs.append(np.repeat(placed["doc"], many))
        starts.append(np.repeat(placed["start"], many) + earlier["nth"][_spread(begin, many)])
        # stretches found whole, and the later places of a stretch in its own block
        head = np.concatenate([[True], placed["entry"][1:] != placed["entry"][:-1]])
        first = placed[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = placed[(ids[placed["doc"]] != ids[first["doc"]]) | (placed["start"] != first["start"]) | _among(placed["entry"], whole)]
        many = told["windows"][later["entry"]].astype("int64")
        docs.append(np.repeat(later["doc"], many))
        starts.append(_spread(later["start"], many))
    docs, starts = np.concatenate(docs).astype("int64"), np.concatenate(starts)
    order = np.lexsort((starts, docs))
    return docs[order], starts[order]


def _spans(starts: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the words that windows with these ascending starts cover."""
    if not len(starts):
        return np.zeros((0, 2), "int64")
    begin = np.concatenate([[True], starts[1:] > starts[:-1] + WINDOW])
    return np.stack([starts[begin], np.append(starts[:-1][begin[1:]], starts[-1]) + WINDOW], axis=1)


def _without(text: bytes, spans: np.ndarray) -> tuple[int, bytes]:
    """Number of words, and the words outside the spans joined by spaces."""
    count, kept = 0, []
    for words in word_pieces(text):
        if len(spans):
            near = np.clip(spans - count, 0, len(words))
            change = np.zeros(len(words) + 1, "int64")
            np.add.at(change, near[:, 0], 1)
            np.add.at(change, near[:, 1], -1)
            kept.append(b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist())))
        else:
            kept.append(b" ".join(words))
        count += len(words)
    return count, b" ".join(k for k in kept if k)


_FOUND = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("kept", pa.binary())])
_SPAN = T.StructType().add("start", T.LongType()).add("size", T.LongType())
FOUND = (T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType())
         .add("spans", T.ArrayType(_SPAN)).add("kept", T.BinaryType()))


def _finish(table: pa.Table, verdicts: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table({"rest": table.column("rest"), "found": pa.array([], _FOUND)})
    ids, texts, order = _texts(table)
    docs, starts = _covered(ids, verdicts)
    edges = np.searchsorted(docs, np.arange(len(texts) + 1))
    out = []
    for text, i, j in zip(texts, edges[:-1].tolist(), edges[1:].tolist()):
        spans = _spans(starts[i:j])
        count, kept = _without(text, spans)
        out.append({"n_words": count, "n_removed": int((spans[:, 1] - spans[:, 0]).sum()), "kept": kept,
                    "spans": [{"start": a, "size": b - a} for a, b in spans.tolist()]})
    return pa.table({"rest": table.column("rest").take(pa.array(order)), "found": pa.array(out, _FOUND)})


def find_repeats(docs: DataFrame, into: str = "repeats", id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the text, with a column of ``FOUND``: words, removed words, removed runs of words, and the kept
    words joined by spaces.

    The texts are shuffled once, by block; the three passes over them read that one shuffle.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets, shards = cells(size, block_bytes), cells(size, BUCKET_BYTES), cells(size, shard_bytes)
    rest = [c for c in docs.columns if c != text_col]
    by = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit(1))).otherwise(F.xxhash64(F.col(id_col).cast("long")))
    texts = docs.select(
        F.pmod(by, F.lit(blocks)).cast("int").alias("block"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        text_bytes(text_col).alias("text"), F.struct(*rest).alias("rest")).repartition(blocks, "block")

    anchors = texts.groupBy("block").applyInArrow(_anchors(buckets), SENT).groupBy("shard").applyInArrow(_judge_anchors, SENT)
    stretches = texts.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_stretches(shards), SENT)
    verdicts = stretches.groupBy("shard").applyInArrow(_match, SENT)
    schema = T.StructType().add("rest", texts.schema["rest"].dataType).add("found", FOUND)
    found = texts.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_finish, schema)
    return found.select("rest.*", F.col("found").alias(into))
