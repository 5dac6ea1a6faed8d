"""Best-fit packing of tokenised documents into sequences of bounded length.

Large-item matching: a sequence holds at most two pieces above one third of its capacity, so
these are matched in pairs first, the longest with the longest that still fits.  The shorter
pieces then fill the remaining gaps, longest first, each into the tightest gap that takes it.

Only lengths matter to the plan.  Lengths are counted by Spark, the plan is made from the counts
(at most one per possible length, whatever the corpus), and every piece finds its place from its
rank among the pieces of its length.

Defined results: a null or empty text is one token, the closing id 0; repeated rows are packed
each on its own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import cells, kept, rows_in, table_batch, text_bytes
from salesloom.session import staged

CAPACITY = 2048
CLOSING_ID = 0
#: Words, and parts of words, that one generation of a process's memory takes.
WORDS, PARTS = 300_000, 300_000
#: Punctuation that stands apart from the letters before it.
CLOSING = ".,;:!?*#$%&|"
ROWS_PER_CELL = 25_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def encoder(path: str) -> Encoder:
    """The encoder of this Python process; later tasks go on with the words it has met."""
    return kept(("encoder", path), lambda: Encoder(path))


class Memory:
    """What has been worked out for byte strings or texts, in two generations.

    A full generation becomes the old one; what is asked for again moves from there to the young one, so
    frequent words stay and rare ones go, and no more than two generations are ever held.
    """

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def unknown(self, keys: set) -> list:
        """The keys that are not remembered; all others can be read from ``young`` until the next call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        out = []
        for key in keys.difference(self.young):
            held = self.old.get(key)
            if held is None:
                out.append(key)
            else:
                self.young[key] = held
        return out


class Encoder:
    """From texts as UTF-8 bytes to their ids as little-endian 32-bit numbers.

    The tokenizer drops white space before anything else, so the ids of a text are those of its
    parts between ASCII white space.  A part made of letters and closing punctuation falls into
    these two before the merges; runs of letters are encoded many at once and told apart by the
    tokens that end a word.  Whatever has been met before needs no second encoding.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.parts = Memory(WORDS), Memory(PARTS)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # folding could make special tokens, so texts that may hold one are left as they are
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = self.words.unknown(set(chain.from_iterable(split)))
        if new:
            self._learn(new)
        found = self.words.young.__getitem__
        return [b"".join(map(found, words)) for words in split]

    def _learn(self, new: list[bytes]) -> None:
        split = []
        for whole in [w.decode("utf-8", "replace") for w in new]:
            if whole.isalpha():
                split.append((whole, ""))
                continue
            letters = whole.rstrip(CLOSING)
            split.append((letters, whole[len(letters):]) if letters.isalpha() else (whole, ""))
        missing = set(self.parts.unknown({p for pair in split for p in pair}))
        parts = self.parts.young
        letters = [p for p in missing if p.isalpha()]
        lines = [" ".join(letters[k:k + 100]) for k in range(0, len(letters), 100)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(f.ids for f in found), "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(letters):
            raw, begin = ids.tobytes(), 0
            for part, end in zip(letters, ends.tolist()):
                parts[part] = raw[4 * begin:4 * end]
                begin = end
            missing.difference_update(letters)
        rest = list(missing)
        for part, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            parts[part] = np.array(found.ids, "<u4").tobytes()
        self.words.young.update((w, parts[a] + parts[b]) for w, (a, b) in zip(new, split))


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; only documents above ``capacity`` tokens have more than one."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in rows_in(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = memoryview(ids + closing)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield table_batch(dict(enumerate(zip(*out))), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(cut, PIECES)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Places for ``counts[length]`` pieces of every length, and the number of sequences.

    A place ``(length, rank, size, sequence, offset)`` says: pieces ``rank`` to ``rank + size - 1``
    of that length stand at ``offset`` of the sequences from ``sequence`` on, one each.  Sequences
    filled alike are handled together, so the work depends on the capacity, not on the counts.
    """
    places: list[tuple] = []
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    total = 0
    gaps: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def add_gap(gap: int, sequence: int, size: int) -> None:
        if gap and size:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((sequence, size))

    def put(length: int, size: int, sequence: int, offset: int) -> None:
        places.append((length, taken[length], size, sequence, offset))
        taken[length] += size
        left[length] -= size

    def mate_of(n: int) -> int | None:
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0:
            if left[large[at]] == 0:
                del large[at]
            elif large[at] != n or left[n] > 1:
                return large[at]
            at -= 1
        return None

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if left[n] == 0:
            large.pop()
            continue
        mate = mate_of(n)
        size = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
        put(n, size, total, 0)
        if mate is not None:
            put(mate, size, total, n)
        add_gap(capacity - n - (mate or 0), total, size)
        total += size

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                sequence, size = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
                used = min(size, left[n])
                put(n, used, sequence, capacity - gap)
                add_gap(gap, sequence + used, size - used)
                add_gap(gap - n, sequence, used)
            else:
                many = capacity // n
                size = max(1, left[n] // many)
                held = min(many, left[n])
                for k in range(held):
                    put(n, size, total, k * n)
                add_gap(capacity - held * n, total, size)
                total += size
    return places, total


def _rank_and_place(places: list[tuple]):
    """Function from lengths and ranks to sequence and offset."""
    table = np.array(sorted(places), "int64").reshape(-1, 5)
    top = np.int64(1) << 48  # ranks of one length stay below
    keys = table[:, 0] * top + table[:, 1]

    def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, length * top + rank, side="right") - 1
        return table[at, 3] + rank - table[at, 1], table[at, 4]

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and the offset where each stands.

    Pieces are dealt over hash cells; the rank of a piece is its rank inside its cell plus the
    number of equally long pieces in the cells before.  No length and no cell gathers in one task.
    """
    spark = docs.sparkSession
    pieces = staged(cut_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places, _ = plan_sequences(counts, capacity)
    shared = spark.sparkContext.broadcast(places)
    number = cells(sum(counts.values()), ROWS_PER_CELL)
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(number)).cast("int")
    dealt = pieces.withColumn("cell", cell)

    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # columns of its own, since both sides of the cogroup come from one table
    first = dealt.groupBy("cell", "length").count().select(
        F.col("cell").alias("of"), F.col("length").alias("size"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    def assign(pieces: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable")
        length = pieces["length"].to_numpy("int64")
        rank = pieces.groupby("length").cumcount().to_numpy("int64")
        begin = first.set_index("size")["first"]
        rank = rank + begin.reindex(length).to_numpy("int64")
        sequence, offset = _rank_and_place(shared.value)(length, rank)
        return pieces.drop(columns="cell").assign(sequence_id=sequence, offset=offset)

    return dealt.groupBy("cell").cogroup(first.groupBy("of")).applyInPandas(assign, PACKED)
