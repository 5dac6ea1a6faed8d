"""Language model scores: a hashed maximum-entropy model with a class-factored softmax.

Every word belongs to a class (by its ending) and to a slot within the class (by its hash).  The
probability of a word after its history is

    P(class | history) * P(slot | class, history) * (count + 1) / mass of the slot

The first two are softmaxes over sums of weights of hashed features of the history: the word
before (with its successor an n-gram), the word two before (a skip feature) and both together.  The
mass of a slot is the sum of (count + 1) over its known words, and 1 for all unknown ones, so the
probabilities of all words sum to one, whatever the vocabulary.

Counting covers the whole training corpus: tasks count in blocks, words (as 64-bit hashes, xxh3) meet in
buckets, and the counts return to the blocks in the order in which these sent their words.  The weights are trained in ROUNDS; in each, every task
takes gradient steps over its training documents of that round, and the tasks' weights are averaged
in levels.  Documents are scored block by block in numpy.

Defined results: a null or empty text is its end token alone; rows without ``doc_id`` are held out;
repeated rows are counted and scored each on its own; without training documents all words are
unknown; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, cells, rows_in, text_bytes
from salesloom.session import staged

#: As many slots as classes, so that both halves of a row of weights are equally wide.
CLASSES, SLOTS = 32, 32
#: Rows of weights for the word before, the word two before, and both.
BEFORE, SKIP, BOTH = 2048, 1024, 1024
ROWS = BEFORE + SKIP + BOTH
ROUNDS, STEP_TOKENS, RATE = 3, 8192, 0.15
#: Tokens of a step that go through the model at once; what they need stays in a processor's own cache.
PIECE = 2048
#: No white space is in a word, so this cannot be one.
END = b" "
BLOCK_TOKENS, BLOCK_WORDS = 1_500_000, 400_000
BUCKET_BYTES = 16_000_000
FAN_IN, CHUNKS = 64, 16
#: A task trains on so many tokens of a round or more.
TASK_TOKENS = 200_000

_WIDTH = CLASSES + SLOTS


@lru_cache(maxsize=1)
def _class_of_ending() -> np.ndarray:
    """Classes of words by their last two bytes, then by a single one, then of no byte."""
    endings = [bytes((a, b)) for a in range(256) for b in range(256)] + [bytes((a,)) for a in range(256)] + [b""]
    return np.array([zlib.crc32(e) % CLASSES for e in endings], "int64")


def marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and cell (class and slot) of each word."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    size = np.fromiter(map(len, words), "int64", len(words))
    # two bytes ahead, so that the first words have something before them
    whole, end = np.frombuffer(b"\0\0" + b"".join(words), "uint8"), np.cumsum(size)
    before, last = whole[end].astype("int64"), whole[end + 1].astype("int64")
    ending = np.where(size > 1, 256 * before + last, np.where(size == 1, 65_536 + last, 65_792))
    return hashes, _class_of_ending()[ending] * SLOTS + (hashes >> np.uint64(20)).astype("int64") % SLOTS


class Marks(defaultdict):
    """Numbers words in order of appearance; ``values`` and ``cells`` hold the hash and the cell of each."""

    def __init__(self):
        super().__init__(count().__next__)
        self.values, self.cells = np.zeros(1024, "uint64"), np.zeros(1024, "int64")

    def numbers(self, words: list[bytes]) -> np.ndarray:
        first = len(self)
        found = np.fromiter(map(self.__getitem__, words), "int64", len(words))
        if (size := len(self)) > first:  # hashes and cells of all new words at once
            if size > len(self.values):
                self.values, self.cells = (np.concatenate([x, np.zeros(max(size, len(x)), x.dtype)]) for x in (self.values, self.cells))
            new = list(islice(reversed(self), size - first))[::-1]
            self.values[first:size], self.cells[first:size] = marked(new)
        return found


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def history_rows(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Three rows of weights per token; ``starts`` are the first tokens of documents."""
    begin = np.zeros(len(values), bool)
    begin[starts] = True
    one = np.concatenate([values[:1], values[:-1]])
    one[begin] = 1
    two = np.concatenate([one[:1], one[:-1]])
    two[begin] = 2
    both = (one * np.uint64(0x9E3779B97F4A7C15) + two) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.stack([(one >> np.uint64(40)) % np.uint64(BEFORE), BEFORE + (two >> np.uint64(40)) % np.uint64(SKIP),
                     BEFORE + SKIP + (both >> np.uint64(44)) % np.uint64(BOTH)]).astype("int64")


def slot_rows(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows for the slots depend on the class as well; each kind of feature keeps to its own part."""
    size, first = (BEFORE, SKIP, BOTH), (0, BEFORE, BEFORE + SKIP)
    return np.stack([f + (r * 31 + classes * 7919) % n for r, n, f in zip(rows, size, first)])


def _column_sums(e: np.ndarray) -> np.ndarray:
    """Sum of each column; rows are added in the order in which numpy adds up contiguous numbers."""
    eight = e[:8] + e[8:16]
    for at in range(16, len(e), 8):
        eight += e[at:at + 8]
    four = eight[0::2] + eight[1::2]
    two = four[0::2] + four[1::2]
    return two[0] + two[1]


def _softmax(z: np.ndarray, scale: bool = True) -> np.ndarray:
    """Of each column; without ``scale``, the exponentials before they are divided by their sum."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    if scale:
        z /= _column_sums(z)
    return z


class Model:
    """``weights`` has CLASSES and SLOTS columns per row; the biases start from the counted masses."""

    def __init__(self, weights: np.ndarray, class_bias: np.ndarray, slot_bias: np.ndarray):
        self.weights, self.class_bias, self.slot_bias = weights, class_bias, slot_bias

    def _sums(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Sums of the weights in three half rows per token and of its bias, a column per token."""
        halves = _halves(self.weights)
        total, more = (np.empty((rows.shape[1], halves.shape[1]), halves.dtype) for _ in range(2))
        np.take(halves, rows[0], axis=0, out=total, mode="clip")
        for k in rows[1:]:
            total += np.take(halves, k, axis=0, out=more, mode="clip")
        return np.ascontiguousarray((total + bias).T)

    def forward(self, rows: np.ndarray, deep: np.ndarray, classes: np.ndarray, scale: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The two softmaxes, a column per token; ``deep`` are the rows for the slots."""
        p = _softmax(self._sums(2 * rows, self.class_bias), scale)
        q = _softmax(self._sums(2 * deep + 1, self.slot_bias[classes]), scale)
        return p, q

    def log10(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """log10 of P(class | history) * P(slot | class, history) of each token."""
        out = np.empty(len(cells))
        share = lambda e, k: np.log10((e[k, np.arange(len(k))] / _column_sums(e)).astype("float64"))
        for at in range(0, len(cells), PIECE):
            some, piece = rows[:, at:at + PIECE], cells[at:at + PIECE]
            classes = piece // SLOTS
            p, q = self.forward(some, slot_rows(some, classes), classes, scale=False)
            out[at:at + PIECE] = share(p, classes) + share(q, piece % SLOTS)
        return out

    def step(self, rows: np.ndarray, cells: np.ndarray, seen: np.ndarray) -> None:
        """One gradient step over these tokens, with step sizes that fall with what a weight has seen.

        Two columns are added up at a time, as the parts of complex numbers.
        """
        classes = cells // SLOTS
        deep, half = slot_rows(rows, classes), CLASSES // 2
        # a row that no token has keeps its weights
        (used, place), (used_deep, place_deep) = _used(rows), _used(deep)
        kind = np.result_type(self.weights, "complex64")
        sums, sums_deep = np.zeros((half, len(used)), kind), np.zeros((half, len(used_deep)), kind)
        for at in range(0, len(cells), PIECE):
            span = slice(at, at + PIECE)
            p, q = self.forward(rows[:, span], deep[:, span], classes[span])
            tokens = np.arange(p.shape[1])
            p[classes[span], tokens] -= 1
            q[cells[span] % SLOTS, tokens] -= 1
            pairs = np.empty((half, len(tokens)), kind)
            for slope, where, total in ((p, place, sums), (q, place_deep, sums_deep)):
                pairs.real, pairs.imag = slope[:half], slope[half:]
                for column, slopes in zip(total, pairs):
                    for k in where:
                        np.add.at(column, k[span], slopes)
        weights, squares = _halves(self.weights), _halves(seen)
        for which, total in ((2 * used, sums), (2 * used_deep + 1, sums_deep)):
            slope = np.ascontiguousarray(np.concatenate([total.real, total.imag]).T)
            squares[which] = part = squares[which] + slope * slope
            weights[which] -= RATE * slope / np.sqrt(part)


def _halves(table: np.ndarray) -> np.ndarray:
    """A table of ROWS rows with two rows for each: its columns for classes, then those for slots."""
    return table.reshape(2 * ROWS, CLASSES)


def _used(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, ascending, and the place of each given one among them."""
    there = np.zeros(ROWS, bool)
    there[rows] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[rows]


ENCODED = "kind int, block long, doc_id long, held boolean, bucket int, payload binary"
_ENCODED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()),
                      ("bucket", pa.int32()), ("payload", pa.binary())])
#: Rows of a document (numbers of its words), of a block (its words), and of a block's counts for a bucket.
DOCUMENT, WORDS, COUNTS = range(3)
#: One entry of a count: hash and cell of a word, and how often the block's training documents have it.
_ENTRY = np.dtype([("hash", "<u8"), ("n", "<u4"), ("cell", "<u2")])
COUNTED = "block long, bucket int, payload binary, cell int, mass long, tokens long, types long"
_COUNTED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("cell", pa.int32()),
                      ("mass", pa.int64()), ("tokens", pa.int64()), ("types", pa.int64())])


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Low halves, then high bytes; frequent words have small numbers, so the latter are mostly zero."""
    return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype("u1").tobytes()


def _unpack_numbers(packed: bytes) -> np.ndarray:
    count = len(packed) // 3
    return np.frombuffer(packed, "<u2", count).astype("int64") + (np.frombuffer(packed, "u1", count, 2 * count).astype("int64") << 16)


def _by_bucket(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Numbers of the words that fall into each bucket, ascending."""
    bucket = (hashes % np.uint64(buckets)).astype("int64")
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, begin[1:])))


def _encode(batches: Iterable[pa.RecordBatch], block_tokens: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of the words of their block, the words of each block, and its counts by bucket."""
    part, closed = TaskContext.get().partitionId(), 0
    table, docs, tokens = Marks(), [], 0
    counts, learnt = np.zeros(0, "int64"), []

    def add_up() -> None:
        """Counts of the documents since the last time; one by one, each would pass over all words of the block."""
        nonlocal counts
        if learnt:
            more = np.bincount(np.concatenate(learnt), minlength=len(table))
            more[:len(counts)] += counts
            counts = more
            learnt.clear()

    def block_rows() -> Iterator[pa.RecordBatch]:
        block, size = (part << 24) + closed, len(table)
        add_up()
        if docs:
            for at in range(0, len(docs), 500):
                ids, held, numbers = zip(*docs[at:at + 500])
                yield _rows(len(ids), kind=DOCUMENT, block=block, doc_id=ids, held=held, payload=numbers)
            yield _rows(1, kind=WORDS, block=block, payload=[b"\n".join(table)])
            entries = np.zeros(size, _ENTRY)
            entries["hash"], entries["cell"] = table.values[:size], table.cells[:size]
            entries["n"][:len(counts)] = counts
            dealt = _by_bucket(entries["hash"], buckets)
            yield _rows(len(dealt), kind=COUNTS, block=block, bucket=[b for b, _ in dealt],
                        payload=[b"".join(entries[k][c].tobytes() for c in _ENTRY.names) for _, k in dealt])

    for batch in rows_in(batches):
        for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns)):
            numbers = table.numbers(tokens_of(text))
            if not held:
                learnt.append(numbers)
            docs.append((doc_id, held, _pack_numbers(numbers)))
            tokens += len(numbers)
            if tokens > block_tokens or len(table) > BLOCK_WORDS:
                yield from block_rows()
                table, docs, tokens, closed = Marks(), [], 0, closed + 1
                counts = np.zeros(0, "int64")
        add_up()
    yield from block_rows()


def _rows(count: int, **given) -> pa.RecordBatch:
    arrays = []
    for field in _ENCODED:
        value = given.get(field.name)
        if value is None:
            arrays.append(pa.nulls(count, field.type))
        elif isinstance(value, int):
            arrays.append(pa.array(np.full(count, value), field.type))
        else:
            arrays.append(pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ENCODED)


def _count(table: pa.Table) -> pa.Table:
    """Counts over all blocks, back to each block in the order in which it sent them, and sums per cell."""
    parts = []
    for payload in table.column("payload").to_pylist():
        size, entries = len(payload) // _ENTRY.itemsize, np.zeros(len(payload) // _ENTRY.itemsize, _ENTRY)
        entries["hash"] = np.frombuffer(payload, "<u8", size)
        entries["n"] = np.frombuffer(payload, "<u4", size, 8 * size)
        entries["cell"] = np.frombuffer(payload, "<u2", size, 12 * size)
        parts.append(entries)
    entries = np.concatenate(parts)
    _, first, which = np.unique(entries["hash"], return_index=True, return_inverse=True)
    counts = np.zeros(len(first), "int64")
    np.add.at(counts, which, entries["n"].astype("int64"))
    back = np.split(counts[which].astype("<u8"), np.cumsum([len(p) for p in parts])[:-1])
    seen = counts > 0
    cell, c = entries["cell"][first][seen].astype("int64"), counts[seen]
    types = np.bincount(cell, minlength=CLASSES * SLOTS)
    tokens = np.zeros(CLASSES * SLOTS, "int64")
    np.add.at(tokens, cell, c)
    full, used = table.num_rows, np.flatnonzero(types)
    columns = [table.column("block").to_pylist() + [None] * len(used), table.column("bucket").to_pylist() + [None] * len(used),
               [b.tobytes() for b in back] + [None] * len(used), *[[None] * full + x[used].tolist() for x in (
                   np.arange(CLASSES * SLOTS), tokens + types, tokens, types)]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def _trainer(shared: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        model = Model(start.weights.copy(), start.class_bias, start.slot_bias)
        seen = np.ones_like(model.weights)
        words, starts, total = [], [], 0

        def step() -> None:
            v, c = marked(words)
            rows = history_rows(v, np.array(starts))
            for at in range(0, len(c), STEP_TOKENS):
                model.step(rows[:, at:at + STEP_TOKENS], c[at:at + STEP_TOKENS], seen)

        for batch in rows_in(batches):
            for text in batch.column(0).to_pylist():
                starts.append(len(words))
                words += tokens_of(text)
                if len(words) >= STEP_TOKENS:
                    step()
                    total += len(words)
                    words, starts = [], []
        if words:
            step()
            total += len(words)
        if total:
            parts = np.array_split(model.weights, CHUNKS)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array([float(total)] * CHUNKS),
                pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "chunk", "tokens", "weights"])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """Mean of weights, by tokens."""
    tokens = table.column("tokens").to_numpy()
    total = 0.0
    for n, w in zip(tokens, table.column("weights")):
        total = total + np.frombuffer(w.as_buffer(), "float32") * (n / tokens.sum())
    return pa.table({"part": table.column("part")[:1], "chunk": table.column("chunk")[:1], "tokens": pa.array([tokens.sum()]),
                     "weights": pa.array([total.astype("float32").tobytes()], pa.binary())})


TRAINED = "part long, chunk int, tokens double, weights binary"


def train(docs: DataFrame, masses: np.ndarray, tokens: int, rounds: int = ROUNDS) -> Model:
    """Weights from all training documents, ``docs(key, text)`` with so many ``tokens``.

    Small input partitions are taken together, so that the weights that tasks write stay well below what
    they read.  Only the averaged weights reach the driver.
    """
    tasks = cells(tokens, TASK_TOKENS * rounds)
    share = masses.reshape(CLASSES, SLOTS)
    model = Model(np.zeros((ROWS, _WIDTH), "float32"), np.log(share.sum(axis=1)).astype("float32"), np.log(share).astype("float32"))
    scratch = Scratch(docs.sparkSession)
    for k in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        turn = docs.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).select("text").coalesce(tasks)
        made = given = scratch.keep(turn.mapInArrow(_trainer(shared), TRAINED), "weights")
        parts = made.agg(F.max("part")).first()[0]
        while parts:
            made = made.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "chunk").applyInArrow(_averaged, TRAINED)
            parts //= FAN_IN
        got = sorted(made.select("chunk", "weights").collect())
        if got:
            weights = np.concatenate([np.frombuffer(r["weights"], "float32") for r in got]).reshape(ROWS, _WIDTH)
            model = Model(weights.copy(), model.class_bias, model.slot_bias)
        scratch.drop(given)
        shared.unpersist()
    return model


def _scorer(shared: Broadcast, buckets: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        model, masses, size = shared.value
        rows = list(zip(*(told.column(c).to_pylist() for c in ("bucket", "payload"))))
        words = next((p for b, p in rows if b is None), b"").split(b"\n")
        values, all_cells = marked(words)
        counts, dealt = np.zeros(len(words), "int64"), dict(_by_bucket(values, buckets))
        for bucket, payload in rows:
            if bucket is not None:
                counts[dealt[bucket]] = np.frombuffer(payload, "<u8")
        gain, weight = np.log10(counts + 1.0), np.log10(masses)
        out, waiting, size_of = [], [], 0

        def told_rows() -> list[tuple]:
            """Scores of the waiting documents, whose tokens go through the model together."""
            numbers = np.concatenate([n for _, _, n in waiting])
            starts = np.cumsum([0] + [len(n) for _, _, n in waiting[:-1]])
            cell = all_cells[numbers]
            history = history_rows(values[numbers], starts)
            near = np.concatenate([model.log10(history[:, a:a + STEP_TOKENS], cell[a:a + STEP_TOKENS]) for a in range(0, len(cell), STEP_TOKENS)])
            own, drawn, known = (np.add.reduceat(x, starts).tolist() for x in (
                gain[numbers], near - weight[cell], (counts[numbers] > 0).astype("int64")))
            return [(d, h, len(n), k, o - len(n) * float(np.log10(size)), o + r) for (d, h, n), k, o, r in zip(waiting, known, own, drawn)]

        for doc_id, held, packed in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "held", "payload"))):
            waiting.append((doc_id, held, _unpack_numbers(packed)))
            size_of += len(waiting[-1][2])
            if size_of >= 4 * STEP_TOKENS:
                out += told_rows()
                waiting, size_of = [], 0
        if waiting:
            out += told_rows()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 6, _SCORED)], schema=_SCORED)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Columns of ``SCORED`` and ``train_tokens`` for every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held"), text_bytes(text_col).alias("text"))
    buckets = cells(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0, BUCKET_BYTES)
    encoded = staged(own.mapInArrow(lambda batches: _encode(batches, block_tokens, buckets), ENCODED), "encoded")
    sent = encoded.filter(F.col("kind") == COUNTS).select("block", "bucket", "payload")
    counted = staged(sent.groupBy("bucket").applyInArrow(_count, COUNTED), "counted")
    sums = counted.filter("cell is not null").groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in ("mass", "tokens", "types")]).collect()
    masses = np.ones(CLASSES * SLOTS)
    for r in sums:
        masses[r["cell"]] += r["mass"]
    train_tokens, types = sum(r["tokens"] for r in sums), sum(r["types"] for r in sums)

    model = train(own.filter(~F.col("held")).select(F.col("doc_id").alias("key"), "text"), masses, train_tokens, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, masses, train_tokens + types + 1))
    documents = encoded.filter(F.col("kind") == DOCUMENT).select("block", "doc_id", "held", "payload")
    # columns of its own, since both sides of the cogroup come from one table
    words = encoded.filter(F.col("kind") == WORDS).select("block", "bucket", "payload")
    told = words.union(counted.filter("cell is null").select("block", "bucket", "payload")).select(
        *[F.col(c).alias(c) for c in ("block", "bucket", "payload")])
    scored = documents.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scorer(shared, buckets), SCORED)
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("long"))
