"""Quality classifier: a factorisation machine over hashed words, text statistics and lengths.

Features of a text are its words, hashed to slots and weighted by the logarithm of their counts,
statistics of its structure (shares of symbols, capitals, repetition and so on) and its lengths,
both as values and as steps.  The machine adds to a linear model the product of every two features,
weighted by the product of their vectors; the sum over all pairs comes in time linear in the
features as half of (square of the sum - sum of the squares) for each of the vectors' dimensions.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents, the first in the order of a hash
of their ids; every text is scored whole.  Labels, language, source and id are never features.

Defined results: a null or empty text is scored from its statistics alone; without labelled
documents every score is 0.5; of several labels of one document the smallest counts, null labels
none; repeated documents are scored each on its own; further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import WordTable, free_name, let_go, text_bytes

WORD_SLOTS = 1 << 14
RANK = 8
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
EPOCHS, ROWS_PER_STEP, RATE, DECAY = 12, 128, 0.05, 1e-5

#: Shares of characters that are taken as symbols, bars, exclamations, digits, capitals, punctuation.
_KINDS = [b"#*$%&<>@^~=+_\\{}[]", b"|", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:"]
#: Each statistic lies between 0 and 1 and is cut into steps at these points.
_STEPS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_STATISTICS = len(_KINDS) + 8
SLOTS = WORD_SLOTS + _STATISTICS * (len(_STEPS) + 2)


def statistics(text: bytes, words: list[bytes], numbers: np.ndarray) -> np.ndarray:
    """Structure and length of a text, each between 0 and 1; ``numbers`` are the words as numbers."""
    size, count = max(1, len(text)), max(1, len(words))
    shares = [(len(text) - len(text.translate(None, kind))) / size for kind in _KINDS]
    lines = [line for line in text.split(b"\n") if line.strip()]
    distinct = len(np.unique(numbers))
    same = int((numbers[1:] == numbers[:-1]).sum())
    ended = sum(line.rstrip()[-1:] in b".!?" for line in lines)
    return np.array([*shares, same / count, 1 - distinct / count, 1 - len(set(lines)) / max(1, len(lines)),
                     ended / max(1, len(lines)), min(1.0, len(b"".join(words)) / count / 20),
                     min(1.0, np.log1p(len(words)) / 12), min(1.0, np.log1p(len(lines)) / 8),
                     min(1.0, np.log1p(len(text)) / 14)])


def features(text: bytes, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    words = text.split()
    numbers = table.numbers(words)
    slots = (table.values[numbers] >> np.uint64(50)).astype("int64")
    slots, counts = np.unique(slots, return_counts=True)
    values = np.log1p(counts)
    values = values / max(1e-9, np.sqrt((values ** 2).sum()))
    shares = statistics(text, words, numbers)
    base = WORD_SLOTS + np.arange(_STATISTICS) * (len(_STEPS) + 2)
    steps = np.searchsorted(_STEPS, shares, side="right")
    slots = np.concatenate([slots, base, base + 1 + steps])
    return slots, np.concatenate([values, shares, np.full(_STATISTICS, 0.5)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def forward(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds per document, and the terms its gradient needs; no document is without features."""
        part = self.vectors[slots] * values[:, None]
        total = np.add.reduceat(part, starts)
        linear = np.add.reduceat(self.weights[slots] * values, starts)
        pairs = 0.5 * (total ** 2 - np.add.reduceat(part ** 2, starts)).sum(axis=1)
        return self.bias + linear + pairs, part, total

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        sizes = np.array([len(s) for s, _ in found])
        odds, _, _ = self.forward(np.concatenate([s for s, _ in found]), np.concatenate([v for _, v in found]),
                                  np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss, adaptive step sizes per weight (AdaGrad), small quadratic penalty."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SLOTS), rng.normal(0, 0.01, (SLOTS, RANK)))
    if not len(labels):
        return Machine(0.0, np.zeros(SLOTS), np.zeros((SLOTS, RANK)))
    seen_b, seen_w, seen_v = 1e-6, np.full(SLOTS, 1e-6), np.full((SLOTS, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), ROWS_PER_STEP):
            rows = order[at:at + ROWS_PER_STEP]
            sizes = np.array([len(found[r][0]) for r in rows])
            slots = np.concatenate([found[r][0] for r in rows])
            values = np.concatenate([found[r][1] for r in rows])
            odds, part, total = machine.forward(slots, values, np.cumsum(sizes) - sizes)
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[rows]) / len(rows)
            per = np.repeat(error, sizes) * values
            used, where = np.unique(slots, return_inverse=True)
            slope_w = np.bincount(where, per, len(used)) + DECAY * machine.weights[used]
            pull = per[:, None] * (np.repeat(total, sizes, axis=0) - part)
            slope_v = np.stack([np.bincount(where, pull[:, k], len(used)) for k in range(RANK)], axis=1) + DECAY * machine.vectors[used]
            seen_b += error.sum() ** 2
            seen_w[used] += slope_w ** 2
            seen_v[used] += slope_v ** 2
            machine.bias -= RATE * error.sum() / np.sqrt(seen_b)
            machine.weights[used] -= RATE * slope_w / np.sqrt(seen_w[used])
            machine.vectors[used] -= RATE * slope_v / np.sqrt(seen_v[used])
    return machine


def in_training(doc_id: Column) -> Column:
    """Whether labels of this document may be learned from; never without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on a bounded sample of the labelled documents that ``in_training`` admits.

    Only the features of the sample come to the driver: some hundred numbers per document.
    """
    wanted = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).alias("_label"))
              .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & in_training(F.col("_id")))
              .groupBy("_id").agg(F.min("_label").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
    sample = texts.join(F.broadcast(wanted), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))

    def run(batches):
        let_go()
        table = WordTable()
        for batch in batches:
            found = [features(t, table) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2).cast(pa.float64()),
                pa.array([s.astype("int32").tobytes() for s, _ in found], pa.binary()),
                pa.array([v.astype("float32").tobytes() for _, v in found], pa.binary())],
                names=["id", "label", "slots", "values"])

    got = sample.mapInArrow(run, "id long, label double, slots binary, values binary").toArrow().sort_by("id")
    found = [(np.frombuffer(s, "int32").astype("int64"), np.frombuffer(v, "float32").astype("float64"))
             for s, v in zip(got["slots"].to_pylist(), got["values"].to_pylist())]
    return fit(found, got["label"].to_numpy().astype("float64"))


def _scorer(shared: Broadcast):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        machine, table = shared.value, WordTable()
        for texts in batches:
            out = [np.zeros(0)]
            for at in range(0, len(texts), 256):
                out.append(machine.scores([features(t, table) for t in texts.slice(at, 256).to_pylist()]))
            yield pa.array(np.concatenate(out), pa.float64())

    return score


def score(docs: DataFrame, machine: Machine, into: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 in the column ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.withColumn(into, _scorer(shared)(text_bytes(text_col)))


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the machine does not reject, with their columns."""
    into = free_name(docs, "_quality")
    return score(docs, machine, into, text_col).filter(F.col(into) >= threshold).select(*docs.columns)
