"""Quality rules of documents and of their hosts.

Every document is measured and held against rules.  Failures are counted per host and turned into
rates that are drawn towards the corpus, with a beta prior whose weight is estimated from the
hosts themselves (method of moments): a host with few documents is judged mostly by the prior.  A
host's verdict returns to its documents: all documents of a blocked host go, those of a suspect
host are held to stricter limits than others.

Defined results: a null or empty text has no words and fails; a null host is a host of its own;
repeated documents are measured and counted each on its own; an empty table gives no rows;
further columns pass through, but for the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import WordTable, attach_by_key, text_bytes
from salesloom.session import staged

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
#: Percent of symbols among characters, and of repeated lines among words, by the host's verdict.
MOST_SYMBOLS = {"ordinary": 10, "suspect": 5}
MOST_DUPLICATE_LINES = {"ordinary": 10, "suspect": 5}
#: A host is blocked where its rate surely reaches BLOCKED, suspect where surely above SUSPECT times the mean.
BLOCKED, SUSPECT = 0.5, 2.0

MEASURES = "struct<n_words:bigint, word_chars:bigint, n_symbols:bigint, n_dup_lines:bigint, n_repeat_words:bigint>"
_MEASURES = pa.struct([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window which occurs twice or more; the first occurrence counts too."""
    count = len(numbers) - window + 1
    if count < 2:
        return 0
    name = numbers[:count]
    for k in range(1, window):
        # numbers of prefixes and of words both stay below 2**31, so their pairs fit 62 bits
        name = np.unique(name * np.int64(1 << 31) + numbers[k:k + count], return_inverse=True)[1].astype("int64")
    twice = np.bincount(name)[name] > 1
    inside = np.zeros(len(numbers), bool)
    for k in range(window):
        inside[k:k + count] |= twice
    return int(inside.sum())


def measured(text: bytes, table: WordTable) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words).decode("utf-8", "replace")
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), len(joined), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(table.numbers(words)))


def _measurer():
    @F.arrow_udf(MEASURES)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordTable()
        for texts in batches:
            rows = np.array([measured(t.as_py(), table) for t in texts], "int64").reshape(-1, 5)
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(5)], fields=list(_MEASURES))

    return measure


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def over_limits(m: Column, verdict: str) -> Column:
    return (100 * m["n_symbols"] > MOST_SYMBOLS[verdict] * m["word_chars"]) | (
        100 * m["n_dup_lines"] > MOST_DUPLICATE_LINES[verdict] * m["n_words"])


def host_rates(docs: DataFrame, host: str, failed: Column) -> DataFrame:
    """``(host, n, rate, least, mean)``: documents, failure rate after shrinking, the same less one
    standard deviation of its posterior, and the mean rate of all.

    The prior's weight comes from the spread of the hosts' own rates beyond what chance gives.
    """
    hosts = docs.groupBy(host).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    n, k = F.col("n").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"),
                     F.sum(n * n).alias("nn"), F.count("*").alias("hosts")).first()
    total, mean = sums["n"] or 0.0, (sums["k"] / sums["n"] if sums["n"] else 0.0)
    even, free = mean * (1 - mean), (sums["hosts"] or 0) - 1
    spread = (sums["kk"] or 0.0) - total * mean ** 2 - even * free
    room = even * (total - (sums["nn"] or 0.0) / total - free) if total else 0.0
    alike = min(0.999, max(1e-4, spread / room)) if room > 0 else 1e-4
    weight = (1 - alike) / alike
    rate = (k + mean * weight) / (n + weight)
    return hosts.select(host, "n", rate.alias("rate"), (rate - F.sqrt(rate * (1 - rate) / (n + weight + 1))).alias("least"),
                        F.lit(mean).alias("mean"))


def judge(docs: DataFrame, host: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``measures``, ``base_failed``, ``host_rate``, ``host_verdict`` and ``kept``.

    ``docs`` must not have columns of these names; ``select`` what is needed before.
    """
    found = docs.select(*[c for c in docs.columns if c != text_col], _measurer()(text_bytes(text_col)).alias("measures"))
    m = F.col("measures")
    found = staged(found.withColumn("base_failed", base_failed(m)), "measured")
    rates = host_rates(found, host, F.col("base_failed") | over_limits(m, "ordinary"))
    verdict = F.when(F.col("least") >= BLOCKED, "blocked").when(F.col("least") > SUSPECT * F.col("mean"), "suspect").otherwise("ordinary")
    hosts = rates.select(host, "n", F.col("rate").alias("host_rate"), verdict.alias("host_verdict"))
    judged = attach_by_key(found, hosts, host, "n")
    strict = F.when(F.col("host_verdict") == "suspect", over_limits(m, "suspect")).otherwise(over_limits(m, "ordinary"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("host_verdict") != "blocked") & ~strict)
