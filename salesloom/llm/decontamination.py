"""Benchmark decontamination by Wu-Manber search for many test strings at once.

The symbols are words.  A test string is a window of ten consecutive words of a benchmark item, or
the whole item where it is shorter.  For test strings of equal length, a shift table tells from
the last two words under the cursor how far it can move without passing an occurrence; words that
stand in no test string move it by nearly the whole length.  Where the shift is zero, the same two
words select a bucket of test strings, and a direct comparison confirms the occurrence.

The test strings are read in blocks of bounded size, one pass over the documents for each block,
so neither the broadcast nor the driver grows with the benchmark.

Defined results: null and empty texts and items have no words; items without an id are passed
over; rows with one item id are one item; repeated documents are judged each on its own; an empty
benchmark hits nothing; further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import cells, free_name, rows_in, text_bytes
from salesloom.session import staged

WINDOW = 10
BLOCK_WORDS = 2
#: Test strings read at once (some 100 bytes each).
STRINGS_PER_PASS = 500_000

FINDINGS = "struct<n_words:bigint, n_hit:bigint, spans:array<struct<start:bigint, size:bigint>>, items:array<bigint>>"
_FINDINGS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                       ("spans", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))),
                       ("items", pa.list_(pa.int64()))])
#: Word characters are 0-9, a-z and everything beyond ASCII; A-Z count as a-z.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32
              for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))]


class Matcher:
    """Search tables for test strings of one length."""

    def __init__(self, strings: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.furthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = {}
        for string, items in strings.items():
            for end in range(self.block, length + 1):
                key = string[end - self.block:end]
                self.shift[key] = min(length - end, self.shift.get(key, self.furthest))
            self.bucket.setdefault(string[-self.block:], {})[string] = items

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """First word and items of every occurrence."""
        length, block, furthest, shift, bucket = self.length, self.block, self.furthest, self.shift, self.bucket
        end, stop = length, len(words)
        while end <= stop:
            key = tuple(words[end - block:end])
            move = shift.get(key, furthest)
            if move:
                end += move
                continue
            items = bucket[key].get(tuple(words[end - length:end]))
            if items is not None:
                yield end - length, items
            end += 1


def matchers(strings: list[tuple[tuple[bytes, ...], int]]) -> list[Matcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for string, item in strings:
        by_length.setdefault(len(string), {}).setdefault(string, []).append(item)
    return [Matcher(found, length) for length, found in sorted(by_length.items())]


def search(words: list[bytes], tables: list[Matcher], spans: list[tuple[int, int]], items: set[int]) -> list[tuple[int, int]]:
    """Stretches ``(start, size)`` of words covered by occurrences, joined with ``spans``; adds to ``items``."""
    for table in tables:
        for start, found in table.occurrences(words):
            spans.append((start, table.length))
            items.update(found)
    merged: list[list[int]] = []
    for start, size in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], start + size)
        else:
            merged.append([start, start + size])
    return [(a, b - a) for a, b in merged]


def test_strings(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(string, item_id)``; the words of a string are joined by blanks."""
    def cut(batches):
        for batch in rows_in(batches):
            found = {(item, b" ".join(w)) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for w in windows_of(words_of(text), window)}
            yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.binary()),
                                              pa.array([f[0] for f in found], pa.int64())], names=["string", "item_id"])

    items = benchmark.filter(F.col(item_col).isNotNull())
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(cut, "string binary, item_id long").distinct()


def _finder(shared: Broadcast):
    @F.arrow_udf(FINDINGS)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = matchers(shared.value)
        for texts, earlier in batches:
            out = []
            for text, old in zip(texts, earlier):
                words, old = words_of(text.as_py()), old.as_py()
                items = set(old["items"]) if old else set()
                spans = search(words, tables, [(s["start"], s["size"]) for s in old["spans"]] if old else [], items)
                out.append({"n_words": len(words), "n_hit": sum(s[1] for s in spans),
                            "spans": [{"start": a, "size": n} for a, n in spans], "items": sorted(items)})
            yield pa.array(out, _FINDINGS)

    return find


def annotate(docs: DataFrame, benchmark: DataFrame, into: str = "contamination", text_col: str = "text",
             window: int = WINDOW, strings_per_pass: int = STRINGS_PER_PASS) -> DataFrame:
    """``docs`` with a column of ``FINDINGS``: words, hit words, hit stretches and items found."""
    strings = staged(test_strings(benchmark, window), "strings")
    passes = cells(strings.count(), strings_per_pass)
    part = F.pmod(F.xxhash64("string", "item_id"), F.lit(passes))
    context = docs.sparkSession.sparkContext
    before = F.lit(None).cast(FINDINGS)
    for k in range(passes):
        rows = strings.filter(part == k).collect()
        shared = context.broadcast([(tuple(bytes(r["string"]).split(b" ")), r["item_id"]) for r in rows])

        docs = docs.withColumn(into, _finder(shared)(text_bytes(text_col), before))
        if k + 1 < passes:
            docs = staged(docs, "searched")
            before = F.col(into)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit word, with their columns."""
    into = free_name(docs, "_contamination")
    return annotate(docs, benchmark, into, text_col, **options).filter(F.col(into)["n_hit"] == 0).select(*docs.columns)
