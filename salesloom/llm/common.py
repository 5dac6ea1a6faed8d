"""Helpers that several operators of this package share.

The separators ``[\\x20\\x09-\\x0D]`` are exactly what ``bytes.split()`` splits on, and
``bytes.lower()`` lower-cases A-Z alone, so word operators work on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.session import scratch_path

#: Keys with more than one row in HOT_SHARE get their own treatment; fewer than HOT_SHARE can.
HOT_SHARE = 200


def text_bytes(text: str) -> Column:
    """The whole text as UTF-8 bytes; a null text has none."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


#: Most bytes of a batch that Spark hands to Python at once.
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Let Spark cut batches for Python by size: with the default of 64 MB two of them and their objects fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers between stages, each with its largest size so far."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make`` returns, once per Python process: later tasks of the same operator go on with it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drop what tasks of another operator kept: Spark hands its Python workers on from one operator to the next."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def rows_in(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that one slice of very long texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def table_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns.values(), schema)],
        schema=schema)


def cells(rows: int, per_cell: int) -> int:
    """Number of hash cells so that each gets about ``per_cell`` rows; grows with the table."""
    return max(1, -(-rows // per_cell))


def attach_by_key(df: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of a per-key ``table`` to ``df``; the key may hold any share of the rows.

    Keys with more than 1/HOT_SHARE of all rows are fewer than HOT_SHARE by arithmetic.  Their
    rows of ``table`` are broadcast, keyed by a 32-character digest, so the size is bounded even
    for long keys.  Rows served that way are spread evenly over the ordinary join of the others.
    ``table`` must not have wide columns besides the key, and no column of ``df``.
    """
    digest = F.coalesce(F.md5(F.col(key).cast("binary")), F.lit("null"))
    names = [c for c in table.columns if c not in (key, weight)]
    side = table.select(digest.alias("_digest"), F.struct(*names).alias("_found"), F.col(weight).alias("_weight"))
    total = side.agg(F.sum("_weight")).first()[0] or 0
    hot = side.filter(F.col("_weight") * HOT_SHARE > F.lit(total)).select("_digest", F.col("_found").alias("_hot"))
    cold = side.select("_digest", F.col("_found").alias("_cold"))
    tagged = df.withColumn("_digest", digest).join(F.broadcast(hot), "_digest", "left")
    spread = F.when(F.col("_hot").isNotNull(), F.concat(F.lit("-"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string")))
    joined = tagged.withColumn("_digest", F.coalesce(spread, "_digest")).join(cold, "_digest", "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*df.columns, *[found[c].alias(c) for c in names])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordTable(dict):
    """Numbers words in order of appearance; ``values[number]`` is a 64-bit hash of the word.

    One per task.  ``numbers`` starts it anew beyond ``limit`` words, so that it stays bounded.
    """

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.values = np.zeros(1024, "uint64")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number == len(self.values):
            self.values = np.concatenate([self.values, np.zeros(number, "uint64")])
        self.values[number] = xxhash.xxh3_64_intdigest(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), "int64", len(words))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers(words)
        return self.values[numbers]


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes with all bits stirred (xor-shift and multiply)."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MIX[1]
    values = values ^ (values >> np.uint64(29))
    values = values * _MIX[2]
    return values ^ (values >> np.uint64(32))


def shingle_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words are one run, none none."""
    if not len(values):
        return values
    size = min(size, len(values))
    count = len(values) - size + 1
    run = np.full(count, size, "uint64")
    for k in range(size):
        run = mixed(run * _MIX[0] + values[k:k + count])
    return np.unique(run)


#: Narrow tables have a file for each so many rows.
FILE_ROWS = 5_000


class Scratch:
    """Tables written below the shared folder, and dropped as soon as no later table reads them.

    Only what has been written out in turn may be dropped, so work that is lost with an executor
    never needs a dropped table again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """``most``: how many rows a narrow table can have; it gets no more files than these need.  For the mode of each file
        Hadoop starts a process, which counts as large as the executor itself until it runs a program of its own."""
        path = scratch_path(self.spark, name)
        if most is not None:
            df = df.coalesce(cells(most, FILE_ROWS))
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)
