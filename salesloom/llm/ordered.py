"""Streams over sorted partitions: a digest of the ordered rows of each key, in bounded memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from salesloom.llm.common import rows_in

CHUNK_BYTES = 1 << 20


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows; none for no rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in rows_in(batches, 1024):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def sorted_digest(rows: DataFrame, key: str, order: Sequence[str], piece: Column, separator: str, into: str) -> DataFrame:
    """``(key, into)``: SHA-256, in lower-case hex, of the pieces of each key in the given order, joined.

    A digest has to be fed in order, so a key ends in one task; the rows of a key meet before that in
    many range partitions, each of which joins its own into chunks, and the last step streams the chunks.
    Null keys are one key, null pieces are left out.
    """
    order, mark = list(order), separator.encode()
    narrow = rows.select(F.col(key).alias("key"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
                         piece.cast("binary").alias("piece")).filter(F.col("piece").isNotNull())
    places = [f"o{i}" for i in range(len(order))]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(partitions, "key", *places).sortWithinPartitions("key", *places)
    schema = to_arrow_schema(ranged.schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            head, held, size = None, [], 0
            for key, *at, part in rows_of(batches):
                if held and (key != head[0] or size >= CHUNK_BYTES):
                    yield (*head, mark.join(held))
                    held, size = [], 0
                if not held:
                    head = (key, *at)
                held.append(part)
                size += len(part)
            if held:
                yield (*head, mark.join(held))
        return batches_of(made(), schema, 64)

    out = T.StructType().add("key", narrow.schema["key"].dataType).add("digest", T.StringType())
    out_arrow = to_arrow_schema(out)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            last, running = None, None
            for key, *_, part in rows_of(batches):
                if running is None or key != last:
                    if running is not None:
                        yield last, running.hexdigest()
                    last, running = key, hashlib.sha256()
                else:
                    running.update(mark)
                running.update(part)
            if running is not None:
                yield last, running.hexdigest()
        return batches_of(made(), out_arrow)

    joined = ranged.mapInArrow(chunks, ranged.schema).repartition(partitions, "key").sortWithinPartitions("key", *places)
    return joined.mapInArrow(digests, out).select(F.col("key").alias(key), F.col("digest").alias(into))
