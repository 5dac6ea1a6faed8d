"""Incremental upload: a file stream that cleans and archives each new file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salesloom.plans.upload import FILE, put_in_effect, store_files, summarise
from salesloom.sources import quarantine
from salesloom.sources.batches import BatchStore


LISTING = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of the paths of new files; what is in them is not read here."""
    reader = spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(F.col("_metadata.file_path").alias(FILE))


def start_ingest(spark: SparkSession, folder: str, store: BatchStore, checkpoint: str,
                 fmt: str | None = "csv", max_files: int | None = None, set_active: bool = True) -> StreamingQuery:
    """Process all files not seen yet, then stop.

    The stream lists files; each micro-batch reads its own with the batch reader, so headers in any
    order and mixed encodings are handled alike.

    One micro-batch holds many files and cleans them keyed by file, since a file's statistics
    depend on that file alone.  The micro-batch number names the run, so a replayed micro-batch
    overwrites its own output and nothing is stored twice.  Each micro-batch writes the summaries of its
    owners; what it stores merges, so ``batches.summary`` follows without reading rows again.  Files and
    rows that cannot be read end in the store's ``files`` and ``rejects`` and do not stop the stream; files
    without a byte never reach it.
    """
    def keep(listed: DataFrame, number: int) -> None:
        run = f"stream-{number:09d}"
        paths = [r[0] for r in listed.collect()]  # the listing of one micro-batch, as the driver has it anyway
        if not paths:
            return
        store_files(spark, quarantine.read(spark, paths, fmt, store.roles, FILE), store, run)
        if set_active:
            put_in_effect(spark, store, run)
            summarise(spark, store, run)

    return (
        file_stream(spark, folder, max_files)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
