"""Folders that grow: each package is converted once, by a stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.sinks.files import write_tables
from leafmill.sources import docx
from leafmill.tables import few_listings

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """The packages of a folder as a stream of files."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.{docx,DOCX}").option("maxFilesPerTrigger", files_per_batch)
    return stream.load(source)


def convert_new(spark: SparkSession, source: str, out: str, checkpoint: str, compat: bool = True) -> int:
    """Converts what has come since the last call and returns how many rows it wrote; a call without new files writes none.

    A batch goes to a folder of its own number, overwritten if a lost run left part of it; so a file's rows are there once.
    """
    rows = docx.converted(arriving(spark, source), compat)

    def write(batch: DataFrame, number: int) -> None:
        write_tables(batch.persist(), f"{out}/batch={number}", "overwrite")
        batch.unpersist()

    with few_listings(spark):  # each batch lists its files anew
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return sum(p.get("numInputRows", 0) for p in query.recentProgress)
