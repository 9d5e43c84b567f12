"""Whole batches: what is in a folder, what was converted before, what comes of the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import batch
from leafmill.sinks.files import write_tables
from leafmill.sources import docx


def with_stem(files: DataFrame) -> DataFrame:
    """``files`` with the name that each one's result has; by the path alone, so contents aren't read for it."""

    @F.pandas_udf("string")
    def stem(paths):
        return paths.map(docx.stem_of)

    return files.withColumn("stem", stem("path"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _move(spark: SparkSession, old: str, new: str) -> None:
    """``old`` takes the place of ``new``, which is set aside first and goes last: at each moment one of the two is whole."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, aside = jvm.Path(new).getFileSystem(spark._jsc.hadoopConfiguration()), f"{new.rstrip('/')}.{uuid.uuid4().hex}.old"
    for a, b in (*([(new, aside)] if _exists(spark, new) else []), (old, new)):
        if not fs.rename(jvm.Path(a), jvm.Path(b)):
            raise OSError(f"{a} can't be renamed to {b}")
    fs.delete(jvm.Path(aside), True)


def run(spark: SparkSession, source: str, out: str, force: bool = False, compat: bool = True) -> DataFrame:
    """Converts the packages of a folder into the tables under ``out``; returns (status, n) of ok, skipped and failed.

    Inputs are told apart by their paths. Those that an earlier run converted are skipped before their contents are read. With ``force`` all are
    converted into a new folder, which takes the old one's place once it is whole. A file that can't be read is a row of rejects.
    An empty folder makes nothing.
    """
    found = with_stem(docx.scan(spark, source).select("path", "content"))
    if not found.select("path").take(1):
        return spark.createDataFrame([], "status string, n long")
    done = spark.read.parquet(f"{out}/documents").select("path") if not force and _exists(spark, f"{out}/documents") else None
    planned = batch.plan(found, done, "path", done is None, wide=True)
    to = f"{out.rstrip('/')}.{uuid.uuid4().hex}" if force else f"{out.rstrip('/')}/run-{uuid.uuid4().hex}"
    before = 0 if done is None else done.join(found.select("path"), "path", "left_semi").count()
    # each file is parsed once: its tables are read from this, and what comes after counts from it
    docx.converted(planned.where("status = 'todo'"), compat).write.parquet(f"{to}/converted")
    made = spark.read.parquet(f"{to}/converted")
    counts = {r["status"]: r["n"] for r in made.groupBy(F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")).agg(F.count("*").alias("n")).collect()}
    if counts:
        write_tables(made, to if force else out)
    jvm = spark._jvm.org.apache.hadoop.fs
    jvm.Path(to).getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm.Path(f"{to}/converted" if force else to), True)
    if force and counts:
        _move(spark, to, out)
    rows = [(k, n) for k, n in (("ok", counts.get("ok", 0)), ("skipped", before), ("failed", counts.get("failed", 0))) if n]
    return spark.createDataFrame(rows, "status string, n long")
