"""Batches: which documents a run converts, and how it went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(found: DataFrame, done: DataFrame, key: str, force: bool = False, wide: bool = False) -> DataFrame:
    """``found`` with a status: skipped if ``done`` has its key, unless forced; else todo. A null key is never done.
    If ``found`` is ``wide``, as contents of files are, the keys go to it and it isn't shuffled."""
    if force:
        return found.withColumn("status", F.lit("todo"))
    marks = done.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_done", F.lit(True))
    return found.join(F.broadcast(marks) if wide else marks, key, "left").withColumn("status", F.when(F.col("_done"), "skipped").otherwise("todo")).drop("_done")


def outcome(planned: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """The status after a run: failed where ``failed`` has the key, ok for others that were to do."""
    bad = failed.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_bad", F.lit(True))
    status = F.when(F.col("status") == "skipped", "skipped").when(F.col("_bad"), "failed").otherwise("ok")
    return planned.join(bad, key, "left").withColumn("status", status).drop("_bad")


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def collisions(rows: DataFrame, stem: str, key: str) -> DataFrame:
    """Stems that several inputs share: each is converted under its own key, and these are told."""
    return rows.groupBy(stem).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
