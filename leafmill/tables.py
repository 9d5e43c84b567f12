"""Reading tables."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it. Python workers get this package on their path, wherever the session was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, ROOT) if x)
    if ROOT not in sys.path:
        sys.path.append(ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Only a session within one machine may be without, as in tests, and gets a temporary one."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir isn't set: executors and driver need a folder that they share")
    return top or tempfile.mkdtemp(prefix="leafmill-")


def spread(rows: DataFrame, each: int) -> DataFrame:
    """``rows`` dealt evenly to tasks of about ``each`` rows. Short rows fill few splits of a file however many they are, and adaptive execution joins
    small partitions by their bytes; so long work on each row needs tasks by the number of rows, and they are dealt before anything is made of them."""
    return rows.repartition(max(1, -(-rows.count() // each)))


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Folders and files are listed by a few tasks for each core; Spark's default is a task for each of up to 10,000 paths, which costs more than listing them."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
