"""What a conversion gives, written: tables for further work, or a folder for each document.

The tables are the canonical form: (path, stem, markdown) and (path, stem, name, content). Folders are written by the tasks
themselves, straight to a file system that all machines share; nothing passes through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(converted: DataFrame, out: str, mode: str = "append") -> None:
    """``converted`` (path, stem, markdown, assets, error, rejects) as the tables documents, assets and rejects under ``out``.

    A reject is a file (``part`` null), or a workbook in a file that was converted all the same.
    """
    good = converted.where("error is null")
    good.select("path", "stem", "markdown").write.mode(mode).parquet(f"{out}/documents")
    good.select("path", "stem", F.explode("assets").alias("a")).select("path", "stem", "a.*").write.mode(mode).parquet(f"{out}/assets")
    none = F.struct(F.lit(None).cast("string").alias("part"), F.col("error"))
    rejects = converted.select("path", "stem", F.explode(F.when(F.col("error").isNotNull(), F.array(none)).otherwise(F.col("rejects"))).alias("r"))
    rejects.select("path", "stem", "r.*").write.mode(mode).parquet(f"{out}/rejects")


def write_folders(converted: DataFrame, out: str, subfolder: bool = True) -> DataFrame:
    """Writes <out>/<stem>/<stem>.md and assets/ beside it; returns (path, stem, file) and does its work when that is read.

    A file is written under another name and then renamed, so a task that runs twice, or is lost, leaves no half of one. An asset that
    is there already is kept.
    """

    def put(name: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        part = f"{name}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, name)

    def write(frames):
        for pdf in frames:
            files = []
            for stem, markdown, assets in zip(pdf["stem"], pdf["markdown"], pdf["assets"], strict=True):
                folder = os.path.join(out, stem) if subfolder else out
                for a in assets if assets is not None else ():
                    if not os.path.exists(name := os.path.join(folder, "assets", os.path.basename(a["name"]))):
                        put(name, a["content"])
                put(name := os.path.join(folder, f"{stem}.md"), markdown.encode("utf-8"))
                files.append(name)
            yield pdf[["path", "stem"]].assign(file=files)

    return converted.where("error is null").mapInPandas(write, "path string, stem string, file string")
