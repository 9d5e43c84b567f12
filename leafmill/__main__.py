"""python -m leafmill convert FILE OUT | batch FOLDER OUT [--force] | blocks FILE.md OUT | pdf FILE.md OUT.pdf"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, inputs in (("convert", ("source", "out")), ("batch", ("source", "out")), ("blocks", ("source", "out")), ("pdf", ("source", "out"))):
        p = commands.add_parser(name)
        for x in inputs:
            p.add_argument(x)
    commands.choices["batch"].add_argument("--force", action="store_true", help="convert again what was converted before")
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    if o.command == "convert":
        from leafmill.sinks.files import write_folders
        from leafmill.sources import docx

        done = docx.converted(spark.read.format("binaryFile").load(o.source)).persist()
        for r in done.where("error is not null").select("path", "error").toLocalIterator():
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
        for r in write_folders(done, o.out).toLocalIterator():
            print(r["file"])
        return int(not done.where("error is not null").isEmpty())
    if o.command == "batch":
        from leafmill.operators import convert

        rows = convert.run(spark, o.source, o.out, o.force)
        rows.show()
        return int(not rows.where("status = 'failed'").isEmpty())
    if o.command == "pdf":
        from pathlib import Path

        from leafmill.sinks.pdf import pdf

        Path(o.out).write_bytes(pdf(Path(o.source).read_text(encoding="utf-8"))[1])
        print(o.out)
        return 0
    from leafmill.functions import blocks

    texts = spark.read.text(o.source, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("markdown"))
    blocks.styled(blocks.md_blocks(texts, "path", "markdown")).write.mode("overwrite").parquet(o.out)
    print(o.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
