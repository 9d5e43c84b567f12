"""Rows that a worker makes of each row, sent in batches of even size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text and content that a batch has at least, unless it is the last one.
BATCH_BYTES = 4 << 20
KINDS = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def _bytes(x) -> int:
    if isinstance(x, (str, bytes)):
        return len(x)
    return sum(map(_bytes, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list, tuple)) else 8


def _kind(ddl: str) -> pa.DataType:
    if ddl.startswith("array<struct<"):
        return pa.list_(pa.struct([(name, _kind(kind)) for name, kind in (x.split(": ") for x in ddl[len("array<struct<") : -2].split(", "))]))
    return KINDS[ddl]


def made(df: DataFrame, columns: list[str], make: Callable[..., list[tuple]], schema: list[tuple[str, str]]) -> DataFrame:
    """The rows that ``make`` gives for the values of ``columns`` of each row of ``df``. Small rows share a batch, since each batch has its price; a batch is
    sent as soon as it is full, so a large row waits for no others."""
    out = pa.schema([(name, _kind(kind)) for name, kind in schema])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for found in batches:
            for values in zip(*(found.column(c) for c in columns), strict=True):
                more = make(*(v.as_py() for v in values))
                rows += more
                held += _bytes(more)
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return df.select(*columns).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in schema))
