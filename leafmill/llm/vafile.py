"""Exact top-k inner products by vector-approximation files (Weber et al., 1998).

The file of approximations is written once: of each block of vectors, a cell number of one byte for each component, and each cell's middle and
half width. Only these are scanned: blocks of queries meet blocks of cells on a grid, and each product lies within
|q| * half width of q * middle. A vector whose upper bound is under the k-th largest lower bound of a query is none of its k
best. For what remains, exact vectors are read, in a second pass, by their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, joined, shuffle_parts

#: Vectors and queries in a block at most.
BLOCK, QUERIES = 2048, 1024
CELLS = 256
#: A bound's allowance for rounding, as a share of the sum of what was added.
ROUNDING = 1e-11


def integers(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite components are left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = df.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).where(~bad)
    return sound.select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _blocks(rows: DataFrame, size: int, body, schema: str) -> DataFrame:
    """Blocks (dim, ids, and what ``body`` makes of them) of a table (id, v): each task packs what it reads, by the vectors' lengths."""

    def pack(frames):
        held: dict[int, list] = {}
        for pdf in frames:
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == size:
                    yield block(len(v), held.pop(len(v)))
        for dim, own in held.items():
            yield block(dim, own)

    def block(dim, own):
        values = np.array([v for _, v in own], np.int64).reshape(len(own), dim)
        return pd.DataFrame({"dim": [dim], "ids": [np.array([i for i, _ in own], "<i8").tobytes()]} | {k: [x.tobytes()] for k, x in body(values).items()})

    return rows.mapInPandas(pack, f"dim int, ids binary, {schema}")


def approximation(values: np.ndarray) -> dict[str, np.ndarray]:
    """Cell numbers of a block's components, and each cell's middle and half width (cells x components), which take in all that is in it."""
    n, dim = values.shape
    x = values.astype(np.float64)
    low, high = (x.min(axis=0), x.max(axis=0)) if n else (np.zeros(dim), np.zeros(dim))
    cell = np.minimum((x - low) / np.maximum((high - low) / CELLS, 1e-9), CELLS - 1).astype(np.uint8)
    least, most = np.full((CELLS, dim), np.inf), np.full((CELLS, dim), -np.inf)
    column = np.broadcast_to(np.arange(dim), (n, dim))
    np.minimum.at(least, (cell, column), x)
    np.maximum.at(most, (cell, column), x)
    empty = least > most
    least[empty] = most[empty] = 0
    return {"cells": cell, "middle": (least + most) / 2, "half": (most - least) / 2}


def bounds(q: np.ndarray, cell: np.ndarray, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries x vectors) of the products of queries and of the vectors in these cells."""
    column = np.arange(cell.shape[1])
    m, h, size = middle[cell, column], half[cell, column], np.abs(q)
    centre = q @ m.T
    away = size @ (h + ROUNDING * (np.abs(m) + h)).T
    return centre - away, centre + away


def exact_scores(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Inner products of two tables of integers, row by row, as exact integers; an error if one passes 64 bits."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, v)]
    if most[0] * most[1] * q.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q, v).tolist()
    scores = [sum(a * b for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True)]
    if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
        raise OverflowError("an inner product passes 64 bits; a smaller scale is needed")
    return scores


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each row whose id ``every`` divides, with all other rows.

    Components are floor(``scale`` * x), of any size that a long holds, and scores are exact; one beyond 64 bits is an error. Ties go to the
    smaller id. Vectors that are null, or hold null or non-finite components, take no part; vectors of another length than the
    query's are no candidates; rows with the query's id are the query's own, and a repeated query is asked once for each of its rows. Extra columns
    are left out. Empty tables give none.
    """
    spark = df.sparkSession
    rows = integers(df, id, vector, scale)
    file = checkpointed(_blocks(rows, BLOCK, approximation, "cells binary, middle binary, half binary").withColumn("block", F.monotonically_increasing_id()))
    asked = checkpointed(rows.where(F.col("id") % every == 0).withColumn("q", F.monotonically_increasing_id()))
    # queries by their number, which tells a repeated one from another
    packed = _blocks(asked.select(F.col("q").alias("id"), F.concat("v", F.array("id")).alias("v")).coalesce(max(1, shuffle_parts(spark) // 8)), QUERIES, lambda v: {"body": v}, "body binary")
    packed = checkpointed(packed.withColumn("dim", F.col("dim") - 1))
    lanes = shuffle_parts(spark)
    # grid: each block of queries goes to every lane, each block of cells to its lane
    queries = packed.select("dim", F.col("ids").alias("q_ids"), "body", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    cells = file.select("dim", "ids", "cells", "middle", "half", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"))

    def scan(frames):
        """What may be among the k best of the vectors in a block; no state goes from one block to the next."""
        for pdf in frames:
            for r in pdf.itertuples():
                ids, numbers = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                q = np.frombuffer(r.body, "<i8").reshape(len(numbers), r.dim + 1)
                cell = np.frombuffer(r.cells, np.uint8).reshape(len(ids), r.dim)
                middle, half = (np.frombuffer(x, np.float64).reshape(CELLS, r.dim) for x in (r.middle, r.half))
                low, high = bounds(q[:, :-1].astype(np.float64), cell, middle, half)
                other = ids[None, :] != q[:, -1:]
                low[~other] = -np.inf
                if len(ids) > k:
                    other &= high >= np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k : len(ids) - k + 1]
                i, j = np.nonzero(other)
                yield pd.DataFrame({"q": numbers[i], "vec_id": ids[j], "low": low[i, j], "high": high[i, j]})

    near = checkpointed(queries.join(cells, ["lane", "dim"]).mapInPandas(scan, "q long, vec_id long, low double, high double"))
    # the k-th largest lower bound of all blocks; rows that can't be among a task's first k of a query stay in the task
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "vec_id"))
    least = near.withColumn("place", place).where(F.col("place") <= k).groupBy("q").agg(F.when(F.count("*") == k, F.min("low")).otherwise(float("-inf")).alias("least"))
    left = checkpointed(near.join(least, "q").where("high >= least").select("q", "vec_id").distinct())
    wanted = joined(rows.withColumnRenamed("id", "vec_id"), left.select("vec_id").distinct(), ["vec_id"], "left_semi")

    @F.pandas_udf("long")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), np.int64)
        dims = a.map(len)
        for d in dims.unique():
            at = np.flatnonzero(dims == d)
            out[at] = exact_scores(*(np.array(x.iloc[at].tolist(), np.int64).reshape(len(at), d) for x in (a, b)))
        return pd.Series(out)

    pairs = left.join(wanted.withColumnRenamed("v", "other"), "vec_id").join(asked, "q").where(F.size("v") == F.size("other"))
    found = pairs.select("q", F.col("id").alias("query_id"), "vec_id", score("v", "other").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
