"""What the corpus operators share: reading tables, cutting lineage, sizing work, connected components."""

from __future__ import annotations

import itertools
import math
import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.tables import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that go to Python at a time, unless the session says: whole texts may be long.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it; the path may be in any store that Spark knows."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the session was started without it on its path."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env, have = spark.sparkContext.environment, os.environ.get("PYTHONPATH", "")
    if ROOT not in env.get("PYTHONPATH", have).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", have), ROOT) if x)
    if ROOT not in sys.path:
        sys.path.append(ROOT)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing of it.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, as in tests, a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def trim() -> None:
    """Gives a worker's free memory back to the system, so that idle workers hold little."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def keep_oldest(cache: dict, n: int) -> None:
    """Drops all but the first ``n`` entries: of words that are learnt as they come, the first are the frequent ones."""
    for k in list(itertools.islice(cache, n, None)):
        del cache[k]


def ending(results: Iterator, *forget: Callable[[], None]) -> Iterator:
    """The results of a task; at its end a worker, which goes on to other tasks, forgets what it has kept for this one."""
    try:
        yield from results
    finally:
        for f in forget:
            f()
        trim()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, mb: float, text: str) -> int:
    """How many groups of about ``mb`` of stored input ``df`` makes: in proportion to the optimizer's size estimate, or, where it has none, to half
    the bytes of ``text``, which are then counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2
    return max(shuffle_parts(df.sparkSession), math.ceil(size / (mb * 1e6)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` is called so."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


#: Bodies that one group adds at a time.
FAN = 64


def tree_added(rows: DataFrame, add: Callable) -> DataFrame:
    """``rows`` (part, body), some from each task: one of each part, by ``add`` of a list of bodies. In three levels, so that a group of the first two
    adds FAN bodies, and the last one of FAN * FAN tasks each."""

    def one(pdf):
        return pdf.iloc[:1].assign(body=[add(pdf["body"].tolist())])

    schema = "part int, lane long, body binary"
    rows = rows.select("part", F.spark_partition_id().cast("long").alias("lane"), "body")
    for span in (FAN, FAN, None):
        lane = F.floor(F.col("lane") / span) if span else F.lit(0)
        rows = rows.withColumn("lane", lane.cast("long")).groupBy("part", "lane").applyInPandas(one, schema)
    return rows.select("part", "body")


#: Rows of a narrow side (a few numbers each) that are sent to every task at most; beyond, both sides are shuffled.
SENT_ROWS = 200_000


def joined(big: DataFrame, narrow: DataFrame, on: list[str], how: str) -> DataFrame:
    """``big`` semi- or anti-joined with ``narrow``, which is counted first: sent to every task only if it has at most SENT_ROWS rows."""
    narrow = checkpointed(narrow.select(*on))
    return big.join(F.broadcast(narrow) if narrow.count() <= SENT_ROWS else narrow.hint("merge"), on, how)


def grouped(frames: Iterator, by: list[str], f: Callable) -> Iterator[list]:
    """``f`` of each whole group of rows that come sorted by ``by``, a list for each batch; a group may go on in the next batch."""
    import numpy as np
    import pandas as pd

    held = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        key = pdf[by].to_numpy()
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        yield [f(pdf.iloc[s:e]) for s, e in zip(new, new[1:])]  # noqa: B905
        held = pdf.iloc[new[-1] :]
    if held is not None and len(held):
        yield [f(held)]


def forest(a, b) -> list[tuple[int, int]]:
    """A spanning forest of links, so that a dense group sends on as many rows as it has members."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


#: Links that one task joins; beyond, stars are formed by all.
JOINED_LINKS = 500_000


def joined_links(frames: Iterator) -> Iterator:
    """(node, component) of the links (hi, lo) of one task: roots take the least root that a link leads to, until none changes."""
    import numpy as np
    import pandas as pd

    links = [pdf.to_numpy(np.int64) for pdf in frames if len(pdf)]
    if not links:
        return
    nodes, ends = np.unique(np.concatenate(links), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (open_ := root[a] != root[b]).any():
        a, b = a[open_], b[open_]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"node": nodes, "component": nodes[root]})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each node of an undirected graph, as rows ``(node, component)``.

    ``edges`` has long columns ``a`` and ``b``. Up to JOINED_LINKS distinct links, one task joins them. Beyond, alternates the
    large-star and small-star steps (Kiveris et al., 2014) until every node hangs on its component's smallest node: O(log^2 n) rounds,
    each of joins and aggregations that combine before the shuffle. Nothing but counts goes to the driver. Nodes without an edge don't come
    out. An empty table gives none. Raises if ``rounds`` aren't enough.
    """
    stars = checkpointed(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    if stars.count() <= JOINED_LINKS:
        return checkpointed(stars.coalesce(1).mapInPandas(joined_links, "node long, component long"))
    for _ in range(rounds):
        # a node that hangs on two nodes, or on one that itself hangs on another
        ends = stars.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(stars.select("lo", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0]:
            break
        # large star: each neighbour above u goes to the least node around u
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
            .distinct()
        )
        # small star: every lower neighbour of u, and u itself, goes to the least of them
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(floor, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = checkpointed(moved.unionAll(floor.select("hi", F.col("m").alias("lo"))).distinct())
    else:
        raise RuntimeError(f"components aren't whole after {rounds} rounds")
    roots = stars.select(F.col("lo").alias("node")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
