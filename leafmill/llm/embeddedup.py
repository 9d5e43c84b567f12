"""Embedding near-duplicates: iterative quantisation (Gong & Lazebnik, 2011), multi-index Hamming tables, exact reranking.

A rotation learnt on a bounded sample makes balanced binary codes of one bit for each component. The code is cut into substrings; each is a
table. Vectors whose codes differ in at most ``radius`` bits agree in one substring but for its threshold (the thresholds and 1 each sum to
``radius`` + 1). What meets in a bucket are codes, a bit for each component; only vectors whose code is near another's there follow them, to be compared
in double precision. A pair counts in the first table in which it meets.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, components, forest, grouped

#: Vectors by which the rotation is learnt, and rounds.
SAMPLE, ROUNDS = 4096, 30
#: Rows of a bucket that one group compares at most; larger buckets are cut, and their parts meet two by two.
PART = 512
#: Microseconds of a row that goes to a bucket, and of a pair of codes.
ROW_COST, PAIR_COST = 1.0, 0.002


def learn_rotation(sample: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (components x bits) that bring centred vectors close to the corners of a cube."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    x = x @ axes
    r = np.linalg.qr(np.random.default_rng(42).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds if len(sample) else 0):
        u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return mean, axes @ r


def tables(bits: int, rows: int, radius: int) -> list[tuple[int, int, int]]:
    """Substrings (from, to, threshold), whose thresholds sum with 1 each to ``radius`` + 1 at any size: as many as cost the least.

    Cost: a row for each bucket that a vector goes to, and the pairs that random codes make there. A substring no longer than its
    threshold is one bucket for all (threshold -1).
    """
    best = None
    for count in range(1, max(1, min(radius + 1, bits)) + 1):
        base, more = divmod(radius + 1, count)
        edges = [round(i * bits / count) for i in range(count + 1)]
        found = [(a, b, base - 1 + (i < more)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]  # noqa: B905
        found = [(a, b, t if t < b - a else -1) for a, b, t in found]
        signatures = [sum(math.comb(b - a, k) for k in range(max(t, 0) + 1)) for a, b, t in found]
        share = sum(n / 2.0 ** (b - a if t >= 0 else 0) for n, (a, b, t) in zip(signatures, found, strict=True))
        cost = ROW_COST * rows * sum(signatures) + PAIR_COST * rows * rows * share
        if best is None or cost < best[0]:
            best = cost, found
    return best[1]


def flips(width: int, threshold: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``threshold`` bits set at most, 0 first."""
    sets = (c for k in range(max(threshold, 0) + 1) for c in itertools.combinations(range(width), k))
    return np.array([sum(1 << i for i in c) for c in sets], np.int64)


def _met_here(a, b, i, j, tab: list, t: int) -> np.ndarray:
    """Which of the pairs of rows (i of a, j of b) in a bucket of table t count there: not those that an earlier table or another bucket has.

    Rows: ids, exact flags, own substrings as numbers (rows x tables).
    """
    keep = (a["id"][i] != b["id"][j]) & (a["exact"][i] | b["exact"][j])
    x = a["parts"][i] ^ b["parts"][j]
    if tab[t][2] >= 0:  # a pair that differs in the substring meets in several buckets: it counts in that of the smaller id's own value
        home = np.where(a["exact"][i], a["id"][i], b["id"][j])
        keep &= (x[:, t] == 0) & (a["exact"][i] & b["exact"][j]) | (x[:, t] != 0) & (home == np.minimum(a["id"][i], b["id"][j]))
    for s in range(t):
        keep &= (np.bitwise_count(x[:, s]) > tab[s][2]) & (tab[s][2] >= 0)
    return keep


def near_duplicates(df: DataFrame, threshold: float = 0.98, radius: int = 9, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors of one label, linked by a cosine of at least ``threshold``.

    Pairs whose codes differ in more than ``radius`` bits are missed, in a table of any size; none below the threshold is linked. Vectors that are null
    or zero, or hold null or non-finite components, and rows with a null label or id, link with nothing. Labels may have any type that can be compared.
    Equal vectors of a label are one node with a count, so copies cost nothing and always link. Vectors of different lengths don't link; lengths
    that few vectors have (all but the 64 most frequent) get codes of no bits, so all of one label and length are compared. Repeated rows come out
    as often as they came in; extra columns are left out. Empty tables give none.
    """
    kind = df.schema[label].dataType.simpleString()
    source = df.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    sound = source.where("id is not null and label is not null and v is not null").where(~bad)
    sound = sound.select("id", "label", F.transform("v", lambda x: x + F.lit(0).cast(df.schema[vector].dataType.elementType)).alias("v"))  # -0.0 and 0.0 are equal
    # equal vectors are told by 128 bits of two hashes
    own = ["label", "k0", "k1"]
    sound = sound.select("id", "label", "v", F.xxhash64("v").alias("k0"), F.xxhash64(F.lit(1), "v").alias("k1"))
    nodes = sound.groupBy(*own).agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    size = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    dims = [r[0] for r in nodes.groupBy(F.size("v")).count().orderBy(F.desc("count")).limit(64).collect()]
    rotations = {}
    for d in dims:
        sample = nodes.where(F.size("v") == d).orderBy("k0", "k1").limit(SAMPLE).select("v").toPandas()["v"]
        rotations[d] = learn_rotation(unit(np.array(sample.tolist(), np.float64).reshape(len(sample), d)))
    plan = {d: tables(d, size, radius) for d in dims}

    def parts_of(codes, dim: int) -> np.ndarray:
        """The substrings of codes (packed bits) as numbers."""
        bits = np.unpackbits(codes, axis=1, bitorder="little").astype(np.int64)
        return np.stack([bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b, _ in plan.get(dim, [(0, 0, -1)])], axis=1)

    def unpacked(col: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(col), np.uint8).reshape(len(col), -1)

    def coded(frames):
        for pdf in frames:
            for d, part in pdf.groupby(pdf["v"].map(len)):
                bits = np.zeros((len(part), 1), bool)  # for a length without a rotation
                if d in rotations:
                    mean, r = rotations[d]
                    bits = (unit(np.array(part["v"].tolist(), np.float64)) - mean) @ r >= 0
                yield part[["label", "node"]].assign(dim=d, code=[x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")])

    def probe(frames):
        for pdf in frames:
            for d, part in pdf.groupby("dim"):
                own = parts_of(unpacked(part["code"]), d)
                for t, (a, b, least) in enumerate(plan.get(d, [(0, 0, -1)])):
                    for flip in flips(b - a, least):
                        yield part.assign(t=t, exact=flip == 0, bucket=own[:, t] ^ flip if least >= 0 else 0)

    #: of each vector its codes; of each table the bucket of its own substring, and those of all that its threshold allows
    rows = checkpointed(nodes.mapInPandas(coded, f"label {kind}, node long, dim int, code binary"))
    probes = rows.mapInPandas(probe, f"label {kind}, node long, dim int, code binary, t int, exact boolean, bucket long")
    at = ["label", "dim", "t", "bucket"]
    sizes = probes.groupBy(*at).agg(F.count("*").alias("rows"), F.count_if("exact").alias("whole")).where("rows > 1 and whole > 0").select(*at, F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0).cast("int")
    met = probes.join(sizes, at).withColumn("p", part).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = [*at, "p0", "p1"]
    met = met.select(*at, F.least("p", "o").alias("p0"), F.greatest("p", "o").alias("p1"), "p", "node", "exact", "code")

    def sides(g: pd.DataFrame):
        """A cell's rows twice, or those of its two parts."""
        code = unpacked(g["code"])
        rows = {"id": g["node"].to_numpy(), "exact": g["exact"].to_numpy(), "code": code, "parts": parts_of(code, int(g["dim"].iat[0])), "row": np.arange(len(g))}
        if g["p0"].iat[0] == g["p1"].iat[0]:
            return rows, rows, True
        first = (g["p"] == g["p0"]).to_numpy()
        return *({k: x[m] for k, x in rows.items()} for m in (first, ~first)), False

    def pairs(g: pd.DataFrame, far: int):
        """Pairs of a cell's rows that count there and whose codes differ in ``far`` bits at most."""
        a, b, same = sides(g)
        d, t = int(g["dim"].iat[0]), int(g["t"].iat[0])
        apart = np.zeros((len(a["id"]), len(b["id"])), np.int16)
        for x, y in zip(a["code"].T, b["code"].T, strict=True):
            apart += np.bitwise_count(x[:, None] ^ y[None, :])
        i, j = np.nonzero(apart <= far)
        if same:
            i, j = i[i < j], j[i < j]
        keep = _met_here(a, b, i, j, plan.get(d, [(0, 0, -1)]), t)
        return a["row"][i[keep]], b["row"][j[keep]]

    def candidates(frames):
        for found in grouped(frames, cells, lambda g: g.iloc[np.unique(np.concatenate(pairs(g, radius)))] if len(g) > 1 else g.iloc[:0]):
            if found:
                yield pd.concat(found)

    sort = lambda df: df.repartition(*cells).sortWithinPartitions(*cells, "node", "exact")
    near = sort(met).mapInPandas(candidates, met.schema)
    vectors = sort(near.join(nodes.select("node", "n", "v"), "node").select(*cells, "p", "node", "n", "exact", "code", "v"))

    def linked(g: pd.DataFrame):
        """Each node's links, counted with copies, and enough of them to join all."""
        i, j = pairs(g, radius)
        u, node, n = unit(np.array(g["v"].tolist(), np.float64)), g["node"].to_numpy(), g["n"].to_numpy()
        sims = u @ u.T
        keep = sims[i, j] >= threshold
        i, j = i[keep], j[keep]
        counts = np.bincount(np.r_[i, j], np.r_[n[j], n[i]].astype(float), minlength=len(g)).astype(np.int64)
        some = np.flatnonzero(counts)
        return [(x, None, w) for x, w in zip(node[some].tolist(), counts[some].tolist(), strict=True)] + [(x, y, None) for x, y in forest(node[i], node[j])]

    def compare(frames):
        for found in grouped(frames, cells, linked):
            yield pd.DataFrame([x for rows in found for x in rows], columns=["a", "b", "n"]).astype("Int64")

    links = checkpointed(vectors.mapInPandas(compare, "a long, b long, n long"))
    counts = links.where("n is not null").groupBy("a").agg(F.sum("n").alias("far")).withColumnRenamed("a", "node")
    comp = components(links.where("b is not null").select("a", "b"))
    classes = nodes.join(comp, "node", "left").join(counts, "node", "left").select(*own, "least", F.coalesce("component", "node").alias("comp"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    smallest = classes.groupBy("comp").agg(F.min("least").alias("component"))
    classes = classes.join(smallest, "comp").select(*own, "component", "links")
    members = sound.select("id", *own).join(classes, own).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    others = source.where(F.coalesce(bad, F.lit(True)) | F.expr("id is null or label is null")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return members.unionAll(others).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)
