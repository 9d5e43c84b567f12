"""SimHash near-duplicates by generalised pigeonhole search (GPH; Qin et al., 2018).

A fingerprint of 64 bits stands for each text. Two fingerprints within ``radius`` bits of each other agree, in at least one
part i of the bits, up to t[i] bits, whenever the t[i] add up to ``radius`` - parts + 1. Bits that vary together go into the
same part, and the t[i] are chosen by dynamic programming over estimated costs, so they may differ, and a part may be left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, components, ending, forest, grouped, joined, keep_oldest, unused

BITS = 64
#: Hashes whose bits are counted at a time.
STEP = 255 * 64
#: Fingerprints by which the parts and thresholds are chosen; results don't depend on it, only their cost.
SAMPLE = 2048
#: Buckets up to this many distinct fingerprints are compared pair by pair; those beyond go by midpoints.
BUCKET = 64


def fingerprints(texts, shingle: int = 3) -> np.ndarray:
    """Of each text (None: empty): a bit is 1 if set in over half of the XXH64 (seed 42) of its word shingles."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    for n, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if len(words) < shingle:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)
        out[n] = weights[2 * bit_counts(hashes[:, None]) > len(hashes)].sum(dtype=np.uint64)
    return out


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of unsigned 64-bit numbers; sums of 255 rows fit a byte."""
    out = np.zeros(BITS * rows.shape[1], np.int64)
    for at in range(0, len(rows), STEP):
        bits = np.unpackbits(np.ascontiguousarray(rows[at : at + STEP]).view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out += bits[whole:].sum(axis=0, dtype=np.uint8)
    return out


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with a long column ``_fp``; a null or empty text has fingerprint 0."""

    @F.pandas_udf("long")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(s.tolist(), shingle).view(np.int64))

    return docs.withColumn("_fp", fp(F.col(text)))


def plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts of the bits, each with its threshold (those with -1 left out), for ``n`` fingerprints like ``sample`` (uint64).

    Cost: signatures to write, and pairs expected to meet, as distances in the sample and an even spread of the bits give.
    """
    bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    if len(bits) < 2:
        bits = np.vstack([bits, np.zeros((2, BITS)), np.ones((2, BITS))])
    with np.errstate(invalid="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T)))
    rng = np.random.default_rng(42)
    left, right = rng.integers(0, len(bits), (2, 200_000))
    differ = bits[left[left != right]] != bits[right[left != right]]
    best = None
    for parts in range(1, radius + 2):
        size, free, groups = -(-BITS // parts), set(range(BITS)), []
        while free:  # greedily: each part starts at the lowest free bit and takes those that vary with it
            seed = min(free)
            take = sorted(free, key=lambda j: (j != seed, -corr[seed, j], j))[:size]
            groups.append(sorted(take))
            free -= set(take)
        cost = []
        for g in groups:
            d = differ[:, g].sum(axis=1)
            row = [0.0]
            for t in range(radius + 1):
                signatures = sum(_choose(len(g), k) for k in range(t + 1))
                chance = max((d <= t).mean() - 3e-4, signatures / 2.0 ** len(g))
                row.append(n * signatures * 4 + n * float(n) * chance / 2)
            cost.append(row)
        total = radius - len(groups) + 1  # what the thresholds must add up to
        state = {0: (0.0, ())}
        for row in cost:  # thresholds from -1 (left out) to radius
            state = _next(state, row, radius)
        value = state.get(total + len(groups))  # sums of t + 1
        if value and (best is None or value[0] < best[0]):
            best = (value[0], [(g, t) for g, t in zip(groups, value[1], strict=True) if t >= 0])
    return best[1]


def _choose(n: int, k: int) -> int:
    return math.comb(n, k)


def _next(state: dict, row: list[float], radius: int) -> dict:
    out: dict = {}
    for (used, (cost, chosen)), t in itertools.product(state.items(), range(-1, radius + 1)):
        key, value = used + t + 1, (cost + row[t + 1], (*chosen, t))
        if key not in out or value[0] < out[key][0]:
            out[key] = value
    return out


def _signatures(fps: np.ndarray, parts: list[tuple[list[int], int]]):
    """Rows (index of the fingerprint, key, exact): for each part its value and, up to its threshold, values with bits flipped."""
    for p, (bits, t) in enumerate(parts):
        mask = np.uint64(sum(1 << b for b in bits))
        own = fps & mask
        for k in range(t + 1):
            for flip in itertools.combinations(bits, k):
                yield p, own ^ np.uint64(sum(1 << b for b in flip)), k == 0


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Enough pairs ``(a, b)`` of ids, linked at ``radius`` or fewer differing bits, to connect all that are so linked.

    ``fps`` has ``id`` (long) and ``fp`` (long), each fingerprint once. Buckets of signatures are verified pair by pair while they
    hold at most ``BUCKET`` fingerprints. Those of larger ones are joined exactly by midpoints: two fingerprints are within 2 r
    (2 r + 1) bits just if balls of radius r (r and r + 1) around them meet, and all that meet in a point are linked, so a star is enough.
    """
    spark = fps.sparkSession
    n = fps.count()
    # a spread of the fingerprints without order, the same each time
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan(sample, n, radius)

    def probe(frames):
        for pdf in frames:
            f = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for p, key, exact in _signatures(f, parts):
                yield pd.DataFrame({"p": np.int8(p), "key": key.view(np.int64), "id": pdf["id"].to_numpy(), "fp": f.view(np.int64), "exact": exact})

    probes = fps.mapInPandas(probe, "p byte, key long, id long, fp long, exact boolean")
    sizes = probes.groupBy("p", "key").agg(F.count("*").alias("n"), F.count_if("exact").alias("x")).where("n > 1 and x > 0")
    met = probes.join(sizes.where(F.col("n") <= BUCKET).select("p", "key"), ["p", "key"])
    near = _near(met, radius)
    hot = probes.join(sizes.where(F.col("n") > BUCKET).select("p", "key"), ["p", "key"], "left_semi").select("id", "fp").distinct()
    return near.unionAll(_midpoints(hot, radius)).distinct()


def _near(met: DataFrame, radius: int) -> DataFrame:
    """The linked pairs of each bucket of at most BUCKET rows; combined before the shuffle, each group is bounded."""
    group = met.groupBy("p", "key").agg(F.collect_list(F.struct("id", "fp", "exact")).alias("m"))
    left = group.select(F.explode("m").alias("x"), "m").select("x", F.expr("filter(m, y -> y.id > x.id and (x.exact or y.exact) and bit_count(x.fp ^ y.fp) <= %d)" % radius).alias("m"))
    return left.select(F.col("x.id").alias("a"), F.explode("m.id").alias("b"))


def _midpoints(hot: DataFrame, radius: int) -> DataFrame:
    low, high = radius // 2, radius - radius // 2
    balls = [sum(1 << b for b in flip) for k in range(high + 1) for flip in itertools.combinations(range(BITS), k)]
    near = sum(_choose(BITS, k) for k in range(low + 1))
    flips = np.array(balls, np.uint64)

    def ball(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 512):
                f, ids = pdf["fp"].to_numpy(np.int64).view(np.uint64)[at : at + 512], pdf["id"].to_numpy()[at : at + 512]
                for q in range(0, len(flips), 128):
                    x = flips[q : q + 128]
                    yield pd.DataFrame({"key": (f[:, None] ^ x[None, :]).ravel().view(np.int64), "id": np.repeat(ids, len(x)), "inner": np.tile(np.arange(q, q + len(x)) < near, len(f))})

    points = hot.mapInPandas(ball, "key long, id long, inner boolean")
    # an odd radius: only an inner and an outer ball make a link, so the least inner id is the centre
    centre = points.groupBy("key").agg(F.min(F.when(F.col("inner"), F.col("id"))).alias("a"), F.max(F.when(F.col("inner"), F.col("id"))).alias("z"), F.count("*").alias("n")).where("n > 1 and a is not null")
    if low == high:  # even: all in the point are linked; the members' least is theirs for each key
        return points.join(centre.where("a <> z").select("key", "a"), "key").where("id <> a").select("a", F.col("id").alias("b"))
    return points.join(centre.select("key", "a"), "key").where("id <> a").select("a", F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, ``fp`` (long) and ``component``: the smallest id reachable over texts within ``radius`` bits.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id get a null component
    (they never link others). Equal fingerprints are one node, so copies cost nothing. Repeated rows come out as often as they came in.
    """
    prints = checkpointed(with_fingerprint(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("_text")), shingle, "_text").select("id", F.col("_fp").alias("fp")))
    nodes = checkpointed(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("least")))
    # links between fingerprints: an id may stand for several texts
    comp = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius)).withColumnRenamed("node", "fp")
    reached = comp.join(nodes, "fp")
    least = reached.groupBy("component").agg(F.min("least").alias("_least"))
    classes = nodes.join(reached.join(least, "component").select("fp", "_least"), "fp", "left").select("fp", F.coalesce("_least", "least").alias("component"))
    # the classes are few beside the rows; a hot one is split by the adaptive join
    return prints.join(classes, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- documents of a given similarity

#: Least hashes of a text's shingles that make a key together, and keys of a text. Two texts share a key with the probability
#: 1 - (1 - J ** LEAST) ** KEYS: 0.997 at a similarity J of 0.8, in a table of any size.
LEAST, KEYS = 3, 8
#: Texts, and shingles of texts, of a key that one group compares at most.
PART, PART_GRAMS = 256, 400_000
#: Texts that stand for a group of a key's texts when groups are merged.
FEW = 4
#: Rounds that merge a key's groups before the last; each may merge PART / FEW of them.
MERGES = 2
#: Columns of the matrix by which shared shingles are counted.
WIDE = 4096
MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
CACHE = 200_000
_words: dict[bytes, int] = {}


def forget() -> None:
    _words.clear()


def _learn(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    if len(_words) > CACHE:
        keep_oldest(_words, CACHE // 2)
    _words[word] = h = xxh64_intdigest(word, 42)
    return h


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of a text's distinct word shingles, sorted; of fewer words, the whole sequence is one; of none, there are none."""
    get, words = _words.get, (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter((h if (h := get(x)) is not None else _learn(x) for x in words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    out = np.full(n, min(len(w), shingle), np.uint64)
    for i in range(min(len(w), shingle)):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX[0]) + w[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(MIX[1])
    return np.unique(out ^ (out >> np.uint64(29)))


def keys_of(grams: np.ndarray) -> list[int]:
    """KEYS numbers, each of the LEAST least values of as many hashes of a text's shingles."""
    out = []
    for k in range(KEYS):
        key = k + 1
        for i in range(LEAST):
            h = grams * np.uint64(MIX[k % len(MIX)] + 2 * (k * LEAST + i))
            h ^= h >> np.uint64(29)
            h *= np.uint64(MIX[1])
            least = int(h.min())
            key = ((key ^ least) * MIX[2] + (least >> 32)) & (1 << 64) - 1
        out.append(key - (key >> 63 << 64))
    return out


def long_fingerprint(grams: np.ndarray) -> list[int]:
    """A SimHash of 128 bits as two numbers."""
    h = np.stack([(x := grams * np.uint64(m)) ^ (x >> np.uint64(31)) for m in MIX[:2]], axis=1)
    votes = 2 * bit_counts(h) > len(grams)
    return np.packbits(votes, bitorder="little").view(np.int64).tolist()


def most_bits(similarity: float, bits: int = 128) -> int:
    """Bits in which fingerprints of texts of this similarity differ at most (3.6 deviations above the mean)."""
    even = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * even + 3.6 * math.sqrt(bits * even * (1 - even)))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sets (sorted, without repeats) share."""
    total = np.zeros((len(sets), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    shared = ~(new & np.r_[new[1:], True])  # not in one set only
    column, owner = np.cumsum(new[shared]) - 1, owner[shared]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        lo, hi = np.searchsorted(column, (at, at + WIDE))
        x = np.zeros((len(sets), WIDE), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        total += x @ x.T
    return total


def _near_pairs(g: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links between the texts of a group that aren't linked yet: enough to join all that are near, so no more than texts.

    Where ``side`` 1 stands, its texts are compared with those of side 0, else all with each other.
    """
    sets = [np.frombuffer(x, np.uint64) for x in g["grams"]]
    met, size = overlaps(sets), np.array([len(x) for x in sets])
    comp, node, side = (g[c].to_numpy() for c in ("comp", "node", "side"))
    near = met >= similarity * (size[:, None] + size[None, :] - met) - 1e-6
    near &= comp[:, None] != comp[None, :]
    near &= side[:, None] < side[None, :] if side.any() else np.tri(len(g), k=-1, dtype=bool).T
    i, j = np.nonzero(near)
    return forest(node[i], node[j])


def _linked(cells: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the texts in each cell (key, p, q, side, node, comp)."""
    at = ["key", "p", "q"]
    rows = cells.join(grams, "node").select(*at, "side", "node", "comp", "grams").repartition(*at).sortWithinPartitions(*at, "side", "node")

    def compare(frames):
        for found in grouped(frames, at, lambda g: _near_pairs(g, similarity)):
            yield pd.DataFrame([x for pairs in found for x in pairs], columns=["a", "b"], dtype="int64")

    return checkpointed(rows.mapInPandas(lambda frames: ending(compare(frames)), "a long, b long"))


def _spread(rows: DataFrame, parts: Column) -> DataFrame:
    """Each row (key, node, comp) in a part of its key."""
    return rows.select("key", F.pmod(F.xxhash64("node"), parts).cast("int").alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "node", "comp")


def _parts(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / PART), F.ceil(size / PART_GRAMS), F.lit(1)).cast("int")


def _open(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (key, node, n_grams, comp) of the keys whose texts aren't all linked."""
    comp = components(edges)
    rows = rows.select("key", "node", "n_grams").join(comp.withColumnRenamed("component", "comp"), "node", "left").select("key", "node", "n_grams", F.coalesce("comp", "node").alias("comp"))
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return checkpointed(rows.join(several.select("key"), "key"))


def _few(rows: DataFrame) -> DataFrame:
    """FEW texts at most of each group of two or more of a key's texts."""
    some = rows.groupBy("key", "comp", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(FEW)).alias("k")).agg(F.min(F.struct("node", "n_grams")).alias("x"), F.count("*").alias("n"))
    large = some.groupBy("key", "comp").agg(F.sum("n").alias("all")).where("all > 1").select("key", "comp")
    some = some.join(large, ["key", "comp"]).select("key", "comp", "x.*")
    sizes = some.groupBy("key").agg(_parts(F.count("*"), F.sum("n_grams")).alias("parts"))
    return _spread(some.join(sizes, "key"), F.col("parts"))


def _sweep(rows: DataFrame) -> DataFrame:
    """Cells in which all texts of a key outside its largest group meet all texts of the key, part by part."""
    groups = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_grams").alias("size"))
    keys = groups.groupBy("key").agg(F.max(F.struct("n", "size", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    keys = keys.select("key", F.col("main.comp").alias("main"), _parts(F.col("n"), F.col("size")).alias("ps"), _parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("qs"))
    rows = rows.join(keys, "key")
    every = F.sequence(F.lit(0), F.col("qs") - 1)
    one = rows.select("key", F.pmod(F.xxhash64("node"), F.col("ps")).cast("int").alias("p"), F.explode(every).alias("q"), F.lit(0).alias("side"), "node", "comp")
    other = rows.where(F.col("comp") != F.col("main")).select("key", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), F.pmod(F.xxhash64("node"), F.col("qs")).cast("int").alias("q"), F.lit(1).alias("side"), "node", "comp")
    return one.unionAll(other)


def _within(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join all nodes (node, print) whose fingerprints differ in ``radius`` bits or fewer, by pigeonhole search."""
    prints = checkpointed(nodes.groupBy(F.col("print").alias("fp")).agg(F.min("node").alias("id")))
    equal = nodes.join(prints, F.col("print") == F.col("fp")).where("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return checkpointed(equal.unionAll(links(prints.select("id", "fp"), radius)))


def same_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id: str = "doc_id", text: str = "text", radius: int | None = None) -> DataFrame:
    """(id, node, keeper) of each row: ``node`` stands for its text, ``keeper`` tells the row that stays of each group of near copies.

    Texts are near if the Jaccard similarity of their sets of word shingles is at least ``similarity``; it is computed from all shingles of all
    candidates. Candidates share a key (see KEYS); keys that have the same texts count once, and those of two texts whose fingerprints differ in
    more bits than such texts do (3.6 deviations) don't count. A key's texts are compared in parts: first within each part,
    then a few of each group found, and at last each text outside the key's largest group with all, so that no candidate is left out
    and a group of n near copies costs in proportion to n. Only texts that a key holds but that are not near cost the square of their number.
    The row with the smallest id stays (nulls last, then the smallest node); of repeated rows each is told to stay. Texts without words
    are near only to equal ones.

    ``radius``: texts are near, too, if their fingerprints of 64 bits (see ``fingerprints``) differ in so many bits or fewer. All such are found,
    by ``links``, and join the groups of the others; None: fingerprints aren't looked at.
    """
    most = most_bits(similarity)

    @F.pandas_udf("n_grams int, fp array<long>, keys array<long>, print long")
    def sketched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def some(s):
            found = pd.DataFrame([(len(g), long_fingerprint(g), keys_of(g)) if len(g := shingles(t, shingle)) else (0, None, None) for t in s], columns=["n_grams", "fp", "keys"])
            return found.assign(print=0 if radius is None else fingerprints(s.tolist()).view(np.int64))

        return ending(map(some, texts), forget)

    @F.pandas_udf("binary")
    def grams_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return ending((s.map(lambda t: shingles(t, shingle).tobytes()) for s in texts), forget)

    own = docs.select(F.col(id).cast("long").alias("id"), node_of(text).alias("node"), F.col(text).alias("_text"))
    rows = checkpointed(own.select("id", "node", sketched("_text").alias("s")))
    nodes = checkpointed(rows.groupBy("node").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("least"), F.any_value("s").alias("s")))
    probes = nodes.where("s.n_grams > 0").select("node", "least", "s.n_grams", "s.fp", F.explode("s.keys").alias("key"))
    keys = probes.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("n_grams").alias("size"), *(F.bit_xor(F.get("fp", F.lit(i))).alias(f"f{i}") for i in range(2)), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2))
    )
    keys = keys.where(f"n > 2 or n = 2 and bit_count(f0) + bit_count(f1) <= {most}").groupBy("n", "x0", "x1").agg(F.min(F.struct("key", "size")).alias("k"))
    met = checkpointed(probes.join(keys.select("k.key", _parts(F.col("n"), F.col("k.size")).alias("parts")), "key").select("key", "node", "least", "n_grams", "parts"))
    asked = met.select("node", F.col("least").alias("_id")).distinct()
    bodies = joined(own.withColumn("_id", F.coalesce("id", F.lit(NO_ID))), asked, ["node", "_id"], "left_semi")
    grams = checkpointed(bodies.groupBy("node").agg(F.any_value(grams_of("_text")).alias("grams")))

    edges = _linked(_spread(met.withColumn("comp", F.col("node")), F.col("parts")), grams, similarity)
    rest = _open(met.where("parts > 1"), edges)
    for turn in range(MERGES + 1):
        if rest.isEmpty():
            break
        edges = edges.unionAll(_linked(_few(rest) if turn < MERGES else _sweep(rest), grams, similarity))
        if turn < MERGES:
            rest = _open(rest, edges)
    if radius is not None:
        edges = edges.unionAll(_within(nodes.where("s.n_grams > 0").select("node", "s.print"), radius))
    comp = components(edges)
    classes = nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    stays = classes.groupBy("component").agg(F.min(F.struct("least", "node")).alias("_k"))
    classes = classes.join(stays, "component").select("node", "_k")
    return rows.select("id", "node").join(classes, "node").select("id", "node", ((F.col("_k.node") == F.col("node")) & (F.col("_k.least") == F.coalesce("id", F.lit(NO_ID)))).alias("keeper"))


#: Stands for a null id: above all others.
NO_ID = (1 << 63) - 1


def node_of(text: str) -> Column:
    """A number for a text (null: empty): 64 bits of a hash of its SHA-256."""
    return F.xxhash64(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def without_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id: str = "doc_id", text: str = "text", radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies, as ``same_texts`` tells, in whole and with all columns."""
    told = checkpointed(same_texts(docs, similarity, shingle, id, text, radius))
    a, b = unused(docs, "__id", "__node")
    keyed = docs.withColumn(a, F.coalesce(F.col(id).cast("long"), F.lit(NO_ID))).withColumn(b, node_of(text))
    key = [F.coalesce("id", F.lit(NO_ID)).alias(a), F.col("node").alias(b)]
    kept = joined(keyed, told.where("not keeper").select(*key).distinct(), [a, b], "left_anti")
    # a row that stands there several times stays once
    again = checkpointed(told.where("keeper").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not again.isEmpty():
        once = joined(kept, again, [a, b], "left_semi").dropDuplicates([a, b])
        kept = joined(kept, again, [a, b], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
