"""Text quality by random indexing, pooled for each document, and a two-layer network with calibrated probabilities.

Random indexing (Kanerva et al., 2000): a word has a fixed sparse random vector, and its word vector is the sum of its neighbours' random
vectors over the whole corpus. Words share BUCKETS rows by their hash, so the table has one size whatever the corpus. A document's
features are the mean word vector, the mean random vectors of its words and of their shapes, the norms of these means (which tell how
much it repeats itself) and its length. The network is trained in numpy; a temperature fitted on rows set aside calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, ending, keep_oldest, tree_added

BUCKETS, DIM, NONZERO = 4096, 48, 4
SHAPES, SHAPE_DIM = 256, 32
#: Labelled rows that the network is trained on: all, or about so many by a hash of the id where there are more.
TRAIN_ROWS = 20_000
FEATURES = 2 * DIM + SHAPE_DIM + 5
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 200_000


def index_vectors(rows: int, dim: int, seed: int) -> np.ndarray:
    """Sparse random vectors of 1 and -1; the row after the last is zero and stands between documents."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows + 1, dim), np.float32)
    for r in range(rows):
        out[r, rng.choice(dim, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


_known: dict[str, int] = {}
_shapes: dict[tuple, int] = {}
_tables: dict[str, np.ndarray] = {}


def _shape(token: str) -> int:
    """Which kind of characters begin and end a token, its case, and how long it is."""
    key = token[0], token[-1], token.isupper(), token.istitle(), min(len(token).bit_length(), 5)
    if (n := _shapes.get(key)) is None:
        kinds = "".join("9" if c.isdigit() else "x" if c.islower() else "X" if c.isupper() else "a" if c.isalpha() else c for c in key[:2])
        case = "u" if key[2] else "t" if key[3] else "l"
        if len(_shapes) > CACHE // 4:
            _shapes.clear()
        n = _shapes[key] = zlib.crc32(f"{kinds}{case}{key[4]}".encode("utf-8", "replace")) % SHAPES
    return n


def forget() -> None:
    _known.clear()


def _learn(token: str) -> int:
    if len(_known) > CACHE:
        keep_oldest(_known, CACHE // 2)
    n = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS * SHAPES + _shape(token)
    _known[token] = n
    return n


def numbers(text: str | None) -> np.ndarray:
    """Of each token: bucket * SHAPES + shape."""
    tokens = TOKEN.findall(text or "")
    try:
        return np.fromiter(map(_known.__getitem__, tokens), np.int64, len(tokens))
    except KeyError:
        get = _known.get
        return np.fromiter(((n if (n := get(t)) is not None else _learn(t)) for t in tokens), np.int64, len(tokens))


def _index() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables.update(words=index_vectors(BUCKETS, DIM, 1), shapes=index_vectors(SHAPES, SHAPE_DIM, 2))
    return _tables["words"], _tables["shapes"]


def add_contexts(pairs: np.ndarray, words: np.ndarray, window: int = 2) -> None:
    """Counts in ``pairs`` (a row and a column for each bucket, flat) which words stand within ``window`` before which; BUCKETS stands between documents."""
    for off in range(1, window + 1):
        np.add.at(pairs, words[:-off] * (BUCKETS + 1) + words[off:], 1)


def context_vectors(pairs: np.ndarray) -> np.ndarray:
    """The sum of the random vectors of all neighbours of each word, on either side."""
    square = pairs.reshape(BUCKETS + 1, BUCKETS + 1)
    index = _index()[0].astype(np.float64)
    step, out = 512, np.zeros((BUCKETS + 1, DIM))
    for at in range(0, BUCKETS + 1, step):  # a few rows at a time as floating numbers
        part = square[at : at + step].astype(np.float64)
        out[at : at + step] += part @ index
        out += part.T @ index[at : at + step]
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of word vectors (BUCKETS x DIM, rows of length 1 or 0) from all of ``docs``. Its size is fixed, so the driver holds it."""
    slices = 32

    def count(frames):
        pairs, held, n = np.zeros((BUCKETS + 1) ** 2, np.int32), [], 0
        for pdf in frames:
            for t in pdf[text]:
                held += [numbers(t) // SHAPES, np.array([BUCKETS] * 2)]
                n += len(held[-2])
                if n > 200_000:
                    add_contexts(pairs, np.concatenate(held))
                    held, n = [], 0
        if held:
            add_contexts(pairs, np.concatenate(held))
        parts = np.split(np.rint(context_vectors(pairs))[:BUCKETS].astype("<i8"), slices)
        yield pd.DataFrame({"part": np.arange(slices), "body": [zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts]})

    def add(bodies: list[bytes]) -> bytes:
        return zlib.compress(sum(np.frombuffer(zlib.decompress(b), "<i8") for b in bodies).astype("<i8").tobytes(), 1)

    counted = docs.select(text).mapInPandas(lambda frames: ending(count(frames), forget), "part int, body binary")
    rows = tree_added(counted, add).collect()
    table = np.zeros((BUCKETS, DIM))
    for r in rows:
        table.reshape(slices, -1, DIM)[r["part"]] = np.frombuffer(zlib.decompress(r["body"]), "<i8").reshape(-1, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, table: np.ndarray) -> np.ndarray:
    """A document's features; those of an empty text are zero."""
    n = numbers(text)
    out = np.zeros(FEATURES, np.float32)
    if not len(n):
        return out
    words, shapes = _index()
    keys, counts = np.unique(n, return_counts=True)
    share = (counts / len(n)).astype(np.float32)
    a, b, c = share @ table[keys // SHAPES], share @ words[keys // SHAPES], share @ shapes[keys % SHAPES]
    out[: DIM * 2 + SHAPE_DIM] = np.r_[a, b, c]
    out[DIM * 2 + SHAPE_DIM :] = np.linalg.norm(a), np.linalg.norm(b), np.linalg.norm(c), np.log1p(len(n)) / 10, len(keys) / len(n)
    return out


@dataclass
class Network:
    """A hidden layer of rectified units and a logistic one; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the rest choose the epoch and the temperature. Without rows: a network that says 0.5."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(np.zeros(d), np.ones(d), rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.normal(size=hidden) * np.sqrt(1 / hidden), 0.0)
    if not len(x):
        net.w2 *= 0
        return net
    net.mean, net.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    if len(np.unique(y)) < 2:
        net.w2 *= 0
        net.b2 = 4.0 if y[0] else -4.0
        return net
    order = rng.permutation(len(x))
    apart, own = order[: len(x) // 5], order[len(x) // 5 :]
    if not len(apart):
        apart = own
    names = ("w1", "b1", "w2", "b2")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    best = (np.inf, None)
    for _ in range(epochs):
        for at in range(0, len(own), 128):
            rows = rng.permutation(own)[:128] if len(own) < 128 else own[at : at + 128]
            z = (x[rows] - net.mean) / net.scale
            h = np.maximum(z @ net.w1 + net.b1, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, net.w2) * (h > 0)
            grads = {"w1": z.T @ back + 1e-4 * net.w1, "b1": back.sum(axis=0), "w2": h.T @ g + 1e-4 * net.w2, "b2": g.sum()}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        rng.shuffle(own)
        loss = _loss(net.logit(x[apart]), y[apart])
        if loss < best[0]:
            best = (loss, {k: np.copy(getattr(net, k)) for k in names})
    for k in names:
        setattr(net, k, best[1][k])
    z = net.logit(x[apart])
    net.temperature = min((t for t in np.geomspace(0.25, 8, 61)), key=lambda t: _loss(z / t, y[apart]))
    return net


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score, predicted (and ``carry``) of each row of ``docs``, as ``labels`` (id, quality) marks quality.

    Labels are learnt only from rows whose CRC-32 of the id as text isn't divisible by 5, all or about ``train_rows`` of them by a hash; a null
    id is held out. The word vectors come from all texts. Null and empty texts have features of zero and get the score of
    these. Labels that are null or repeated with two values take no part. Rows come out as they went in.
    """
    table = word_vectors(docs, text)

    @F.pandas_udf("array<float>")
    def pool(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return ending((pd.Series([pooled(t, table) for t in s]) for s in texts), forget)

    held = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    features = checkpointed(docs.select(F.col(id).alias("_id"), held.alias("held_out"), pool(text).alias("_x"), *carry))
    sure = labels.where("quality is not null").groupBy(F.col(id).alias("_id")).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    known = features.where("not held_out").select("_id", "_x").join(sure, "_id").withColumn("_h", F.xxhash64("_id", F.lit(7)))
    rows = known.count()
    if rows > train_rows:  # a share by hash, so that no task sends more than its own part of the bound
        known = known.where(F.pmod("_h", F.lit(1 << 20)) < int((1 << 20) * train_rows / rows))
    sample = known.limit(2 * train_rows).select("_h", "_x", "a").toPandas().sort_values("_h", kind="stable")
    x = np.array(sample["_x"].tolist(), np.float64).reshape(len(sample), FEATURES)
    net = train(x, (sample["a"].to_numpy() == 1).astype(float))

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(net.probability(np.array(s.tolist(), np.float64).reshape(len(s), FEATURES)))

    out = features.withColumn("score", score("_x"))
    return out.select(F.col("_id").alias(id), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *carry)
