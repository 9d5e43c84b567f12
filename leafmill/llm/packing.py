"""Best-fit decreasing packing of documents into sequences of ``capacity`` tokens.

Pieces of one length are interchangeable. So best-fit decreasing over all pieces is the same as over the counts of their lengths, with
bins of equal free room moved together: at most ``capacity`` lengths and amounts of free room, however many documents there are.
A segment tree over the free rooms finds the tightest that a length fits in. The driver sees those counts only; each piece then
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, ending, keep_oldest, unused

CACHE, APART = 400_000, "<|startoftext|>"


class RoomTree:
    """A segment tree over free rooms 0..capacity: which have open bins, and the least of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = np.zeros(2 * self.leaves, bool)

    def put(self, room: int, is_open: bool) -> None:
        i = self.leaves + room
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = self.leaves + size
        if self.open[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each length: (rank of the first piece, its bin, its offset there), where further ranks take the further bins."""
    tree, runs, bins = RoomTree(capacity), [deque() for _ in range(capacity + 1)], 0
    plan: dict[int, list[tuple[int, int, int]]] = {}
    for length in sorted(counts, reverse=True):
        rank, left, rows, moved = 0, counts[length], [], []
        while left:
            room = tree.tightest(length)
            if room is None:
                per = 1 if length == 0 else capacity // length
                room, first, n = capacity, bins, -(-left // per)
                bins += n
            else:
                first, n = runs[room].popleft()
                if not runs[room]:
                    tree.put(room, False)
            use = min(n, left)
            if use < n:
                runs[room].appendleft((first + use, n - use))
                tree.put(room, True)
            rows.append((rank, first, capacity - room))
            rank, left = rank + use, left - use
            runs[room - length].append((first, use))
            tree.put(room - length, True)
        plan[length] = rows
    return plan


#: How the vocabulary's file splits lower-cased text (a fixed value), and the same for the characters below and their lower case.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ʯⱥⱦ]+|\d|(?:[^\w\s]|_)+")
#: Other characters than Latin letters, ASCII digits, marks and plain white space, or ones whose lower case depends on what follows.
ODD = re.compile("[^\\n\\t\\r -~¡-¬®-±´-¸º»¿-įı-ɏ]")


class WordEncoder:
    """A tokenizer whose tokens never span white space, with the ids of strings that it splits text into kept.

    Texts of common Latin characters are split here, as the tokenizer would; others at spaces, and their words by the tokenizer. A text
    with a special mark in it goes to the tokenizer as it is, for which such a mark is one token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.apart = self.tokenizer.token_to_id(APART)  # it stands between words that are encoded together
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in file["added_tokens"]) or "(?!)")
        self.splits = [x.get("pattern", {}).get("Regex") for x in (file.get("pre_tokenizer") or {}).get("pretokenizers", [])][:1] == [PIECES]
        suffix = file["model"].get("end_of_word_suffix")
        self.splits &= bool(suffix)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a piece
        self.ends[[i for t, i in file["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str], pieces: bool) -> None:
        """``pieces``: each word is one piece for the tokenizer, so its last token tells where it ends."""
        if len(self.cache) + len(words) > CACHE:
            keep_oldest(self.cache, CACHE // 2)
        for at in range(0, len(words), 128):
            some = words[at : at + 128]
            ids = self._ids((" " if pieces else APART).join(some))
            if pieces:
                begin = end = 1 + np.flatnonzero(self.ends[ids])
            else:
                begin, end = 1 + (cut := np.flatnonzero(ids == self.apart)), np.r_[cut, len(ids)]
            data = ids.tobytes()
            for w, x, y in zip(some, [0, *(4 * begin[: len(some) - 1]).tolist()], (4 * end).tolist(), strict=True):
                self.cache[w] = data[x:y]

    def encode(self, text: str | None) -> bytes:
        text, cache = text or "", self.cache
        if self.special.search(text):
            return self._ids(text).tobytes()
        pieces = self.splits and not ODD.search(text)
        words = SPLIT.findall(text.lower()) if pieces else text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            self._learn([w for w in dict.fromkeys(words) if w not in cache], pieces)
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:  # the cache began anew
            self._learn(list(dict.fromkeys(words)), pieces)
            return b"".join(map(cache.__getitem__, words))


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id: str = "doc_id", text: str = "text", keep: int = 0) -> DataFrame:
    """Per piece of at most ``capacity`` tokens: id, piece, start, length, ids_crc32. A document ends with the id ``end``.

    ``keep``: words of which a worker still knows the ids in its next task; results don't depend on it. Null texts are empty and make one piece; texts of any length are encoded whole and cut by tokens. Repeated rows make pieces each; extra columns are left out.
    """

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e, last = word_encoder(path), end.to_bytes(4, "little")

        def some(s):
            out = []
            for t in s:
                ids = e.encode(t) + last
                out.append([(n, at // 4, min(4 * capacity, len(ids) - at) // 4, zlib.crc32(ids[at : at + 4 * capacity])) for n, at in enumerate(range(0, len(ids), 4 * capacity))])
            return pd.Series(out)

        return ending(map(some, texts), lambda: keep_oldest(e.cache, keep))

    return docs.select(F.col(id).alias("doc_id"), F.explode(cut(F.col(text))).alias("p")).select("doc_id", "p.*")


def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (column ``length``, from 1 to ``capacity``) with ``sequence_id`` and ``offset``, by best-fit decreasing.

    Rows come out as they went in, repeated ones too; which of equal lengths goes where is not told. Columns called as the two new ones
    go, others stay. Empty tables give none.
    """
    pieces = pieces.select(*(c for c in pieces.columns if c not in ("sequence_id", "offset")))
    part, row, rank_, before_ = unused(pieces, "_part", "_row", "_rank", "_before")
    # written as they come: ranked by Python in the same stage, each task would keep a second worker beside the one that encodes
    local = checkpointed(pieces.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    by_part = local.groupBy(part, "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn(before_, F.sum("n").over(Window.partitionBy("length").orderBy(part)) - F.col("n")).select(part, "length", before_)
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = {k: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for k, rows in best_fit_decreasing(counts, capacity).items()}
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, not by the rows

    def placed(frames):
        plan = shared.value
        for pdf in frames:
            length, rank = pdf["length"].to_numpy(), (pdf[rank_] + pdf[before_]).to_numpy()
            bins, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, first, off = plan[int(n)]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                bins[at], offset[at] = first[k] + rank[at] - ranks[k], off[k]
            yield pdf.drop(columns=[part, row, rank_, before_]).assign(sequence_id=bins, offset=offset)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    ranked = local.withColumn(rank_, F.row_number().over(Window.partitionBy(part, "length").orderBy(row)).cast("long") - 1)  # in its task's order
    return ranked.join(before, [part, "length"]).select(*ranked.columns, before_).mapInPandas(placed, f"{kept}, sequence_id long, offset long")
