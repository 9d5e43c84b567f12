"""Byte-level BPE by a sentencepiece model made from a rank file.

The model has one piece for each token, its bytes mapped to printable characters one by one, with its negative rank as the score, and
no normalisation. Sentencepiece merges the pair with the best score first, the leftmost of equals: the same merges, in the same
order, as by rank. Texts are split by the pattern before; a pre-token that is itself a token is taken whole, as rank
tokenizers do. Each distinct pre-token is encoded once in a worker while its cache lasts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ending, keep_oldest, unused

#: Pre-tokens kept in a worker; then it starts anew.
CACHE = 400_000
#: Pre-tokens are encoded so many at a time, with a character between them that no piece has: it comes out as the unknown piece.
JOIN, APART = 128, "\u3000"


def byte_characters() -> list[str]:
    """A character for each byte: itself if printable Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protocol-buffer field: bytes, float or int."""
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """A serialised sentencepiece model, and the rank of each of its pieces (the unknown piece, which comes first: -1)."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda x: x[1])
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1)) for token, rank in order]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal), [-1, *(rank for _, rank in order)]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        data, rank_of = model(ranks)
        self.rank_of = np.array(rank_of).astype("<u4")
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_characters()))
        self.token = {rank: token for token, rank in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE:
            keep_oldest(self.cache, CACHE // 4)
        hard, mapped = [], []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(data)) is not None:
                self.cache[w] = rank.to_bytes(4, "little")
            else:
                hard.append(w)
                mapped.append(data.decode("latin-1").translate(self.chars))
        for at in range(0, len(hard), JOIN):
            ids = np.array(self.pieces.encode(APART.join(mapped[at : at + JOIN])))
            data, ends = self.rank_of[ids].tobytes(), [*(4 * np.flatnonzero(ids == 0)).tolist(), 4 * len(ids)]
            begin = 0
            for w, end in zip(hard[at : at + JOIN], ends, strict=True):
                self.cache[w] = data[begin:end]
                begin = end + 4

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = self.split(text or "")
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            self._learn({w for w in words if w not in cache})
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:  # the cache began anew
            self._learn(set(words))
            return b"".join(map(cache.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker; the vocabulary file is part of the image of every machine."""
    with open(path, "rb") as f:
        return Encoder(read_ranks(f.read()), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (the bytes again), which take the place of columns of these names.

    A null text is empty; texts of any length are encoded whole, pre-token by pre-token. Rows come out as they went in, repeated ones too; empty tables give none.
    """

    @F.pandas_udf("ids binary, decoded binary")
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path, pattern)

        def some(s):
            ids = [e.encode(t) for t in s]
            return pd.DataFrame({"ids": ids, "decoded": [e.decode(x) for x in ids]})

        return ending(map(some, texts), lambda: keep_oldest(e.cache, CACHE // 4))

    (c,) = unused(docs, "_c")
    return docs.withColumn(c, code(F.col(text))).select(*(x for x in docs.columns if x not in ("ids", "decoded")), f"{c}.ids", f"{c}.decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, digests of ids and of the decoded bytes; made in the workers, so that ids don't travel. Nulls, long texts and rows as in ``encoded``."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path, pattern)

        def one(t):
            ids = e.encode(t)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

        return ending((pd.DataFrame([one(t) for t in s], columns=["n_tokens", "ids_sha256", "decoded_sha256"]) for s in texts), lambda: keep_oldest(e.cache, CACHE // 4))

    return docs.select("doc_id", code("text").alias("c")).select("doc_id", "c.*")
