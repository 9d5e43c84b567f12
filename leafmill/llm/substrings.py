"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts in an earlier document.

Every string of ``length`` bytes has an anchor: its K-byte substring with the least hash (the leftmost of equals), which
depends on its content only. So equal strings have equal anchors, and a run of strings with one anchor lies in one short
context around it. Three passes over the texts, which are shuffled once, in blocks by a hash of the id:

1. anchors' hashes, to find those that more than one document has, and those that are hot;
2. the contexts of these anchors, gathered by anchor. Those of an anchor with several make a Burrows-Wheeler transform, in which threshold-bounded
   interval expansion (breadth-first backward extension, after Beller et al., 2013) derives common prefixes by increasing value
   and stops at the length; what no shorter common prefix parts is one string, and its smallest id is known;
3. the marks of what is repeated go back to the blocks, and each text is cut.

A hot anchor (of many blocks, or many times in one) may have as many contexts as there are documents. Its contexts are cut into
single strings, which are dealt by their own hash, so that different neighbours go to different groups; equal strings of a block are one row, and blocks
meet in two levels, each of about the square root of their number. What moves beside the texts is packed: a few bytes for an anchor.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import parts_for, trim

#: Bytes hashed at a time; arrays of this many 64-bit numbers stay in a core's cache.
PIECE = 1 << 17
MULT = 0x9E3779B97F4A7C15
#: Stored MB of input for each block.
BLOCK_MB = 1.5
#: Stands for a null id: above all others.
NO_ID = (1 << 63) - 1
#: An anchor is hot if more blocks than this have it, or one has it more often than this.
HOT_BLOCKS, HOT_TIMES = 4096, 256
#: A bucket's number times a 40-bit one must fit in 64 bits; beyond so many blocks, buckets grow.
MOST_BUCKETS = (1 << 24) - 1
#: Contexts gathered, and symbols sorted, at a time.
ROWS, SYMBOLS = 1 << 14, 1 << 18
FULL = np.uint32(0xFFFFFFFF)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(MULT, n, 1 << 64))


def _gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-byte strings, from those of strings of 1, 2, 4... bytes."""
    h = buf.astype(np.uint64) + np.uint64(1)
    out, have, size = None, 0, 1
    while True:
        if k & size:
            if out is None:
                out, have = h, size
            else:  # out: the `have` bytes that come first
                n = len(buf) - have - size + 1
                out = out[:n] * _power(size) + h[have : have + n]
                have += size
        if 2 * size > k:
            return out
        n = len(buf) - 2 * size + 1
        h = h[:n] * _power(size) + h[size : size + n]
        size *= 2


def anchors(text: bytes, length: int, k: int):
    """Arrays (hash of the anchor, its place, first and last start of the strings that have it), for one text."""
    found = []
    w = length - k + 1  # k-byte strings in each string of `length`
    starts = len(text) - length + 1
    for at in range(0, starts, PIECE):
        n = min(PIECE, starts - at)
        x = _gram_hashes(np.frombuffer(text, np.uint8, n + length - 1, at), k)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        m = x & ~np.uint64((1 << 20) - 1) | np.arange(len(x), dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            m = np.minimum(m[: len(m) - size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        place = (m[:n] & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], n] - 1
        found.append((x[place[first]], place[first] + at, first + at, last + at))
    if not found:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def expand_intervals(s: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each place of the symbols ``s``: a number that it shares with the places of its group where the same ``length`` symbols begin.

    Symbols are under 512; 0 ends a context, and those of a group (numbers that don't fall) stand together. Each group has its own suffix array. An
    interval of it holds the suffixes that begin with some w; the interval of cw, for each symbol c that stands before w, is found by
    the step from a suffix to the one a symbol longer, which keeps the order of those before which c stands. Where the interval
    of a w of l symbols ends and no end is known yet, the common prefix of the two neighbours is l - 1: prefixes are
    found by increasing value, breadth first, and each end once. After ``length`` rounds the ends that aren't known part nothing shorter.
    """
    n = len(s)
    padded = np.concatenate([s, np.zeros(64, s.dtype)]).astype(np.uint64)

    def word(at: int, k: int) -> np.ndarray:
        out = padded[at : at + n].copy()
        for i in range(1, k):
            out <<= np.uint64(9)
            out |= padded[at + i : at + i + n]
        return out

    first = group.astype(np.uint64) << np.uint64(45) | word(0, 5)
    order = np.lexsort((*(word(at, 7) for at in range(5 + (length - 5) // 7 * 7, 4, -7)), first))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n)
    longer = np.where((order > 0) & (s[order - 1] > 0), rank[order - 1], -1)  # none before a context's first symbol
    begins_with = np.append(s[order].astype(np.int64), -1)
    own = group[order]
    low = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    high = np.r_[low[1:], n]
    prefix = np.full(n + 1, -1, np.int8)  # with the suffix before; -1: not known
    prefix[low] = prefix[n] = 0
    of = np.full(n + 2, -1, np.int64)  # of[row + 1]: the interval that the step to the row began in
    for value in range(length):
        size = high - low
        rows = np.arange(size.sum()) + np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size)
        to = longer[rows]
        back = to >= 0
        to, whose = to[back], np.repeat(np.arange(len(low)), size)[back]
        if not len(to):
            break
        of[to + 1] = whose
        last = (of[to + 2] != whose) | (begins_with[to + 1] != begins_with[to])
        head = (of[to] != whose) | (begins_with[to - 1] != begins_with[to])
        of[to + 1] = -1
        low, high = np.sort(to[head]), np.sort(to[last]) + 1
        new = prefix[high] < 0
        low, high = low[new], high[new]
        prefix[high] = value
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(prefix[:n] >= 0) - 1
    return out


def _sorted_rows(pdf: pd.DataFrame):
    """Ids (null: above all others) and bytes of a block, in an order that doesn't depend on how its rows came."""
    ids = pdf["id"].tolist()
    texts = [b"" if t is None else bytes(t) for t in pdf["body"]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def _block_anchors(texts: list[bytes], length: int, k: int):
    """The anchors of a block's texts, with the text's number in front."""
    rows = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))
    for n, t in enumerate(texts):
        if len(t) >= length:
            found = anchors(t, length, k)
            for into, x in zip(rows, (np.full(len(found[0]), n), *found), strict=True):
                into.append(x)
    return [np.concatenate(x) for x in rows]


def _in_block(hashes: np.ndarray, text: np.ndarray):
    """Distinct 40-bit hashes, sorted; whether two texts of the block have each; whether it stands there often; each anchor's number among them."""
    short = hashes >> np.uint64(24)
    values, inverse, times = np.unique(short, return_inverse=True, return_counts=True)
    low, high = np.full(len(values), NO_ID), np.full(len(values), -1)
    np.minimum.at(low, inverse, text)
    np.maximum.at(high, inverse, text)
    return values, low != high, times > HOT_TIMES, inverse


def _shares(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the sorted 40-bit numbers in each bucket that has some; a bucket is an even share of all such numbers."""
    if not len(values):
        return []
    own = values * np.uint64(buckets) >> np.uint64(40)
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return list(zip(own[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)], strict=True))


def _gaps(values: np.ndarray, first: int) -> bytes:
    """Sorted numbers as 4-byte gaps, or 8-byte ones behind a mark where a gap is too large."""
    gaps = np.diff(np.r_[np.uint64(first), values])
    return b"\0" + gaps.astype("<u4").tobytes() if not len(gaps) or gaps.max() < 1 << 32 else b"\1" + gaps.astype("<u8").tobytes()


def _values(packed: bytes, first: int) -> np.ndarray:
    return np.uint64(first) + np.cumsum(np.frombuffer(packed, "<u8" if packed[0] else "<u4", offset=1).astype(np.uint64))


def _pack(*arrays: np.ndarray) -> bytes:
    import pyarrow

    data = b"".join(x.tobytes() for x in arrays)
    return len(data).to_bytes(8, "little") + pyarrow.compress(data, "zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    import pyarrow

    return pyarrow.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _hashed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for w in rows.T:
        h = (h ^ w) * np.uint64(MULT)
        h ^= h >> np.uint64(31)
    return h


def _entries(key: np.ndarray, rows: np.ndarray, least: np.ndarray):
    """Equal (key, row) together: an entry's first item and least id, entries ordered by key; each item's entry.

    Sorted by a hash; should different rows have one, equal ones may be told as several entries, which changes no result.
    """
    h = key.copy()
    for w in rows.T:
        h = (h ^ w) * np.uint64(MULT)
        h ^= h >> np.uint64(29)
    order = np.lexsort((h, key))
    k, r = key[order], rows[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]).any(axis=1)] if len(k) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[begin], np.minimum.reduceat(least[order], begin) if len(begin) else least[:0], of


def _masks(key: np.ndarray, rows: np.ndarray, least: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For entries (distinct, ordered by key): bits of the strings in each that a smaller id than its own has by another entry of its key."""
    mask = np.zeros(len(key), np.uint32)
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    anchor = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(anchor)[anchor] > 1) if len(key) else anchor
    width = 2 * length - gram
    at = 0
    while at < len(several):  # whole anchors, of about SYMBOLS symbols
        end = min(len(several), at + SYMBOLS // width)
        while end < len(several) and anchor[several[end]] == anchor[several[end - 1]]:
            end += 1
        some, at = several[at:end], end
        data = rows[some].view(np.uint8)
        place, span = (data[:, [c]].astype(np.int64) for c in (-2, -1))
        j = np.arange(width + 1)
        stop = length + span
        # the anchor is one symbol, so strings of `length` bytes are some of `length - gram + 1` symbols
        symbols = np.where(j == stop, 0, np.where(j == place, 257, data[:, : width + 1].astype(np.uint16) + 1)).astype(np.uint16)
        taken = (j <= place) | (j >= place + gram) & (j <= stop)
        begin = np.r_[0, np.cumsum(taken.sum(axis=1))[:-1]]
        number = anchor[some] - anchor[some[0]]
        same = expand_intervals(symbols[taken], np.repeat(number, taken.sum(axis=1)), length - gram + 1)
        count = span[:, 0] + 1
        owner = np.repeat(np.arange(len(some)), count)
        offset = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        string = same[begin[owner] + offset]
        low = np.full(same.max() + 1, NO_ID)
        np.minimum.at(low, string, least[some][owner])
        again = low[string] < least[some][owner]
        np.bitwise_or.at(mask, some[owner[again]], np.left_shift(np.uint32(1), offset[again].astype(np.uint32)))
    return mask


def repeated(docs: DataFrame, length: int = 50, gram: int = 26, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Each row's id, ``n_bytes``, ``removed`` (array of [start, end) runs of bytes, maximal, in order), the bytes kept, and ``carry`` as a struct.

    ``as_text``: what is kept comes as text, in which a character that a cut parts goes whole, and a null text stays null.

    A byte goes if a string of ``length`` bytes that covers it also starts in a row with a smaller id. Strings are judged on the input.
    Null texts count as empty. A null id is above all others; rows of equal id are never earlier than each other. Texts are
    whole, of any length (a block holds at least one), and matches don't cross them. Empty tables give none; one row comes out for each that went in.
    """
    if not 8 <= gram < length <= 255 or length - gram > 31:
        raise ValueError("gram must be under length, by 31 at most")
    parts = parts_for(docs, BLOCK_MB, text)
    buckets, lanes = min(parts, MOST_BUCKETS), math.isqrt(parts - 1) + 1
    width = -(-(2 * length - gram + 2) // 8)  # 64-bit words of a context, with its anchor's place and the span of its strings
    other = F.struct(*carry).alias("other") if carry else F.lit(None).cast("int").alias("other")
    blocks = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("binary").alias("body"), other).select(
        F.pmod(F.xxhash64("id", F.crc32("body")), F.lit(parts)).cast("int").alias("blk"), "id", "body", "other"
    )

    def pass_one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, texts, _ = _sorted_rows(pdf)
        found = _block_anchors(texts, length, gram)
        values, _, often, _ = _in_block(found[1], found[0])
        rows = [(i, pdf["blk"].iat[0], (e - s).to_bytes(8, "little") + np.packbits(often[s:e]).tobytes() + _gaps(values[s:e], (i << 40) // buckets)) for i, s, e in _shares(values, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "blk", "body"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block's anchors: whether another block has them, and whether they are hot."""
        bucket = int(pdf["bucket"].iat[0])
        counts = [int.from_bytes(b[:8], "little") for b in pdf["body"]]
        often = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8), 8), count=n) for n, b in zip(counts, pdf["body"], strict=True)])
        every = np.concatenate([_values(b[8 + -(-n // 8) :], (bucket << 40) // buckets) for n, b in zip(counts, pdf["body"], strict=True)])
        _, of, blocks_of = np.unique(every, return_inverse=True, return_counts=True)
        twice = blocks_of > 1
        hot = twice & ((blocks_of > HOT_BLOCKS) | (np.bincount(of, often) > 0))
        ends = np.cumsum(counts)
        marks = [np.packbits(twice[of[e - n : e]]).tobytes() + np.packbits(hot[of[e - n : e]]).tobytes() for n, e in zip(counts, ends, strict=True)]
        return pd.DataFrame({"kind": 0, "bucket": bucket, "blk": pdf["blk"], "body": marks})

    class Block:
        """A block's texts one after the other, and the contexts of its shared anchors: items, and the entries that equal ones make."""

        def __init__(self, pdf: pd.DataFrame, flags: list[tuple[int, bytes]]) -> None:
            self.blk = int(pdf["blk"].iat[0])
            self.ids, self.texts, self.order = _sorted_rows(pdf)
            lens = np.array([len(t) for t in self.texts], np.int64)
            self.begin = np.r_[0, np.cumsum(lens + 1)]  # a byte stands between two texts
            self.bytes = np.frombuffer(b"\0".join([*self.texts, bytes(2 * length)]), np.uint8)
            text_no, hashes, place, first, last = _block_anchors(self.texts, length, gram)
            values, shared, _, number = _in_block(hashes, text_no)
            hot, told = np.zeros(len(values), bool), dict(flags)
            for bucket, s, e in _shares(values, buckets):
                size = -(-(e - s) // 8)
                twice, burning = (np.unpackbits(np.frombuffer(told[bucket], np.uint8, size, k * size), count=e - s).astype(bool) for k in (0, 1))
                shared[s:e] |= twice
                hot[s:e] = burning
            hot, shared = hot[number], shared[number]
            own, cut = np.flatnonzero(shared & ~hot), np.flatnonzero(hot)
            count = last[cut] - first[cut] + 1
            strings = np.repeat(cut, count)
            step = np.arange(len(strings)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) if len(cut) else strings
            none = np.zeros(len(strings), np.int64)
            #: of each item: its text, where it starts, how many strings it has beside the first, where its anchor stands
            self.text = np.r_[text_no[own], text_no[strings]]
            self.start = self.begin[self.text] + np.r_[first[own], first[strings] + step]
            self.span, self.place = np.r_[(last - first)[own], none], np.r_[(place - first)[own], none]
            self.of = np.empty(len(self.text), np.int64)
            self.entries: list[tuple[int, np.ndarray]] = []  # of each bucket
            found, before = [], 0
            for single, items in ((False, np.arange(len(own))), (True, np.arange(len(own), len(self.text)))):
                item, key, rows, low = self._distinct(items, hashes[own], single)
                for i, s, e in _shares(key >> np.uint64(24), buckets):  # in the order of the texts, so that least ids don't fall
                    some = np.arange(s, e)
                    self.entries.append((buckets * (1 + self.blk % lanes) + i if single else i, some[np.argsort(item[some])] + before))
                self.of[items] += before
                found.append((rows, low))
                before += len(item)
            self.rows, self.least = (np.concatenate(x) for x in zip(*found, strict=True))

        def _distinct(self, items: np.ndarray, hashes: np.ndarray, single: bool):
            """(first item, key, row, least id) of the entries that items make, by key; some items at a time, so that a text that repeats itself takes little."""
            ids, j, parts = np.array(self.ids, np.int64), np.arange(2 * length - gram), []
            for k in range(0, max(1, len(items)), ROWS):
                some = items[k : k + ROWS]
                rows = np.zeros((len(some), 8 * width), np.uint8)
                rows[:, : len(j)] = np.where(j < length + self.span[some, None], self.bytes[self.start[some, None] + j], 0)
                rows[:, -2], rows[:, -1] = self.place[some], self.span[some]
                rows = rows.view(np.uint64)
                key = _hashed(rows) if single else hashes[some]
                one, low, of = _entries(key, rows, ids[self.text[some]])
                self.of[some] = of + sum(len(p[0]) for p in parts)
                parts.append((some[one], key[one], rows[one], low))
            item, key, rows, low = (np.concatenate(x) for x in zip(*parts, strict=True))
            one, low, of = _entries(key, rows, low)
            self.of[items] = of[self.of[items]]
            return item[one], key[one], rows[one], low

    def pass_two(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"bucket": [], "blk": [], "body": []})
        b = Block(pdf, list(zip(state["bucket"], state["body"], strict=True)))
        rows = [(bucket, b.blk, _pack(np.diff(b.least[own], prepend=0), b.rows[own])) for bucket, own in b.entries]
        return pd.DataFrame(rows, columns=["bucket", "blk", "body"])

    def opened(bodies, single: bool):
        """Least ids, rows and keys of what blocks sent, and how many each did. A key is a hash of the anchor, or of a single string."""
        found = []
        for packed in bodies:
            data = _unpack(packed)
            n = len(data) // (8 + 8 * width)
            found.append((np.cumsum(np.frombuffer(data, "<i8", n)), np.frombuffer(data, "<u8", n * width, 8 * n).reshape(n, width)))
        least, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        keyed = rows
        if not single:
            data = rows.view(np.uint8)
            keyed = np.zeros((len(rows), -(-gram // 8) * 8), np.uint8)
            keyed[:, :gram] = np.take_along_axis(data, data[:, [-2]].astype(np.int64) + np.arange(gram), axis=1)
            keyed = keyed.view(np.uint64)
        return least, rows, _hashed(keyed), [len(x[0]) for x in found]

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block's entries: which of their strings a smaller id than the entry's own has; of hot anchors, in the lane's blocks."""
        bucket = int(pdf["bucket"].iat[0])
        least, rows, key, sizes = opened(pdf["body"], bucket >= buckets)
        one, smallest, of = _entries(key, rows, least)
        mask = _masks(key[one], rows[one], smallest, length, gram) if bucket < buckets else np.zeros(len(one), np.uint32)
        marks = np.where(least > smallest[of], FULL, mask[of]).astype("<u4")
        ends = np.cumsum(sizes)
        return pd.DataFrame({"kind": 1, "bucket": bucket, "blk": pdf["blk"], "body": [_pack(marks[e - n : e]) for n, e in zip(sizes, ends, strict=True)]})

    def lane(pdf: pd.DataFrame) -> pd.DataFrame:
        """Strings of hot anchors meet in lanes of blocks first: those that have a lane's smallest id go on, with their block, bucket and number there."""
        bucket = int(pdf["bucket"].iat[0])
        if bucket < buckets:
            return pd.DataFrame({"kind": [], "bucket": [], "blk": [], "body": []})
        least, rows, key, sizes = opened(pdf["body"], True)
        _, smallest, of = _entries(key, rows, least)
        first = np.flatnonzero(least == smallest[of])
        ends = np.cumsum(sizes)
        block = np.searchsorted(ends, first, "right")
        where = np.stack([pdf["blk"].to_numpy()[block], np.full(len(first), bucket), first - (ends - sizes)[block]]).astype("<i8")
        body = _pack(np.diff(least[first], prepend=0), rows[first]) + where.tobytes() + len(first).to_bytes(8, "little")
        return pd.DataFrame([(2, bucket % buckets, -1, body)], columns=["kind", "bucket", "blk", "body"])

    def finals(pdf: pd.DataFrame) -> pd.DataFrame:
        """The entries that have the smallest id of a lane, but not of all: their numbers, for each block and bucket."""
        heads, tails = [], []
        for body in pdf["body"]:
            n = int.from_bytes(body[-8:], "little")
            heads.append(body[: len(body) - 8 - 24 * n])
            tails.append(np.frombuffer(body, "<i8", 3 * n, len(body) - 8 - 24 * n).reshape(3, n))
        least, rows, key, _ = opened(heads, True)
        _, smallest, of = _entries(key, rows, least)
        gone = np.concatenate(tails, axis=1)[:, least > smallest[of]]
        gone = gone[:, np.lexsort((gone[1], gone[0]))]
        cuts = np.flatnonzero((gone[:2, 1:] != gone[:2, :-1]).any(axis=0)) + 1
        out = [(2, int(x[1, 0]), int(x[0, 0]), x[2].tobytes()) for x in np.split(gone, cuts, axis=1) if x.size]
        return pd.DataFrame(out, columns=["kind", "bucket", "blk", "body"])

    def pass_three(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n_bytes", "removed", "kept", "other"]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns})
        flags, marks, late = ([(b, x) for k, b, x in zip(state["kind"], state["bucket"], state["body"], strict=True) if k == kind] for kind in range(3))
        b = Block(pdf, flags)
        mask, said, gone_too = np.zeros(len(b.least), np.uint32), dict(marks), dict(late)
        for bucket, own in b.entries:
            mask[own] = np.frombuffer(_unpack(said[bucket]), "<u4")
            if bucket in gone_too:
                mask[own[np.frombuffer(gone_too[bucket], "<i8")]] = FULL
        bits = mask[b.of]
        bits[np.array(b.ids, np.int64)[b.text] > b.least[b.of]] = FULL
        whole, some = bits == FULL, np.flatnonzero((bits != FULL) & (bits != 0))
        i, j = np.nonzero(bits[some, None] >> np.arange(32, dtype=np.uint32) & 1)
        x = np.r_[b.start[whole], b.start[some[i]] + j]
        y = np.r_[(b.start + b.span)[whole], b.start[some[i]] + j] + length
        order = np.argsort(x, kind="stable")
        x, y = x[order], np.maximum.accumulate(y[order])
        new = np.flatnonzero(np.r_[True, x[1:] > y[:-1]]) if len(x) else x
        x, y = x[new], y[np.r_[new[1:] - 1, len(y) - 1]] if len(x) else y
        text = np.searchsorted(b.begin, x, "right") - 1
        runs: list[list] = [[] for _ in b.texts]
        for n, s, e in zip(text.tolist(), (x - b.begin[text]).tolist(), (y - b.begin[text]).tolist(), strict=True):
            runs[n].append([s, e])
        rows, others, given = [], pdf["other"].tolist() if carry else [None] * len(pdf), pdf["body"].tolist()
        for n, (own_id, t) in enumerate(zip(b.ids, b.texts, strict=True)):
            edges = [0, *(e for run in runs[n] for e in run), len(t)]
            kept = [t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)]
            if not as_text:
                body = b"".join(kept)
            else:
                body = None if given[b.order[n]] is None else "".join(x.decode("utf-8", "ignore") for x in kept)
            rows.append((own_id, len(t), runs[n], body, others[b.order[n]]))
        return pd.DataFrame(rows, columns=columns)

    packed, marked = "bucket long, blk int, body binary", "kind int, bucket long, blk int, body binary"

    def lean(f):
        """A worker gives back what a group took before it goes on."""

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            out = f(pdf)
            trim()
            return out

        def two(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            out = f(pdf, state)
            trim()
            return out

        return two if f in (pass_two, pass_three) else one

    flags = blocks.groupBy("blk").applyInPandas(lean(pass_one), packed).groupBy("bucket").applyInPandas(lean(meet), marked)
    texts = blocks.groupBy("blk")
    sent = texts.cogroup(flags.groupBy("blk")).applyInPandas(lean(pass_two), packed)
    marks = sent.groupBy("bucket").applyInPandas(lean(judge), marked)
    late = sent.groupBy("bucket").applyInPandas(lean(lane), marked).groupBy("bucket").applyInPandas(lean(finals), marked)
    state = flags.unionAll(marks).unionAll(late)
    kind = blocks.schema["other"].dataType.simpleString()
    cut = texts.cogroup(state.groupBy("blk")).applyInPandas(lean(pass_three), f"id long, n_bytes long, removed array<array<long>>, kept {'string' if as_text else 'binary'}, other {kind}")
    return cut.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def without_repeats(docs: DataFrame, length: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each text cut by ``repeated``, in other order; a character that a cut parts goes whole, and a text may become empty."""
    found = repeated(docs, length, id=id, text=text, carry=tuple(c for c in docs.columns if c != text), as_text=True)
    return found.select(*(F.col("kept").alias(c) if c == text else F.col(f"other.`{c}`") for c in docs.columns))


def digest(df: DataFrame) -> DataFrame:
    """Of ``repeated()``'s rows: bytes, removed bytes and runs, and the digest of what is kept."""
    return df.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute(rows: list[tuple[int | None, str | None]], length: int = 50):
    """The same by a dictionary of all strings, for tests: (id, bytes, removed, runs, digest)."""
    first: dict[bytes, int] = {}
    data = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for s in range(len(t) - length + 1):
            first[t[s : s + length]] = min(i, first.get(t[s : s + length], NO_ID))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < i:
                gone[s : s + length] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((None if i == NO_ID else i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
