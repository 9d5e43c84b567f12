"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is cut into 2^BITS cells of about equal numbers of rows; a row's cells give its index on the curve; rows are sorted by it and
the order is cut into runs. So a shard holds a compact region of all dimensions at once, and a file's least and largest values prune.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, shuffle_parts

BITS = 5


def curve(dims: int) -> tuple[list[int], list[int]]:
    """Tables over (state, cell bits of one level): the digit on the curve, and the next state (Hamilton, 2006)."""
    n, full = dims, (1 << dims) - 1

    def left(x: int, by: int) -> int:
        by %= n
        return (x << by | x >> (n - by)) & full

    def gray_inverse(g: int) -> int:
        out = 0
        while g:
            out ^= g
            g >>= 1
        return out

    digits, following = [], []
    for entry, turn in itertools.product(range(1 << n), range(n)):
        for bits in range(1 << n):
            w = gray_inverse(left(bits ^ entry, n - (turn + 1) % n))
            start = 0 if w == 0 else (2 * ((w - 1) // 2)) ^ (2 * ((w - 1) // 2)) >> 1
            odd = 0 if w == 0 else (w if w % 2 else w - 1)
            step = 0 if w == 0 else (odd ^ (odd + 1)).bit_length() - 1
            digits.append(w)
            following.append((entry ^ left(start, turn + 1)) * n + (turn + step + 1) % n)
    return digits, following


def index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of the cell given by integers of ``bits`` bits, one for each dimension."""
    n = len(cells)
    digits, following = curve(n)
    table = F.lit([d * 1_000_000 + f for d, f in zip(digits, following, strict=True)])

    def level(state: Column, at: Column) -> Column:
        bit = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.call_function("shiftright", c, at).bitwiseAND(1), k) for k, c in enumerate(cells)))
        found = F.get(table, (state["s"] * (1 << n) + bit).cast("int"))
        return F.struct((state["h"] * (1 << n) + F.floor(found / 1_000_000)).cast("long").alias("h"), (found % 1_000_000).cast("int").alias("s"))

    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("int").alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), zero, level)["h"]


def number_of(text: Column, common: int) -> Column:
    """An order-keeping number for a string: its seven bytes after the ``common`` ones that all strings share."""
    tail = F.rpad(F.hex(F.substring(text.cast("binary"), common + 1, 7)), 14, "0")
    return F.conv(tail, 16, 10).cast("double")


def _cell(cuts: list[float], number: Column) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda x: x < number))


def placed(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text", strings: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Each row's id, size, text_crc32, curve index, shard and slot; shards hold equal numbers of rows, or one more.

    Dimensions: the ``strings``, the size and the id, of equal texts the least ones (null metadata lowest, null ids last), so that these
    lie next to each other and share a shard, unless the law cuts between them. Size: UTF-8 bytes and 1; a null text has none and counts as empty for the
    checksum; texts of any length are read whole. Ties on the curve go by the text's hash and checksum, then by id; repeated rows are told apart by nothing
    and take neighbouring slots. Extra columns are left out. Empty tables give none. The texts aren't shuffled: one narrow row each is.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("_g"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_m{k}") for k, c in enumerate(strings)),
    )
    rows = checkpointed(rows)
    same = ["_g", "size", "text_crc32"]
    least = rows.groupBy(*same).agg(F.min("doc_id").alias("_id"), *(F.min(f"_m{k}").alias(f"_s{k}") for k in range(len(strings))))
    rows = checkpointed(rows.select("doc_id", *same).join(least, same))
    ends = rows.agg(*(f(f"_s{k}").alias(f"{n}{k}") for k in range(len(strings)) for n, f in (("a", F.min), ("b", F.max)))).first()
    common = []
    for k in range(len(strings)):
        a, b = (ends[f"a{k}"] or "").encode(), (ends[f"b{k}"] or "").encode()
        common.append(next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))  # noqa: B905
    numbers = {f"d{k}": number_of(F.col(f"_s{k}"), n) for k, n in enumerate(common)}
    numbers |= {"dsize": F.col("size").cast("double"), "did": F.coalesce(F.col("_id"), F.lit((1 << 63) - 1)).cast("double")}
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    cuts = rows.agg(*(F.percentile_approx(c, shares, 10_000).alias(n) for n, c in numbers.items())).first()
    cells = [_cell(cuts[n] or [0.0], c) for n, c in numbers.items()]
    keyed = rows.withColumns({f"_c{n}": c for n, c in enumerate(cells)})
    keyed = keyed.select("doc_id", *same, index([F.col(f"_c{n}") for n in range(len(cells))]).alias("curve"))

    order = ["curve", "_g", "text_crc32", "size", "doc_id"]
    ranged = keyed.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("_n", F.monotonically_increasing_id()))
    place = F.shiftright("_n", 33).alias("_p")
    counts = ranged.groupBy(place).agg(F.count("*").alias("_rows"))  # one row for each partition
    before = counts.withColumn("_before", F.sum("_rows").over(Window.orderBy("_p")) - F.col("_rows")).withColumn("_all", F.sum("_rows").over(Window.partitionBy()))
    rank = F.col("_before") + F.col("_n").bitwiseAND((1 << 33) - 1)
    out = ranged.withColumn("_p", place).join(F.broadcast(before), "_p").withColumn("_r", rank)
    out = out.withColumn("shard", F.expr(f"_r * {shards} div _all").cast("int"))
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("_r") - first).cast("long").alias("slot"))
