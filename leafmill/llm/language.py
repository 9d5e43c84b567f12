"""Language identification by Bayesian fusion of evidence.

log P(language | all) = tempered log-likelihood of the text's byte trigrams + log P(declared language | language) + log P(language | host), where
the host's prior is smoothed towards that of the address suffix, and this towards that of all rows. Trigram counts come
from all texts by their declared language; the other tables are grouped sums of what the texts alone say. The driver and each
task hold a row of TRIGRAMS counts (64 kB) for each language that LEAST rows declare.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, tree_added

TRIGRAMS = 1 << 13
#: Rows that must declare a language for it to have a model; in a table of any size.
LEAST = 3
#: A text counts as so many independent trigrams at most.
WEIGHT = 60.0
#: Rows that a prior from above weighs against a host's or suffix's own.
SMOOTH = 20.0


def trigrams(text: str | None) -> np.ndarray:
    """Numbers of the byte trigrams of a text: letters lower-cased, runs of anything that's no letter one space."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    keep = letter | np.r_[False, letter[:-1]] if len(data) else letter
    data = np.r_[np.uint8(32), np.where(letter, data, 32)[keep].astype(np.uint8), np.uint8(32)].astype(np.uint32)
    if len(data) < 3 or not letter.any():
        return np.zeros(0, np.int64)
    code = data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def languages(rows: DataFrame, declared: str) -> list[str]:
    """All languages that LEAST rows declare; if there are none, the most often declared one."""
    counts = rows.where(F.col(declared).isNotNull() & (F.col(declared) != "")).groupBy(declared).agg(F.count("*").alias("n"))
    return sorted(r[declared] for r in counts.where(F.col("n") >= LEAST).collect()) or [r[declared] for r in counts.orderBy(F.desc("n"), declared).limit(1).collect()]


def models(rows: DataFrame, names: list[str], text: str, declared: str) -> np.ndarray:
    """Log-probabilities (languages x TRIGRAMS)."""
    place, slices = {n: i for i, n in enumerate(names)}, 8

    def count(frames):
        table = np.zeros((len(names), TRIGRAMS), np.int64)
        for pdf in frames:
            for t, d in zip(pdf[text], pdf[declared], strict=True):
                if d in place:
                    table[place[d]] += np.bincount(trigrams(t), minlength=TRIGRAMS)
        for k, part in enumerate(np.split(table, slices, axis=1)):
            yield pd.DataFrame({"part": [k], "body": [zlib.compress(part.astype("<i8").tobytes(), 1)]})

    def add(bodies: list[bytes]) -> bytes:
        return zlib.compress(sum(np.frombuffer(zlib.decompress(b), "<i8") for b in bodies).astype("<i8").tobytes(), 1)

    found = tree_added(rows.select(text, declared).mapInPandas(count, "part int, body binary"), add).collect()
    parts = {r["part"]: np.frombuffer(zlib.decompress(r["body"]), "<i8").reshape(len(names), -1) for r in found}
    table = np.concatenate([parts[k] for k in range(slices)], axis=1) if parts else np.zeros((len(names), TRIGRAMS))
    table = table + 0.5
    return np.log(table / table.sum(axis=1, keepdims=True))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def identified(rows: DataFrame, text: str = "text", declared: str = "declared", host: str = "host", suffix: str = "suffix", carry: tuple[str, ...] = ("id",)) -> DataFrame:
    """``carry`` (but for columns called as the following), declared, lang, confidence, kept for each row. ``kept``: the text has letters and a language has half the probability.

    Null texts are empty; empty texts have no evidence of their own, get the language that the rest says, and aren't kept. Null or
    unknown declarations, hosts and suffixes say nothing. With no declared language in the table every row is "und". Rows
    come out as they went in, texts of any length whole; a host may hold any share of them.
    """
    carry = tuple(c for c in carry if c not in (declared, "lang", "confidence", "kept"))
    names = languages(rows, declared)
    if not names:
        return rows.select(*carry, declared, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    log_p, k = models(rows, names, text, declared), len(names)

    @F.pandas_udf("n long, likelihood array<double>, alone array<double>")
    def likelihood(s: pd.Series) -> pd.DataFrame:
        found = []
        for t in s:
            g = trigrams(t)
            # long texts by their counts: beside many languages, a column for each trigram would take much memory
            total = log_p[:, g].sum(axis=1) if len(g) <= TRIGRAMS else log_p @ np.bincount(g, minlength=TRIGRAMS)
            found.append((len(g), total * (min(1.0, WEIGHT / len(g)) if len(g) else 0)))
        x = np.array([f for _, f in found]).reshape(len(found), k)
        return pd.DataFrame({"n": [n for n, _ in found], "likelihood": list(x), "alone": list(_softmax(x))})

    texts = checkpointed(rows.select(*carry, declared, F.coalesce(F.col(host), F.lit("")).alias("_host"), F.coalesce(F.col(suffix), F.lit("")).alias("_suffix"), F.coalesce(F.col(declared), F.lit("")).alias("_declared"), likelihood(text).alias("_l")))
    sums = [F.sum(F.get("_l.alone", F.lit(i))) for i in range(k)]
    speaking = texts.where("_l.n > 0")

    def grouped(key: str, name: str) -> DataFrame:
        return speaking.groupBy(key).agg(F.array(*sums).alias(name))

    overall = [float(x or 0) for x in speaking.agg(*sums).first()]
    base = (np.array(overall) + 1) / (sum(overall) + k)
    out = texts.join(grouped("_suffix", "_s"), "_suffix", "left").join(grouped("_host", "_h"), "_host", "left").join(grouped("_declared", "_d"), "_declared", "left")

    @F.pandas_udf("lang string, confidence double")
    def fuse(like: pd.Series, s: pd.Series, h: pd.Series, d: pd.Series, said: pd.Series) -> pd.DataFrame:
        def matrix(col):
            return np.array([np.zeros(k) if x is None else x for x in col], np.float64).reshape(len(col), k)

        level = np.broadcast_to(base, (len(like), k))
        for counts in (matrix(s), matrix(h)):
            level = (counts + SMOOTH * level) / (counts.sum(axis=1, keepdims=True) + SMOOTH)
        # P(declared | language): how often rows of the language declare this, against all its rows
        declaring = np.where((said.to_numpy() == "")[:, None], 1.0, (matrix(d) + 0.5) / (np.array(overall) + 1.0))
        p = _softmax(matrix(like) + np.log(level) + np.log(declaring))
        best = p.argmax(axis=1)
        return pd.DataFrame({"lang": [names[i] for i in best], "confidence": p[np.arange(len(p)), best]})

    out = out.withColumn("_f", fuse("_l.likelihood", "_s", "_h", "_d", "_declared"))
    return out.select(*carry, declared, "_f.lang", "_f.confidence", ((F.col("_l.n") > 0) & (F.col("_f.confidence") >= 0.5)).alias("kept"))


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host, suffix of pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", text.alias("text"), F.lower(_first(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})")).alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)
