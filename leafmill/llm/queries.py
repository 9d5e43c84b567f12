"""The corpus operators as queries: (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bytebpe, embeddedup, hilbert, language, licences, packing, quality, simhash, substrings, vafile
from leafmill.llm.common import table


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text")


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.repeated(table(spark, sf_dir, "documents")))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


def hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert.placed(table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=100_000))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents (the source is the host) and all pages; one of doc_id and page_id is null."""
    none = F.lit(None).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", none.alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))
    pages = language.page_rows(table(spark, sf_dir, "pages")).withColumn("doc_id", none)
    return language.identified(docs.unionByName(pages), carry=("doc_id", "page_id"))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash_near_dedup,
    "op2_license_scan": license_scan,
    "op3_suffix_array_dedup": suffix_array_dedup,
    "op4_byte_bpe": byte_bpe,
    "op5_exact_top_k": exact_top_k,
    "op6_hilbert_sharding": hilbert_sharding,
    "op7_quality_classifier": quality_classifier,
    "op8_best_fit_packing": best_fit_packing,
    "op9_language_id": language_id,
    "op10_embedding_near_dedup": embedding_near_dedup,
}


def _licence_sql() -> str:
    """The scan over lists of words: every place of a document is tried for every template, without the index."""
    apart = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    base = " UNION ALL ".join(
        f"SELECT r, i - 1 AS place, '{label}' AS label FROM w, unnest(range(1, len(ws) + 1)) AS u(i) WHERE " + " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in licences.BASE.items()
    )
    own = []
    for n, (label, words, _) in enumerate(licences.TEMPLATES):
        words, need = words.split(), licences.mandatory(n)
        share = " + ".join(f"(CASE WHEN i + {j} >= 1 AND ws[i + {j}] = '{x}' THEN 1 ELSE 0 END)" for j, x in enumerate(words))
        anchor = need[0][1]
        must = " AND ".join(f"ws[k + {j - anchor}] = '{x}'" for x, j in need)
        own.append(f"SELECT r, '{label}' AS label, ({share}) / {float(len(words))} AS share FROM (SELECT r, ws, k - {anchor} AS i FROM w, unnest(range(1, len(ws) + 1)) AS u(k) WHERE {must})")
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{apart}', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM documents),
b AS ({base}),
o AS ({' UNION ALL '.join(own)}),
bl AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM b GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM o) GROUP BY r),
sc AS (SELECT r, max(share) AS share FROM o GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(bl.names, '') AS base_labels, coalesce(al.names, '') AS labels, round(greatest(coalesce(share, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0.0 END), 6)::DOUBLE AS score
FROM w LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)"""


#: All strings of 50 bytes, as 100 hexadecimal digits; runs of those that a smaller id has; what stands between them.
_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, i, substr(h, 2 * i + 1, 100) AS g FROM d, unnest(range(0, len(h) // 2 - 49)) AS u(i)),
m AS (SELECT g, min(id) AS low FROM s GROUP BY g HAVING max(id) > min(id)),
x AS (SELECT r, i, i > 50 + lag(i) OVER (PARTITION BY r ORDER BY i) AS apart FROM s JOIN m USING (g) WHERE id > low),
n AS (SELECT r, i, count(*) FILTER (apart) OVER (PARTITION BY r ORDER BY i) AS run FROM x),
c AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY r, run),
k AS (SELECT r, h, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM c JOIN d USING (r)),
t AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS kept
  FROM k JOIN (SELECT r, max(b) AS last FROM c GROUP BY r) USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""


ORACLES: dict[str, str] = {
    "op2_license_scan": _licence_sql(),
    "op3_suffix_array_dedup": _REPEATS,
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id))::BIGINT AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
