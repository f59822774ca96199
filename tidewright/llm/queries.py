"""The queries of this folder: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, media, packing, pieces, quality, secrets, simhash, spans, vectors, wordpiece
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_documents(_documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.deduplicate(_documents(spark, sf_dir))
    gone = F.col(out.columns[-1])
    places = F.array_join(F.transform(gone, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size(gone).alias("n_removed"), places.alias("removed"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{33FFF}"
_SPACE = r"\x20\x09-\x0D"

#: All pairs of vectors, and what is reachable over those that are near.
EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE list_bool_or(list_transform(e, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
c AS (SELECT x AS node, y AS other FROM p UNION SELECT c.node, p.y FROM c JOIN p ON p.x = c.other)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM embeddings
 LEFT JOIN (SELECT x AS vec_id, count(*) AS n_links FROM p GROUP BY x) USING (vec_id) LEFT JOIN (SELECT node AS vec_id, min(other) AS low FROM c GROUP BY node) USING (vec_id)"""

#: All spans of fifty words as text: later ones go, with the white space after their words.
SPAN_SQL = rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '(?:[{_UNSPACED}]|[^{_SPACE}{_UNSPACED}]+)[{_SPACE}]*') AS tokens FROM documents),
t AS (SELECT *, list_transform(tokens, lambda x: regexp_replace(x, '[{_SPACE}]+$', '')) AS words, length(text) - list_sum(list_transform(tokens, lambda x: length(x))) AS lead FROM w),
s AS (SELECT doc_id, k, array_to_string(words[k + 1:k + 50], ' ') AS span FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS k FROM t WHERE len(words) >= 50)),
l AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY span ORDER BY doc_id, k) AS seen FROM s) WHERE seen > 1),
i AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM l)),
g AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM i GROUP BY doc_id, island),
q AS (SELECT g.doc_id, lead + coalesce(list_sum(list_transform(tokens[1:a], lambda x: length(x))), 0) AS a, lead + list_sum(list_transform(tokens[1:b], lambda x: length(x))) AS b FROM g JOIN t USING (doc_id)),
o AS (SELECT doc_id, count(*) AS n, string_agg(a::BIGINT || '-' || b::BIGINT, ',' ORDER BY a) AS removed, list(a::BIGINT ORDER BY a) AS starts, list(b::BIGINT ORDER BY a) AS ends FROM q GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN text ELSE text[1:starts[1]] || array_to_string(list_transform(range(1, n + 1), lambda x: text[ends[x] + 1:coalesce(starts[x + 1], length(text))]), '') END AS text, coalesce(n, 0)::INT AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN o USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are held against brute force in tests."""
    return {"op6_embedding_near_dedup": EMBEDDING_SQL, "op9_substring_dedup": SPAN_SQL}
