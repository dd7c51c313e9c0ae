"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, lm_score, media, minhash, mixing, quality, secrets, substring_dedup
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    first, last = (F.round(f("positions"), 6) for f in (lambda c: F.get(c, F.lit(0)), F.array_max))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("bigint").alias("n_passes"), first.alias("first_position"), last.alias("last_position"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


#: A-Z to a-z alone; DuckDB's lower() folds all letters.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g
  FROM (SELECT doc_id, unnest([w[i:i + 2] FOR i IN range(1, greatest(len(w) - 1, 2))]) AS g FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reach JOIN links ON other = a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN n USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k
  FROM win JOIN (SELECT h, min(doc_id) AS least FROM win GROUP BY h) USING (h) WHERE doc_id > least
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS words
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

#: When a schedule's integral reaches a share of the whole, by the roots of its linear pieces' integrals.
_DUE = """CASE turn % 3
    WHEN 0 THEN CASE WHEN {0} * 1.05e0 <= 0.75e0 THEN (sqrt(2.25e0 - {0} * 1.05e0 / 0.6e0) - 1.5e0) / (-0.5e0 / 0.6e0)
      WHEN {0} <= 1 THEN 0.6e0 + (sqrt(greatest(1e0 - 2.5e0 * ({0} * 1.05e0 - 0.75e0), 0e0)) - 1e0) / -1.25e0 ELSE 1e0 END
    WHEN 1 THEN least({0}, 1e0)
    ELSE CASE WHEN {0} * 1.05e0 <= 0.3e0 THEN (sqrt(0.25e0 + 2.5e0 * {0} * 1.05e0) - 0.5e0) / 1.25e0
      WHEN {0} <= 1 THEN 0.4e0 + (sqrt(1e0 + ({0} * 1.05e0 - 0.3e0) / 0.6e0) - 1e0) / (0.5e0 / 0.6e0) ELSE 1e0 END END"""

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s
), c AS (SELECT *, turn % 3 + 1 AS weight, 3 * source_size AS cap FROM r
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS words
  FROM c
), l AS (SELECT *, CAST(words - capped AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM o
), t AS (
  SELECT source, source_size, turn, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, (cap / weight, turn)) FROM l WHERE level * weight <= cap) * weight) AS target FROM l
), placed AS (
  SELECT doc_id, size, source_size, turn, target, CAST(round(target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (SELECT *, coalesce(budget // nullif(source_size, 0), 0) AS passes FROM placed
), q AS (SELECT *, least(greatest(budget - passes * source_size - before, 0), size) AS part FROM p
), n AS (SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS rounds FROM q
), w AS (SELECT *, CAST(before AS DOUBLE) / target AS due, CAST(before + (rounds - 1) * source_size AS DOUBLE) / target AS due_last FROM n)
SELECT doc_id, size, source_size, target, CAST(size * passes + part AS BIGINT) AS taken, CAST(rounds AS BIGINT) AS n_passes,
  CASE WHEN rounds > 0 THEN round({_DUE.format("due")}, 6) END AS first_position,
  CASE WHEN rounds > 0 THEN round({_DUE.format("due_last")}, 6) END AS last_position
FROM w
"""

OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item, len(x) AS size, array_to_string(x, ' ') AS phrase
  FROM (SELECT item, unnest([w[i:i + 9] FOR i IN range(1, greatest(len(w) - 8, 2))]) AS x FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM p
), hits AS (
  SELECT doc_id, pos, size, phrase
  FROM (SELECT doc_id, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS pos, w FROM d, sizes WHERE len(w) >= size)
  CROSS JOIN LATERAL (SELECT array_to_string(w[pos:pos + size - 1], ' ') AS phrase)
  WHERE phrase IN (SELECT phrase FROM p)
), words AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits JOIN p USING (phrase) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality": op2_quality,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_lm_score": op7_lm_score,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_media": op10_media,
}
_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
