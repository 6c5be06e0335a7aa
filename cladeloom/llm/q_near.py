"""Query of the near-duplicate join: shingles of two words, as its contract says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .near_dedup import Settings, near_duplicates


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), settings=Settings(words=2)).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s
  FROM texts
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
), both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (
  SELECT u AS doc_id, v AS other FROM both_ways
  UNION SELECT r.doc_id, b.v FROM reached r JOIN both_ways b ON r.other = b.u
), lowest AS (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(l.low, t.doc_id)) AS component_id,
       t.doc_id = least(t.doc_id, coalesce(l.low, t.doc_id)) AS kept
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l USING (doc_id)
"""
