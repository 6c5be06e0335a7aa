"""Query of the archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .warc import archive_pages


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(read_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP4_SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, url FROM pages WHERE page_id IS NOT NULL
), told AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS original,
         array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, 10 * g + 1, 10) AS BIGINT) >> (35 - 5 * i)) & 31 AS BIGINT) + 1, 1) for i in range(8)] for g in range(4)]), '') AS digest
  FROM hashed
), parsed AS (
  SELECT *, regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS part FROM told
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(part.host, '^www\.', ''), '.')), ',') || ')'
         || CASE WHEN part.path = '' THEN '/' ELSE part.path END || CASE WHEN part.query = '?' THEN '' ELSE part.query END AS url_key,
       '1970-01-01T00:00:00Z' AS captured
FROM parsed
"""
