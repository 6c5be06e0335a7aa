"""Query of the SpotSigs fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .spot_signatures import COMMON, Settings, edited_pairs, fingerprint


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_pairs(read_table(spark, sf_dir, "documents"), settings=Settings())
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint("signatures").alias("fingerprint"), fingerprint("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next",
    )


_COMMON = ", ".join(f"'{w}'" for w in COMMON)

OP11_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC, text) AS row, count(*) OVER () AS n FROM documents WHERE doc_id IS NOT NULL
), pairs AS MATERIALIZED (
  SELECT a.doc_id, a.row, b.row AS next_row, a.text, left(a.text, length(a.text) - length(a.text) // 3) || left(b.text, length(a.text) // 3) AS edited
  FROM docs a JOIN docs b ON b.row = CASE WHEN a.row = a.n THEN 1 ELSE a.row + 1 END
  UNION ALL SELECT doc_id, -row_number() OVER (), NULL, coalesce(text, ''), left(coalesce(text, ''), length(coalesce(text, '')) - length(coalesce(text, '')) // 3) FROM documents WHERE doc_id IS NULL
), texts AS (SELECT row, 0 AS kind, text FROM pairs UNION ALL SELECT row, 1, edited FROM pairs),
split AS MATERIALIZED (
  SELECT row, kind, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), words AS (SELECT row, kind, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest([NULL] || w[1:len(w) - 1]) AS anchor FROM split WHERE len(w) > 0),
content AS (
  SELECT row, kind, i, concat_ws(' ', anchor, word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS signature,
         lead(word, 2) OVER o IS NOT NULL AND (i > coalesce(lag(i) OVER o, 0) + 1 OR lag(i, 8) OVER o = i - 8) AS spot
  FROM words WHERE word NOT IN ({_COMMON}) WINDOW o AS (PARTITION BY row, kind ORDER BY i)
), spots AS MATERIALIZED (SELECT row, kind, list(signature) AS signatures FROM content WHERE spot GROUP BY ALL),
sets AS MATERIALIZED (
  SELECT row, kind, list_sort(list_distinct(list_transform(CASE WHEN p.signatures IS NOT NULL THEN p.signatures WHEN len(w) > 0 THEN w WHEN text <> '' THEN [text] ELSE [] END, lambda x: left(md5(x), 8)))) AS s
  FROM split LEFT JOIN spots p USING (row, kind)
), compared AS (
  SELECT p.doc_id, length(p.text) AS n_chars, sha256(p.edited) AS edited_sha256, a.s AS a, b.s AS b, coalesce(c.s, []) AS c
  FROM pairs p JOIN sets a ON a.row = p.row AND a.kind = 0 JOIN sets b ON b.row = p.row AND b.kind = 1 LEFT JOIN sets c ON c.row = p.next_row AND c.kind = 0
), shared AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM compared)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN a = b THEN 1.0::DOUBLE WHEN ab::DOUBLE / (len(a) + len(b) - ab) >= {Settings().least} THEN ab::DOUBLE / (len(a) + len(b) - ab) ELSE 0.0::DOUBLE END AS near_edited,
       CASE WHEN a = c THEN 1.0::DOUBLE WHEN ac::DOUBLE / (len(a) + len(c) - ac) >= {Settings().least} THEN ac::DOUBLE / (len(a) + len(c) - ac) ELSE 0.0::DOUBLE END AS near_next
FROM shared
"""
