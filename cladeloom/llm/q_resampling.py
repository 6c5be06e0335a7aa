"""Query of the importance resampling: documents drawn towards the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .importance_resampling import Settings, resampled


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), settings=Settings())
    return drawn.select(drawn["id"].alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 of a text in SQL: four bits at a time over the hexadecimal digits of its bytes, the low digit of a byte first.
_STEP = "list_reduce([(n)::UBIGINT] || range(4)::UBIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"

OP12_SQL = rf"""
WITH steps AS (SELECT list({_STEP} ORDER BY n) AS step FROM range(16) AS t(n)),
docs AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), wanted AS MATERIALIZED (
  SELECT -row_number() OVER () AS row,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), features AS MATERIALIZED (
  SELECT row, feature, count(*) AS n FROM (
    SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS feature
    FROM (SELECT row, w FROM docs UNION ALL SELECT row, w FROM wanted)) GROUP BY ALL
), codes AS MATERIALIZED (
  SELECT feature, xor(list_reduce(
    [4294967295::UBIGINT] || list_transform(range(1, len(h) + 1), lambda i: (strpos('0123456789ABCDEF', h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::UBIGINT),
    lambda c, x: xor(c >> 4, step[(xor(c, x) & 15)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM features)), steps
), counts AS MATERIALIZED (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE row > 0), 0) AS s, coalesce(sum(n) FILTER (WHERE row < 0), 0) AS t FROM features JOIN codes USING (feature) GROUP BY bucket
), totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, totals
), weights AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN codes USING (feature) JOIN gains USING (bucket) WHERE row > 0 GROUP BY row),
scored AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (row)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
