"""Query of the vector codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .laesa_codes import Settings, vector_codes

ENTRIES, PARTS, ROUNDS, SCALE = 16, 8, 6, 4096


def op13_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE)
    return vector_codes(read_table(spark, sf_dir, "embeddings"), settings=settings).withColumnRenamed("id", "vec_id").drop("label")


def _nearest(turn: int) -> str:
    """Nearest entry of every part under the codebooks of a round, as one table of the statement."""
    return f"""assigned{turn} AS MATERIALIZED (
  SELECT row, part, min(struct_pack(d := d, e := entry)) AS best FROM (
    SELECT p.row, p.part, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT AS d
    FROM parts p JOIN books{turn} b ON p.part = b.part) GROUP BY ALL
)"""


def _round(turn: int) -> str:
    return f"""{_nearest(turn)}, sums{turn} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT p.part, a.best.e AS entry, i, floor_div(sum(p.v[i])::BIGINT, count(*)) AS m
    FROM parts p JOIN assigned{turn} a USING (row, part), unnest(range(1, len(p.v) + 1)) AS t(i) GROUP BY ALL) GROUP BY ALL
), books{turn + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM books{turn} b LEFT JOIN sums{turn} s ON s.part = b.part AND s.entry = b.entry
)""".replace("floor_div(sum(p.v[i])::BIGINT, count(*))", "(sum(p.v[i])::BIGINT - ((sum(p.v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)")


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, part, list_transform(embedding[part * (len(embedding) // {PARTS}) + 1:(part + 1) * (len(embedding) // {PARTS})], lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM kept, unnest(range({PARTS})) AS t(part)
), books0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {ENTRIES}),
{", ".join(_round(t) for t in range(ROUNDS))},
{_nearest(ROUNDS)}, codes AS MATERIALIZED (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM assigned{ROUNDS} GROUP BY row
), numbers AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (row), numbers
"""
