"""Query op9: mixing the sources of documents to target weights."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import plan_mix


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


QUERIES = {"op9_mixing": op9_mixing}
ORACLE = {
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS pattern, CAST(source_size * 2.0 AS DOUBLE) AS cap FROM s),
v AS (SELECT *, CASE pattern WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w FROM w),
u AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS used,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS rest FROM v),
f AS (SELECT *, (1.5e0 * total - used) / rest * w >= cap AS filled FROM u),
g AS (SELECT *, sum(CASE WHEN filled THEN cap ELSE 0e0 END) OVER () AS c2, sum(CASE WHEN filled THEN 0e0 ELSE w END) OVER () AS r2 FROM f),
t AS (SELECT source, source_size, pattern, CASE WHEN filled THEN cap ELSE (1.5e0 * total - c2) / r2 * w END AS target FROM g),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.pattern, CAST(floor(t.target + 0.5e0) AS BIGINT) AS goal,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size > 0 THEN goal // greatest(source_size, 1) ELSE 0 END AS whole, least(greatest(goal - (goal // greatest(source_size, 1)) * source_size - before, 0), size) AS part,
  CAST(before AS DOUBLE) / CAST(greatest(goal, 1) AS DOUBLE) AS z FROM b),
p AS (SELECT *, whole * size + part AS taken, CASE pattern
  WHEN 0 THEN CASE WHEN z <= 1e0 THEN least(2e0 * z / (1.5e0 + sqrt(greatest(2.25e0 - 2e0 * z, 0e0))), 1e0) ELSE 1e0 END
  WHEN 1 THEN CASE WHEN z <= 1e0 THEN least(2e0 * z / 2e0, 1e0) ELSE 1e0 END
  ELSE CASE WHEN z * 1.125e0 <= 0.5e0 THEN least(2e0 * (z * 1.125e0) / (0.5e0 + sqrt(0.25e0 + 4e0 * (z * 1.125e0))), 0.5e0)
    WHEN z * 1.125e0 <= 1.125e0 THEN least(0.5e0 + 2e0 * (z * 1.125e0 - 0.5e0) / (1.5e0 + sqrt(greatest(2.25e0 - 2e0 * (z * 1.125e0 - 0.5e0), 0e0))), 1e0) ELSE 1e0 END END AS x FROM k)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CASE WHEN taken > 0 THEN round(x, 6) END AS position FROM p
"""
}
