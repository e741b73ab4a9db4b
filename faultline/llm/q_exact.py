"""Query op8: exact dedup of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_groups


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")
    return g.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {
    "op8_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, sha256(s) AS text_sha256 FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
