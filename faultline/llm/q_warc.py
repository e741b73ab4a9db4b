"""Query op4: pages written to WARC archives and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path
from .warc import read, with_revisits, write


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    files = write(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    ends = read(spark, files, folder, with_data=False).where("last")
    again = F.col("record_type") == "revisit"
    return ends.select("page_id", F.when(again, F.col("payload_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), F.when(again, F.col("payload_digest")).otherwise(F.col("sha256_so_far")).alias("payload_digest"), "record_type", F.when(again, F.col("refers_to").cast("long")).alias("refers_to"))


QUERIES = {"op4_warc": op4_warc}
ORACLE = {
    "op4_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 100
"""
}
