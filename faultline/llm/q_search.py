"""Query op7: nearest neighbours among embeddings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hash_forest import nearest


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


QUERIES = {"op7_hash_forest": op7_hash_forest}
ORACLE: dict[str, str] = {}
