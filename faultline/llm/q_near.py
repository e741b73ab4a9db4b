"""Query op2: near duplicates of documents by n-gram Jaccard."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import near_duplicates


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "text_class", "n_links")


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLE: dict[str, str] = {}
