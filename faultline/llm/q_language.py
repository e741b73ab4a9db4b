"""Query op3: language of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import Codebook, predict, prototypes


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, book = spark.read.parquet(f"{sf_dir}/documents.parquet"), Codebook()
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    langs, protos = prototypes(docs, book, allowed=fold != 1)
    return predict(docs, langs, protos, book, keep=["doc_id"]).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
