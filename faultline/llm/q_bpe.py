"""Query op10: BPE encoding and decoding of documents."""

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


QUERIES = {"op10_bpe": op10_bpe}
ORACLE: dict[str, str] = {}
