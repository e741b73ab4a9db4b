"""Query op5: toxicity of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .toxicity import fit, score


def fold(id_col: str = "doc_id", mod: int = 4):
    return F.crc32(F.col(id_col).cast("string")) % mod


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, allowed=fold() != 2)
    return score(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
