"""A corpus pipeline: toxicity filter, exact dedup, near-duplicate removal, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``, whatever other columns there are.  An empty
table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from faultline.llm.storage import materialize
from faultline.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3; the model is fitted on the labelled ones.

    Null and empty texts score as texts without words; rows with a null id are scored but not learned from; repeated rows
    score alike, and all of them stay or go.
    """
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return toxicity.score(rows, model, keep=["row"]).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of equal texts (A-Z lower-cased).

    Null text counts as empty, so one row of all null and empty texts stays; a null id stays only where no other row has its
    text; of repeated rows one stays.
    """
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group that n-gram Jaccard links connect.

    Null and empty texts have no n-grams and stay; rows with a null id stay; rows that share an id stay or go together.
    """
    ship(spark)
    return near_dup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in the order of training.

    Null and empty texts have no words and aren't taken; null sources are one source, the last; repeated rows count apart.
    """
    ship(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, a row for each copy; null text is empty: no tokens."""
    ship(spark)
    return bpe.encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id", "source"])


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near), ("mixing", mix_sources), ("bpe", encode)]
#: SQL can't express the classifier, MinHash and BPE; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
