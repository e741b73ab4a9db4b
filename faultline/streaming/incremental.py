"""Fact tables kept up to date from a folder of sources, with Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.extraction import extractions

_FILE = "path string, modificationTime timestamp, length long, content binary"


def source_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(path, content, content_hash, seen): source files of a folder as they appear; a changed file appears again."""
    raw = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx,mts,cts}").option("maxFilesPerTrigger", per_batch).load(folder)
    text = F.decode("content", "UTF-8")
    return raw.select("path", text.alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("seen"))


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Extract each new or changed file once and append its row to ``target``, by batch; a batch that is repeated after a
    failure replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        rows = extractions(batch).join(batch.select("path", "content_hash", "seen").distinct(), ["path", "content_hash"])
        rows.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    writer = source_stream(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest extraction of each file."""
    rows = spark.read.parquet(target)
    last = Window.partitionBy("path").orderBy(F.desc("seen"), F.desc("batch"))
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "seen", "batch")
