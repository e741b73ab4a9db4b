"""Tables that cut lineage: Parquet files in the folder that all executors share.

The folder comes from ``spark.checkpoint.dir`` of the session.  It is set here only where the session has none, as in
tests on one machine.  Written tables survive the loss of any executor; nothing relies on cached or local blocks.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"faultline-{os.getuid()}")
        os.makedirs(root[7:], exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root else ("file://" + root if root.startswith("/") else root)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends (or by ``release``)."""
    path = f"{shared_dir(spark).rstrip('/')}/faultline-tables/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later reads neither recompute nor reshuffle."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(file system, path) of a URI, by pyarrow: local, HDFS or object stores."""
    return fs.FileSystem.from_uri(uri)


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``materialize`` gave; the frames can't be used afterwards."""
    for path in {os.path.dirname(file) for df in frames for file in df.inputFiles()}:
        where, path = open_fs(path)
        where.delete_dir(path)


def forget(spark: SparkSession) -> None:
    """Delete shuffles that no frame needs any more: Spark does so only when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Delete every table written so far; frames that read them can't be used afterwards."""
    while _written:
        try:
            where, path = open_fs(_written.pop())
            where.delete_dir(path)
        except (OSError, ValueError):
            pass
