"""Cross-file discovery: files that hold the definitions of what is called, round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import rounds
from ..storage import materialize


def discover(entry: DataFrame, targets: DataFrame, most: int = 10, skip: str = "/node_modules/") -> DataFrame:
    """(path, depth): ``entry`` files and those that ``targets`` (path, target) lead to, in at most ``most`` rounds.  Paths
    that hold ``skip`` aren't followed."""
    t = materialize(targets.where(~F.coalesce(F.contains(F.col("target").cast("string"), F.lit(skip)), F.lit(False))).distinct(), "targets")
    first = entry.select("path", F.lit(0).alias("depth"))

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(t, "path").select(F.col("target").alias("path"), (F.col("depth") + 1).alias("depth"))

    return rounds(first, step, ["path"], most)
