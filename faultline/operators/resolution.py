"""From call sites to definitions: exact positions first, then names within the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_line(calls: DataFrame, targets: DataFrame, functions: DataFrame) -> DataFrame:
    """(call columns, callee): ``calls`` (file, callee_start, ..) with ``targets`` (file, callee_start, def_file, def_line)
    to the function whose name is on that line (the last one, by start, if several are)."""
    at = functions.groupBy(F.col("file").alias("def_file"), F.col("name_line").alias("def_line")).agg(F.max_by("fn", "start").alias("callee"))
    return calls.join(targets, ["file", "callee_start"]).join(at, ["def_file", "def_line"]).select(*calls.columns, "callee")


def by_name(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call columns, callee): the function of the same name and file; of several the one with a body, then the first.

    Candidates are ranked once per (file, name), not per call.
    """
    f = functions if "has_body" in functions.columns else functions.withColumn("has_body", F.lit(True))
    rank = Window.partitionBy("file", "name").orderBy(F.desc("has_body"), "start", "end")
    first = f.withColumn("__r", F.row_number().over(rank)).where("__r = 1").select("file", F.col("name").alias("callee_name"), F.col("fn").alias("callee"))
    return calls.join(first, ["file", "callee_name"]).select(*calls.columns, "callee")


def resolve(calls: DataFrame, targets: DataFrame, functions: DataFrame, call_key: list[str]) -> DataFrame:
    """Every call with its callee: the resolved one, else the one by name; calls without either are dropped."""
    exact = by_line(calls, targets, functions).select(*call_key, F.col("callee").alias("__exact")).dropDuplicates(call_key)
    name = by_name(calls, functions).select(*call_key, F.col("callee").alias("__name")).dropDuplicates(call_key)
    both = calls.join(exact, call_key, "left").join(name, call_key, "left")
    return both.withColumn("callee", F.coalesce("__exact", "__name")).where("callee is not null").drop("__exact", "__name")
