"""How errors climb the call graph: the closure of uncaught throws over edges that don't catch them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .graph import callees, rounds


def passing(delta: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows of ``delta`` (fn, kind, name, ..) one call up: column ``fn`` becomes the caller, if the edge lets them pass.

    A rethrow is caught nowhere; an unknown error only where everything is caught.
    """
    up = delta.withColumnRenamed("fn", "__callee").join(edges, F.col("__callee") == edges.callee)
    every = blocked.where("caught is null").select(F.col("caller").alias("b1"), F.col("callee").alias("b2"))
    typed = blocked.where("caught is not null").select(F.col("caller").alias("b1"), F.col("callee").alias("b2"), F.col("caught").alias("b3"))
    at = (F.col("caller") == F.col("b1")) & (F.col("callee") == F.col("b2"))
    up = up.join(every, at & (F.col("kind") != "rethrow"), "left_anti").join(typed, at & (F.col("kind") == "named") & (F.col("name") == F.col("b3")), "left_anti")
    return up.drop("__callee", "callee").withColumnRenamed("caller", "fn")


def propagate(direct: DataFrame, edges: DataFrame, blocked: DataFrame, key: list[str] | None = None, most: int | None = None) -> DataFrame:
    """All (fn, error) that leave ``fn``, with the least ``depth``.

    ``direct``: uncaught throws (fn, kind, name and any columns that name their origin).  ``key`` names the grain (default:
    fn and every column of ``direct``); at (fn, kind, name) the closure stays as small as the answer, however many throws
    there are.  Set semantics: a passing edge depends on the edge and the error alone, so walks and simple paths agree.
    """
    key = key or direct.columns
    e, b = materialize(callees(edges), "edges"), materialize(blocked, "blocked")
    first = direct.select(*key).withColumn("depth", F.lit(0))

    def step(delta: DataFrame) -> DataFrame:
        return passing(delta, e, b).withColumn("depth", F.col("depth") + 1).select(*key, "depth")

    return rounds(first, step, key, most)


def paths(direct: DataFrame, edges: DataFrame, blocked: DataFrame, most: int = 10) -> DataFrame:
    """Every passing simple path of up to ``most`` calls, with multiplicity: direct's columns, ``path`` (callers from the
    top down, without the origin) and ``depth``.  Paths through a function twice aren't followed."""
    e, b = materialize(callees(edges), "edges"), materialize(blocked, "blocked")
    delta = materialize(direct.withColumn("origin", F.col("fn")).withColumn("path", F.array().cast(f"array<{direct.schema['fn'].dataType.simpleString()}>")).withColumn("depth", F.lit(0)), "paths")
    out = delta
    for _ in range(most):
        up = passing(delta, e, b).where((F.col("fn") != F.col("origin")) & ~F.array_contains("path", F.col("fn")))
        delta = materialize(up.withColumn("path", F.concat(F.array("fn"), F.col("path"))).withColumn("depth", F.col("depth") + 1).select(*out.columns), "paths")
        if not delta.limit(1).count():
            break
        out = out.unionByName(delta)
    return out
