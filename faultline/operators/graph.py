"""Call graph: edges with their sites, neighbours, and closures by blocks of roots or semi-naive rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import reach

BROADCAST = 1 << 17  # rows of a table that may be sent to all tasks through the driver


def call_sites(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``calls`` (caller, callee, start, end) between known functions, a row a site.  Operators work on these rows, so an
    edge with very many sites is never one row."""
    known = functions.select("fn").distinct()
    return calls.join(known.withColumnRenamed("fn", "caller"), "caller", "left_semi").join(known.withColumnRenamed("fn", "callee"), "callee", "left_semi")


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee, sites): edges with their sites in order, for readers; ``call_sites`` is what plans use."""
    return call_sites(calls, functions).groupBy("caller", "callee").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("sites"))


def sites_of(edges: DataFrame) -> DataFrame:
    """(caller, callee, start, end), a row a call site."""
    return edges.select("caller", "callee", F.inline("sites"))


def callees(edges: DataFrame) -> DataFrame:
    """Direct callees, distinct."""
    return edges.select("caller", "callee").distinct()


def held_back(df: DataFrame, n: int | None = None) -> DataFrame:
    """A written table of ``n`` rows, joined by a shuffle if it has many: its files may be small all the same."""
    return df.hint("merge") if (df.count() if n is None else n) > BROADCAST else df


def rounds(first: DataFrame, step, key: list[str], most: int | None = None) -> DataFrame:
    """Least fixpoint: ``first`` and all that ``step(delta)`` adds; ``key`` columns tell rows apart, others (such as the
    depth) come from the first round that reaches a row.  Each round is written, so plans stay short and lost executors
    cost one round.  A round shuffles what it adds and the keys found so far."""
    parts = [materialize(first.dropDuplicates(key), "round")]
    n = parts[0].count()
    while True:
        delta = parts[-1]
        known = held_back(reduce(DataFrame.unionByName, [p.select(*key) for p in parts]), n)
        cond = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key])
        new = materialize(step(delta).dropDuplicates(key).alias("n").join(known.alias("k"), cond, "left_anti"), "round")
        if not (more := new.count()):
            break
        parts.append(new)
        n += more
        if most is not None and len(parts) > most:
            break
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, roots: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(root, fn): transitive callees; a root is its own callee only on a cycle.  ``roots``: column ``root``.

    By blocks of roots, where the graph fits a worker and ``most`` doesn't bound the calls; else by rounds."""
    e = materialize(callees(edges), "edges")
    if most is None and (g := reach.pack(e, roots)) is not None:
        return reach.pairs(e, g)
    first = e.select(F.col("caller").alias("root"), F.col("callee").alias("fn"))
    if roots is not None:
        first = first.join(roots.select("root"), "root", "left_semi")

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(e, delta.fn == e.caller).select("root", F.col("callee").alias("fn"))

    return rounds(first, step, ["root", "fn"], most)


def reachable_edges(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, caller, callee): edges out of a root and out of everything it reaches."""
    e = materialize(callees(edges), "edges")
    if (g := reach.pack(e, roots)) is not None:
        return reach.edges_below(e, g)
    r = reachable(e, roots)
    starts = e.select(F.col("caller").alias("root"), F.col("caller").alias("fn"))
    if roots is not None:
        starts = starts.join(roots.select("root"), "root", "left_semi")
    at = r.unionByName(starts).distinct()
    return at.join(e, at.fn == e.caller).select("root", "caller", "callee").distinct()


def ancestors(relations: DataFrame, distinct: bool = True, most: int = 64) -> DataFrame:
    """(type, ancestor, depth): closure of ``relations`` (child, parent), by name and safe on cycles; depth is the least.

    With ``distinct=False`` an ancestor comes once for each way to it that passes no type twice, with that way's depth, as a
    walk up the parents meets it (so a diamond's top comes twice); ``most`` bounds the length of a way.
    """
    if not distinct:
        e = materialize(relations.select("child", "parent"), "relations")
        walk = e.select(F.col("child").alias("type"), F.col("parent").alias("ancestor"), F.array("child", "parent").alias("way")).where("type != ancestor")
        parts = [materialize(walk, "ways")]
        for _ in range(most - 1):
            up = parts[-1].join(e, F.col("ancestor") == F.col("child")).where(~F.array_contains("way", F.col("parent")))
            parts.append(materialize(up.select("type", F.col("parent").alias("ancestor"), F.concat("way", F.array("parent")).alias("way")), "ways"))
            if not parts[-1].limit(1).count():
                break
        return reduce(DataFrame.unionByName, parts).select("type", "ancestor", (F.size("way") - 1).alias("depth"))
    e = materialize(relations.select("child", "parent").distinct(), "relations")
    first = e.select(F.col("child").alias("type"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(e, delta.ancestor == e.child).select("type", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"))

    return rounds(first, step, ["type", "ancestor"])
