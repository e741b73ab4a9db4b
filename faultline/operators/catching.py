"""Which throws leave their function: interval joins of positions with try blocks.

Fact tables: ``throws`` (fn, start, end, kind, name), kind being named, rethrow or unknown; ``tries`` (fn, block_no,
try_start, try_end, catch_start, catch_end, caught_types).  Spans are half open.  Every interval join has equi keys: the
function and a bin of positions, so that one function with very many facts is spread over many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(start: Column, end: Column, x: Column) -> Column:
    """Point in interval: start <= x < end."""
    return (x >= start) & (x < end)


def within(inner_start: Column, inner_end: Column, start: Column, end: Column) -> Column:
    """Interval in interval, ends included."""
    return (inner_start >= start) & (inner_end <= end)


def bin_width(spans: DataFrame, start: str, end: str) -> int:
    """A width at which an average span covers about two bins."""
    mean = spans.agg(F.avg(F.col(end) - F.col(start))).first()[0]
    return max(1, int(mean or 1))


def _catch_spans(tries: DataFrame, width: int) -> DataFrame:
    spans = tries.where("catch_start is not null").select("fn", "block_no", "catch_start", "catch_end")
    return binned(spans, width, "catch_start", "catch_end").withColumnRenamed("fn", "c_fn").withColumnRenamed("bin", "c_bin")


def _in_catch(width: int) -> Column:
    return (F.col("fn") == F.col("c_fn")) & (F.floor(F.col("start") / width) == F.col("c_bin")) & within(F.col("start"), F.col("end"), F.col("catch_start"), F.col("catch_end"))


def with_rethrow_flag(tries: DataFrame, throws: DataFrame) -> DataFrame:
    """``tries`` with ``rethrows``: whether a rethrow of the function lies within the block's catch span."""
    width = bin_width(tries, "catch_start", "catch_end")
    r = throws.where("kind = 'rethrow'").select("fn", "start", "end")
    has = _catch_spans(tries, width).join(r, _in_catch(width), "left_semi").select(F.col("c_fn").alias("fn"), "block_no", F.lit(True).alias("rethrows")).distinct()
    return tries.join(has, ["fn", "block_no"], "left").withColumn("rethrows", F.coalesce("rethrows", F.lit(False)))


def outside_catches(throws: DataFrame, tries: DataFrame) -> DataFrame:
    """``throws`` without the rethrows that lie within a catch span of their own function."""
    width = bin_width(tries, "catch_start", "catch_end")
    return throws.join(_catch_spans(tries, width), (F.col("kind") == "rethrow") & _in_catch(width), "left_anti")


def catchers(tries: DataFrame, throws: DataFrame, parity: bool = False) -> DataFrame:
    """(fn, try_start, try_end, caught): one row per caught type; null ``caught`` catches everything but rethrows.

    A block without caught types catches everything unless its catch rethrows.  A block without a catch clause catches
    nothing; with ``parity`` it counts as one that catches everything.
    """
    t = with_rethrow_flag(tries, throws)
    if not parity:
        t = t.where("catch_start is not null")
    every = t.where("size(caught_types) = 0 and not rethrows").select("fn", "try_start", "try_end", F.lit(None).cast("string").alias("caught"))
    typed = t.select("fn", "try_start", "try_end", F.explode("caught_types").alias("caught"))
    return every.unionByName(typed)


def binned(spans: DataFrame, width: int, start: str = "try_start", end: str = "try_end") -> DataFrame:
    """``spans`` once for each bin of positions that they touch (column ``bin``); empty spans vanish."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return spans.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def caught_at(points: DataFrame, catch: DataFrame, how: str = "left_anti", width: int | None = None) -> DataFrame:
    """``points`` (fn, pos, kind, name, ..) kept (``left_semi``) or dropped (``left_anti``) if a catcher holds them."""
    width = width or bin_width(catch, "try_start", "try_end")
    c = binned(catch, width).select(F.col("fn").alias("c_fn"), F.col("bin").alias("c_bin"), "try_start", "try_end", "caught")
    at = (F.col("fn") == F.col("c_fn")) & (F.floor(F.col("pos") / width) == F.col("c_bin")) & contains(F.col("try_start"), F.col("try_end"), F.col("pos")) & (F.col("kind") != "rethrow")
    fits = F.col("caught").isNull() | ((F.col("kind") == "named") & (F.col("name") == F.col("caught")))
    return points.join(c, at & fits, how)


def uncaught(throws: DataFrame, tries: DataFrame, parity: bool = False, catch: DataFrame | None = None) -> DataFrame:
    """The throws that leave their own function.  ``catch``: the catchers, where they are at hand."""
    pts = outside_catches(throws, tries).withColumn("pos", F.col("start"))
    return caught_at(pts, catchers(tries, throws, parity) if catch is None else catch).drop("pos")


def blocked_edges(sites: DataFrame, catch: DataFrame, width: int | None = None) -> DataFrame:
    """(caller, callee, caught): types that every call site of an edge catches; null ``caught``: everything is caught.

    ``sites``: (caller, callee, start, ..), one row a call site.  An edge lets an error pass if some site of it isn't inside
    a block that catches the error.  Types that no block names need no row, so nothing is crossed with the set of types.
    """
    width = width or bin_width(catch, "try_start", "try_end")
    edge, site = Window.partitionBy("caller", "callee"), Window.partitionBy("caller", "callee", "pos")
    s = sites.select("caller", "callee", F.col("start").alias("pos")).distinct()
    c = binned(catch, width).select("fn", "bin", "try_start", "try_end", "caught")
    hit = s.join(c, (F.col("caller") == F.col("fn")) & (F.floor(F.col("pos") / width) == F.col("bin")) & contains(F.col("try_start"), F.col("try_end"), F.col("pos")))
    # a site where everything is caught counts as that alone, others count once for each type
    kinds = hit.select("caller", "callee", "pos", F.when(F.max(F.col("caught").isNull()).over(site), None).otherwise(F.col("caught")).alias("caught")).distinct()
    counts = kinds.groupBy("caller", "callee", "caught").agg(F.count("*").alias("k"))
    counts = counts.withColumn("n_whole", F.coalesce(F.max(F.when(F.col("caught").isNull(), F.col("k"))).over(edge), F.lit(0)))
    n = s.groupBy("caller", "callee").agg(F.count("*").alias("n"))
    full = F.when(F.col("caught").isNull(), F.col("n_whole") == F.col("n")).otherwise((F.col("n_whole") < F.col("n")) & (F.col("k") + F.col("n_whole") == F.col("n")))
    return counts.join(n, ["caller", "callee"]).where(full).select("caller", "callee", "caught")
