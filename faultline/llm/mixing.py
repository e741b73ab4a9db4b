"""Mixing sources to target weights (operator 9): a time-varying curriculum.

Targets: sources share a number of words by weight; a target stops at ``most`` times its source's size and the excess is
shared again.  Each source's documents stand in a random order fixed by their ids; a source is read through once, twice or
in part until its target is met, so a document is taken as often as the reading passes it.  Time: each source has a weight
schedule over training time 0 to 1 (linear between knots).  Its integral, as a share of the whole, is the source's
cumulative demand; inverting it at the words read before a copy gives the copy's position, and documents are range-sorted
by position.

Cumulative words need no task that sees a whole source: a source is cut into ranges of the random order, sized by the
number of its rows; sums of ranges are added up first, then words within each range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

Knots = Sequence[tuple[float, float]]
#: Schedules by weight number: falling, even, rising.
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.5), (1.0, 1.0)))
RANGE_ROWS = 4096


def words_in(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def invert(share: Column, knots: Knots) -> Column:
    """Time at which a schedule has asked for ``share`` (0 to 1) of all it asks for."""
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule has rising times from 0 to 1 and weights that aren't negative")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole = sum(areas)
    if not whole > 0:
        raise ValueError("a schedule asks for nothing")
    out, before = None, 0.0
    want = share * F.lit(whole)
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:])):
        rest = F.greatest(want - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        t = F.lit(t0) + F.when(root > 0, F.lit(2.0) * rest / root).otherwise(F.lit(0.0))
        before += areas[k]
        t = F.least(t, F.lit(t1))
        out = F.when(want <= F.lit(before), t) if out is None else out.when(want <= F.lit(before), t)
    return out.otherwise(F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, pattern, target): ``sizes`` has source, n, source_size.

    One row a source: this table is small beside the documents.  Sources in code-point order, null last, take the weights
    in turn.  Capped sources are a prefix in the order of cap by weight: one running sum finds them.
    """
    one = F.lit(0)
    turn = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("pattern") + 1)
    t = sizes.withColumn("pattern", (turn % len(weights)).cast("int")).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.partitionBy(one).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy(one))).withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("w").over(Window.partitionBy(one)) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("full", (F.lit(float(share)) * F.col("total") - F.col("used")) / F.col("left") * F.col("w") >= F.col("cap"))
    t = t.withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(Window.partitionBy(one))).withColumn("left", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(Window.partitionBy(one)))
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.lit(float(share)) * F.col("total") - F.col("used")) / F.col("left") * F.col("w"))
    return t.select("source", "n", "source_size", "pattern", target.alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedules: Sequence[Knots] = SCHEDULES, seed: str = "", carry: bool = False) -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, taken, whole, part, position`` and, with ``carry``,
    ``row``: all input columns as a struct (so clashing names are safe).

    ``taken`` words = ``whole`` readings of the document + ``part`` words of one more (only where a source's last reading
    ends within it).  ``position``: time of the first reading, null if nothing is taken.  Taken words of a source add up to
    its target, rounded.  Null text has size 0; null sources are one source, the last; null ids stand in the order like an
    empty id.  Rows that agree in id and size are interchangeable, so reruns agree.  Empty input gives no rows.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words_in(F.col(f"`{text_col}`")).alias("size"), key.alias("key"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    narrow = materialize(base.drop("row").withColumn("name", name), "sizes")  # words are counted once for all that follows
    if not carry:
        base = narrow.drop("name")
    stats = materialize(targets(narrow.groupBy("name", "source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")).drop("name"), weights, share, most).withColumn("name", name).drop("source"), "sources")
    largest = stats.agg(F.max("n")).first()[0] or 0
    digits = min(8, max(0, math.ceil(math.log(max(1.0, largest / RANGE_ROWS), 16))))
    cut = F.substring("key", 1, digits) if digits else F.lit("")
    ranges = narrow.groupBy("name", cut.alias("range")).agg(F.sum("size").alias("words"))
    offsets = ranges.select("name", "range", F.coalesce(F.sum("words").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    offsets = materialize(offsets.join(stats, "name"), "ranges")
    within = Window.partitionBy("name", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("name", name).withColumn("range", cut).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(offsets, ["name", "range"]).withColumn("before", F.col("offset") + F.col("inside")).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    rows = rows.withColumn("whole", F.floor(F.col("goal") / size).cast("long"))
    rows = rows.withColumn("part", F.least(F.greatest(F.col("goal") - F.col("whole") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size")))
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(0)).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(F.col("before"), schedules)))
    return rows.select("id", "source", "size", "source_size", "target", "taken", "whole", "part", "position", "before", "goal", "pattern", *(["row"] if carry else []))


def position(words_before: Column, schedules: Sequence[Knots]) -> Column:
    """Time of the copy before which its source has ``words_before`` words of ``goal``."""
    share = words_before.cast("double") / F.greatest(F.col("goal"), F.lit(1)).cast("double")
    out = None
    for k, knots in enumerate(schedules):
        cond = F.col("pattern") % len(schedules) == k
        out = F.when(cond, invert(share, knots)) if out is None else out.when(cond, invert(share, knots))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: Sequence[Knots] = SCHEDULES, **options) -> DataFrame:
    """The mix itself: input columns, each document as often as it is taken, range-sorted by position in training.

    Documents stay whole: the one document of a source within which its last reading ends is taken once more if at least
    half of it was still wanted.  Documents without words aren't taken.
    """
    plan = plan_mix(docs, id_col, text_col, source_col, schedules=schedules, carry=True, **options)
    copies = (F.col("whole") + (F.col("part") * 2 >= F.greatest(F.col("size"), F.lit(1))).cast("long")).cast("int")
    rows = plan.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("at", position(F.col("before") + F.col("copy") * F.col("source_size"), schedules))
    return rows.select("at", "id", "copy", "row").repartitionByRange("at", "id", "copy").sortWithinPartitions("at", "id", "copy").select("row.*")
