"""Program facts projected from the test tables, in Spark and as DuckDB views.

A user stands for a function, a time stamp in microseconds for an offset, and the type of an event for the kind of fact:
error events are throws, views are try blocks, clicks are calls, sign-ups are declarations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catching, graph
from ..storage import materialize


@dataclass
class Facts:
    functions: DataFrame
    throws: DataFrame
    tries: DataFrame
    calls: DataFrame
    declared: DataFrame

    @cached_property
    def catch(self) -> DataFrame:
        """Catchers, derived once for all that reads them."""
        return materialize(catching.catchers(self.tries, self.throws), "catchers")

    @cached_property
    def direct(self) -> DataFrame:
        """Throws that leave their function, derived once."""
        return materialize(catching.uncaught(self.throws, self.tries, catch=self.catch), "direct")

    @cached_property
    def sites(self) -> DataFrame:
        return materialize(graph.call_sites(self.calls, self.functions), "sites")

    @cached_property
    def blocked(self) -> DataFrame:
        return materialize(catching.blocked_edges(self.sites, self.catch), "blocked")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str) -> Facts:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"))
    of = lambda kind: ev.where(F.col("event_type") == kind)
    unknown = F.col("event_id") % 11 == 0
    errors = of("error").select(F.col("user_id").alias("fn"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.when(unknown, "unknown").otherwise("named").alias("kind"), F.when(~unknown, F.concat(F.lit("E"), (F.col("event_id") * 31) % 7)).alias("name"))
    end = F.col("pos") + F.floor(F.col("value") * 60) * F.lit(120000000)
    views = of("view").withColumn("end", end.cast("long"))
    tries = views.select(
        F.col("user_id").alias("fn"), F.col("event_id").alias("block_no"), F.col("pos").alias("try_start"), F.col("end").alias("try_end"), F.col("end").alias("catch_start"), (F.col("end") + 1).alias("catch_end"),
        F.when(F.col("event_id") % 3 == 1, F.array(F.concat(F.lit("E"), F.col("event_id") % 7))).otherwise(F.array().cast("array<string>")).alias("caught_types"),
    )
    rethrows = views.where("event_id % 3 = 2").select(F.col("user_id").alias("fn"), F.col("end").alias("start"), (F.col("end") + 1).alias("end"), F.lit("rethrow").alias("kind"), F.lit("e").alias("name"))
    functions = ev.select(F.col("user_id").alias("fn")).distinct()
    last = ev.agg(F.max("user_id")).first()[0] or 0
    calls = of("click").select(F.col("user_id").alias("caller"), ((F.col("event_id") * 7919) % F.lit(last + 1)).alias("callee"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    declared = of("signup").select(F.col("user_id").alias("fn"), F.concat(F.lit("E"), F.col("event_id") % 7).alias("error_type")).distinct()
    return Facts(functions, errors.unionByName(rethrows), tries, calls, declared)


#: The same facts as common table expressions; queries go on after them.
VIEWS = """
ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS pos FROM events),
views AS (SELECT *, pos + CAST(floor(value * 60) AS BIGINT) * 120000000 AS fin FROM ev WHERE event_type = 'view'),
throws AS (SELECT user_id AS fn, pos AS s, pos + 1 AS e, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'named' END AS kind, CASE WHEN event_id % 11 <> 0 THEN 'E' || ((event_id * 31) % 7) END AS name FROM ev WHERE event_type = 'error'
  UNION ALL SELECT user_id, fin, fin + 1, 'rethrow', 'e' FROM views WHERE event_id % 3 = 2),
tries AS (SELECT user_id AS fn, event_id AS block_no, pos AS ts, fin AS te, fin AS cs, fin + 1 AS ce, CASE WHEN event_id % 3 = 1 THEN 'E' || (event_id % 7) END AS ct FROM views),
functions AS (SELECT DISTINCT user_id AS fn FROM ev),
calls AS (SELECT user_id AS caller, (event_id * 7919) % ((SELECT max(user_id) FROM events) + 1) AS callee, pos AS s FROM ev WHERE event_type = 'click'),
declared AS (SELECT DISTINCT user_id AS fn, 'E' || (event_id % 7) AS error_type FROM ev WHERE event_type = 'signup'),
flagged AS (SELECT t.*, EXISTS (SELECT 1 FROM throws r WHERE r.kind = 'rethrow' AND r.fn = t.fn AND r.s >= t.cs AND r.e <= t.ce) AS rethrows FROM tries t),
catchers AS (SELECT fn, ts, te, ct FROM flagged WHERE ct IS NOT NULL OR NOT rethrows),
direct AS (SELECT t.* FROM throws t WHERE NOT EXISTS (SELECT 1 FROM catchers c WHERE t.kind <> 'rethrow' AND c.fn = t.fn AND t.s >= c.ts AND t.s < c.te AND (c.ct IS NULL OR (t.kind = 'named' AND c.ct = t.name)))
  AND NOT (t.kind = 'rethrow' AND EXISTS (SELECT 1 FROM tries c WHERE c.fn = t.fn AND t.s >= c.cs AND t.e <= c.ce))),
sites AS (SELECT DISTINCT caller, callee, s FROM calls WHERE caller IN (SELECT fn FROM functions) AND callee IN (SELECT fn FROM functions)),
edges AS (SELECT DISTINCT caller, callee FROM sites),
hits AS (SELECT DISTINCT x.caller, x.callee, x.s, c.ct FROM sites x JOIN catchers c ON c.fn = x.caller AND x.s >= c.ts AND x.s < c.te),
kinds AS (SELECT DISTINCT kind, name FROM direct),
edge_pass AS (SELECT e.caller, e.callee, k.kind, k.name FROM edges e, kinds k WHERE k.kind = 'rethrow' OR EXISTS (SELECT 1 FROM sites x WHERE x.caller = e.caller AND x.callee = e.callee
  AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.caller = x.caller AND h.callee = x.callee AND h.s = x.s AND (h.ct IS NULL OR (k.kind = 'named' AND h.ct = k.name)))))
"""
CLOSURE = """
closure(fn, kind, name) AS (SELECT DISTINCT fn, kind, name FROM direct UNION SELECT p.caller, c.kind, c.name FROM closure c JOIN edge_pass p ON p.callee = c.fn AND p.kind = c.kind AND p.name IS NOT DISTINCT FROM c.name)
"""


def sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([VIEWS, *more]) + select
