"""Anti-joins: errors that no declaration covers, and implementations that throw what their parent type doesn't declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import ancestors
from .typing import ExactResolver, Resolver


def missing_declarations(propagated: DataFrame, declared: DataFrame, resolver: Resolver | None = None) -> DataFrame:
    """Rows of ``propagated`` (fn, kind, name, origin_fn, origin_start, ..) that ``declared`` (fn, error_type) doesn't cover.

    Named: some declared type fits.  Unknown: its type is resolved where it was thrown and then treated as named, and the
    output names it; if it stays unknown, a declared ``unknown`` covers it.  A thrown union is its members.  A rethrow is
    never covered.
    """
    resolver = resolver or ExactResolver()
    p = propagated
    if "origin_fn" in p.columns:
        known = resolver.resolved(p.where("kind = 'unknown'").select(F.col("origin_fn").alias("fn"), F.col("origin_start").alias("start")).distinct())
        known = known.select(F.col("fn").alias("origin_fn"), F.col("start").alias("origin_start"), F.col("type").alias("__type"))
        p = p.join(known, ["origin_fn", "origin_start"], "left")
        found = (F.col("kind") == "unknown") & F.col("__type").isNotNull()
        p = p.withColumn("name", F.when(found, F.col("__type")).otherwise(F.col("name"))).withColumn("kind", F.when(found, F.lit("named")).otherwise(F.col("kind"))).select(*propagated.columns)
    aliases = getattr(resolver, "aliases", None)
    if aliases is not None:  # each member of a thrown union must be covered
        m = aliases.select(F.col("alias").alias("__alias"), F.col("member").alias("__member")).distinct()
        p = p.join(m, (F.col("kind") == "named") & (F.col("name") == F.col("__alias")), "left").withColumn("name", F.coalesce("__member", "name")).select(*propagated.columns)
    d = declared.select(F.col("fn").alias("d_fn"), F.col("error_type").alias("declared")).distinct()
    fits = resolver.assignable(p.where("kind = 'named'").select(F.col("name").alias("thrown")), d)
    cover = d.join(fits, "declared").select("d_fn", "thrown").distinct()
    by_name = (F.col("fn") == F.col("d_fn")) & (F.col("kind") == "named") & (F.col("name") == F.col("thrown"))
    literal = d.where("declared = 'unknown'").select(F.col("d_fn").alias("u_fn"))
    return p.join(cover, by_name, "left_anti").join(literal, (F.col("fn") == F.col("u_fn")) & (F.col("kind") == "unknown"), "left_anti")


def last_signature(signatures: DataFrame) -> DataFrame:
    """One row per (type_name, method_name): the last by ``ordinal``."""
    last = signatures.groupBy("type_name", "method_name").agg(F.max_by(F.struct(*signatures.columns), "ordinal").alias("s"))
    return last.select("s.*")


def substitution_violations(methods: DataFrame, propagated: DataFrame, relations: DataFrame, signatures: DataFrame, resolver: Resolver | None = None) -> DataFrame:
    """(fn, parent_type, method_name, kind, name): what a method throws and its parent's signature doesn't declare.

    ``methods`` (fn, class_name, method_name); ``signatures`` (type_name, method_name, declared array, ordinal), for every
    ancestor by name, across files.  Named errors must fit a declared type; unknown errors and rethrows are illegal only if
    the parent declares nothing.  No types are resolved.
    """
    resolver = resolver or ExactResolver()
    up = ancestors(relations).select(F.col("type").alias("class_name"), F.col("ancestor").alias("parent_type"))
    sig = last_signature(signatures).select(F.col("type_name").alias("parent_type"), "method_name", F.coalesce("declared", F.array().cast("array<string>")).alias("declared"))
    pairs = methods.where("class_name is not null").join(up, "class_name").join(sig, ["parent_type", "method_name"])
    thrown = pairs.join(propagated.select("fn", "kind", "name").distinct(), "fn")
    one = pairs.select(F.explode("declared").alias("declared")).distinct()
    fits = resolver.assignable(thrown.where("kind = 'named'").select(F.col("name").alias("thrown")), one)
    cover = pairs.select(F.col("fn").alias("c_fn"), F.col("parent_type").alias("c_type"), F.explode("declared").alias("declared")).join(fits, "declared").select("c_fn", "c_type", "thrown").distinct()
    named = thrown.where("kind = 'named'").join(cover, (F.col("fn") == F.col("c_fn")) & (F.col("parent_type") == F.col("c_type")) & (F.col("name") == F.col("thrown")), "left_anti")
    other = thrown.where("kind != 'named' and size(declared) = 0")
    return named.unionByName(other).select("fn", "parent_type", "method_name", "kind", "name").distinct()


def help_types(missing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``key`` columns and ``types``: error types of each group in order, runs of equal neighbours as one."""
    label = F.coalesce("name", F.lit("unknown"))
    rows = missing.withColumn("__label", label).withColumn("__was", F.lag(label).over(Window.partitionBy(*key).orderBy(*order)))
    kept = rows.where("__was is null or __was != __label")
    parts = F.array_sort(F.collect_list(F.struct(*order, "__label")))
    return kept.groupBy(*key).agg(F.array_join(F.transform(parts, lambda s: s["__label"]), ", ").alias("types"))
