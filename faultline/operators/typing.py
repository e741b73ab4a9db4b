"""Which declared types cover a thrown type: resolvers return tables, never answers one by one."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import ancestors


class Resolver(Protocol):
    def assignable(self, thrown: DataFrame, declared: DataFrame) -> DataFrame:
        """Pairs (thrown, declared), distinct, of ``thrown`` (thrown) and ``declared`` (declared) that fit."""

    def resolved(self, throws: DataFrame) -> DataFrame:
        """(fn, start, type) of unknown throws whose type is known; ``throws`` has fn, start."""


class ExactResolver:
    """Equal names only; never resolves."""

    def assignable(self, thrown: DataFrame, declared: DataFrame) -> DataFrame:
        t = thrown.select("thrown").distinct()
        return t.join(declared.select("declared").distinct(), F.col("thrown") == F.col("declared"))

    def resolved(self, throws: DataFrame) -> DataFrame:
        return throws.select("fn", "start", F.lit(None).cast("string").alias("type")).where("false")


class StructuralResolver:
    """Nominal stand-in for a type service.  ``relations`` (child, parent); ``aliases`` (alias, member), a union type a row
    per member; ``known`` (fn, start, type) resolves unknown throws, e.g. from annotations.

    A type fits a declared one that is itself, an ancestor, or an alias of which a member fits; a thrown alias fits if all
    its members do.  Types whose members merely look alike don't fit.
    """

    def __init__(self, relations: DataFrame, aliases: DataFrame | None = None, known: DataFrame | None = None):
        self.relations, self.aliases, self.known = relations, aliases, known

    def _single(self, declared: DataFrame) -> DataFrame:
        """(thrown, declared) by ancestors and aliases; only for declared types, found from these down."""
        up = ancestors(self.relations).select(F.col("type").alias("thrown"), F.col("ancestor").alias("declared"))
        d = declared.select("declared").distinct()
        pairs = up.join(d, "declared", "left_semi").unionByName(d.select(F.col("declared").alias("thrown"), "declared"))
        if self.aliases is not None:
            m = self.aliases.join(d, F.col("alias") == F.col("declared"), "left_semi").select(F.col("member"), F.col("alias").alias("a"))
            below = up.join(m, up.declared == m.member).select("thrown", F.col("a").alias("declared"))
            pairs = pairs.unionByName(below).unionByName(m.select(F.col("member").alias("thrown"), F.col("a").alias("declared")))
        return pairs.distinct()

    def assignable(self, thrown: DataFrame, declared: DataFrame) -> DataFrame:
        t, single = thrown.select("thrown").distinct(), self._single(declared)
        fit = single.join(t, "thrown", "left_semi")
        if self.aliases is not None:
            members = self.aliases.join(t, F.col("alias") == F.col("thrown"), "left_semi").select("alias", "member")
            n = members.groupBy("alias").agg(F.countDistinct("member").alias("n"))
            each = members.join(single, members.member == single.thrown).groupBy("alias", "declared").agg(F.countDistinct("member").alias("k")).join(n, "alias").where("k = n")
            fit = fit.unionByName(each.select(F.col("alias").alias("thrown"), "declared"))
        return fit.distinct()

    def resolved(self, throws: DataFrame) -> DataFrame:
        if self.known is None:
            return ExactResolver().resolved(throws)
        return self.known.select("fn", "start", "type").where("type is not null").dropDuplicates(["fn", "start"]).join(throws.select("fn", "start").distinct(), ["fn", "start"], "left_semi")
