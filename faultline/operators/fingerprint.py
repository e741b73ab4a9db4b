"""Fingerprints of sets of rows: what a cached result depends on, as one digest a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import graph, reach

CHUNKS = 4


def _piece(part: Column, k: int) -> Column:
    """60 bits of a text's digest, as text."""
    return F.conv(F.substring(F.sha2(F.coalesce(part, F.lit("")), 256), 15 * k + 1, 15), 16, 10)


def _whole(sums: list[str]) -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in sums]), 256)


def fingerprint(rows: DataFrame, key: list[str], part: Column, to: str = "fingerprint") -> DataFrame:
    """``key`` columns and the digest of all ``part`` texts of each key, whatever their order; a repeated text counts anew.

    Digests of the texts are added up in pieces of 60 bits, so that rows are combined before the shuffle and no task holds
    all of a key's texts.  Null parts count as empty.
    """
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(_piece(part, k).cast("decimal(20,0)")).alias(f"s{k}") for k in range(CHUNKS)])
    return sums.select(*key, _whole(["n", *[f"s{k}" for k in range(CHUNKS)]]).alias(to))


def _member() -> Column:
    """What a function adds to the fingerprints of all that reach it."""
    return F.concat_ws(":", F.col("fn").cast("string"), F.coalesce("facts", F.lit("")))


def _result(below: DataFrame, shared: str) -> DataFrame:
    return below.select(F.col("root").alias("fn"), F.sha2(F.concat_ws(":", F.lit(shared), "below"), 256).alias("fingerprint"))


def closure_fingerprints(edges: DataFrame, roots: DataFrame, facts: DataFrame, shared: str = "") -> DataFrame:
    """``function_fingerprints`` of ``roots`` (root) over all that they reach by ``edges``, whose pairs are never rows where the
    graph fits a worker."""
    roots, e = roots.select("root").distinct(), materialize(graph.callees(edges), "edges")
    if (g := reach.pack(e, roots)) is None:
        at = graph.reachable(e, roots).unionByName(roots.select("root", F.col("root").alias("fn"))).distinct()
        return function_fingerprints(at, facts, shared)
    fns = e.select(F.col("caller").alias("fn")).unionByName(e.select(F.col("callee").alias("fn"))).unionByName(roots.select(F.col("root").alias("fn"))).distinct()
    own = fns.join(fingerprint(facts, ["fn"], F.col("fact"), "facts"), "fn", "left")
    sums = reach.sums(e, g, own.select("fn", *[_piece(_member(), k).cast("long").alias(f"p{k}") for k in range(CHUNKS)]))
    return _result(sums.select("root", _whole(["n", *[f"s{k}" for k in range(CHUNKS)]]).alias("below")), shared)


def function_fingerprints(pairs: DataFrame, facts: DataFrame, shared: str = "") -> DataFrame:
    """(fn, fingerprint): ``pairs`` (root, fn) with each root itself, ``facts`` (fn, fact): texts of what is known of a
    function; ``shared``: what all results depend on, such as the resolution fingerprint."""
    per = fingerprint(facts, ["fn"], F.col("fact"), "facts")
    return _result(fingerprint(pairs.join(per, "fn", "left"), ["root"], _member(), "below"), shared)
