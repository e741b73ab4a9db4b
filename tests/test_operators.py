"""Relational operators on small hand-made facts, and the closure against a walk over random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import catching, declarations, graph, propagation, resolution
from faultline.operators.typing import StructuralResolver

THROWS = "fn string, start int, end int, kind string, name string"
TRIES = "fn string, block_no int, try_start int, try_end int, catch_start int, catch_end int, caught_types array<string>"


def frames(spark, throws=(), tries=(), calls=()):
    names = sorted({t[0] for t in throws} | {t[0] for t in tries} | {x for c in calls for x in c[:2]})
    f = spark.createDataFrame([(n,) for n in names], "fn string")
    return spark.createDataFrame(list(throws), THROWS), spark.createDataFrame(list(tries), TRIES), graph.call_edges(spark.createDataFrame(list(calls), "caller string, callee string, start int, end int"), f)


def climb(spark, throws=(), tries=(), calls=(), parity=False):
    t, b, e = frames(spark, throws, tries, calls)
    direct = catching.uncaught(t, b, parity)
    blocked = catching.blocked_edges(graph.sites_of(e), catching.catchers(b, t, parity))
    return {(r.fn, r.kind, r.name) for r in propagation.propagate(direct, e, blocked, ["fn", "kind", "name"]).collect()}


def test_catch_rules(spark):
    throws = [("f", 5, 9, "named", "A"), ("g", 5, 9, "named", "A"), ("h", 5, 9, "unknown", None), ("i", 5, 9, "named", "B"), ("j", 5, 9, "named", "A"), ("j", 25, 28, "rethrow", "e"), ("k", 5, 9, "named", "A"), ("l", 10, 12, "named", "A"), ("m", 5, 8, "rethrow", "x"), ("n", 5, 9, "unknown", None)]
    tries = [("f", 0, 0, 10, 20, 30, []), ("g", 0, 0, 10, 20, 30, ["A"]), ("h", 0, 0, 10, 20, 30, ["A"]), ("i", 0, 0, 10, 20, 30, ["A"]), ("j", 0, 0, 10, 20, 30, []), ("k", 0, 0, 10, None, None, []), ("l", 0, 0, 10, 20, 30, []), ("m", 0, 0, 10, 20, 30, []), ("n", 0, 0, 10, 20, 30, [])]
    assert climb(spark, throws, tries) == {("h", "unknown", None), ("i", "named", "B"), ("j", "named", "A"), ("k", "named", "A"), ("l", "named", "A"), ("m", "rethrow", "x")}
    assert ("k", "named", "A") not in climb(spark, throws, tries, parity=True)


def test_edges_filter_by_type_and_site(spark):
    throws = [("v", 1, 2, "named", "A"), ("v", 3, 4, "named", "B"), ("v", 5, 6, "unknown", None)]
    tries = [("typed", 0, 0, 10, 20, 30, ["A"]), ("all", 0, 0, 10, 20, 30, []), ("twice", 0, 0, 10, 20, 30, []), ("mixed", 0, 0, 10, 20, 30, ["A"]), ("mixed", 1, 40, 50, 60, 70, [])]
    calls = [("typed", "v", 5, 6), ("all", "v", 5, 6), ("twice", "v", 5, 6), ("twice", "v", 50, 51), ("mixed", "v", 5, 6), ("mixed", "v", 45, 46), ("top", "typed", 1, 2), ("gone", "nowhere", 1, 2)]
    got = climb(spark, throws, tries, calls)
    both = {("named", "B"), ("unknown", None)}
    assert {x[1:] for x in got if x[0] == "typed"} == both == {x[1:] for x in got if x[0] == "top"} == {x[1:] for x in got if x[0] == "mixed"}
    assert not [x for x in got if x[0] == "all"] and {x[1:] for x in got if x[0] == "twice"} == both | {("named", "A")}


@pytest.mark.parametrize("seed", range(3))
def test_closure_against_a_walk(spark, seed):
    rng = random.Random(seed)
    fns = [f"f{i}" for i in range(14)]
    throws = [(rng.choice(fns), p, p + 2, *rng.choice([("named", "A"), ("named", "B"), ("unknown", None)])) for p in rng.sample(range(0, 400, 5), 14)]
    tries = [(rng.choice(fns), k, s, s + 60, s + 60, s + 70, rng.choice([[], ["A"], ["B"], ["A", "B"]])) for k, s in enumerate(rng.sample(range(0, 340), 14))]
    calls = [(rng.choice(fns), rng.choice(fns), p, p + 1) for p in rng.sample(range(0, 400), 30)]

    def caught(fn, pos, kind, name):
        return kind != "rethrow" and any(b[0] == fn and b[2] <= pos < b[3] and (not b[6] or kind == "named" and name in b[6]) for b in tries)

    at = {(f, k, n) for f, p, _, k, n in throws if not caught(f, p, k, n)}
    while True:
        more = {(c, k, n) for c, d, p, _ in calls for f, k, n in at if f == d and not caught(c, p, k, n)} - at
        if not more:
            break
        at |= more
    assert climb(spark, throws, tries, calls) == at


def test_paths_keep_multiplicity(spark):
    t, b, e = frames(spark, [("d", 1, 2, "named", "A")], [], [("a", "b", 1, 2), ("a", "c", 3, 4), ("b", "d", 1, 2), ("c", "d", 1, 2), ("d", "a", 9, 10)])
    blocked = catching.blocked_edges(graph.sites_of(e), catching.catchers(b, t))
    got = sorted((r.fn, tuple(r.path)) for r in propagation.paths(t.select("fn", "kind", "name"), e, blocked).collect())
    assert got == [("a", ("a", "b")), ("a", ("a", "c")), ("b", ("b",)), ("c", ("c",)), ("d", ())]


def test_reachability_and_ancestors(spark):
    _, _, e = frames(spark, calls=[("a", "b", 1, 2), ("b", "c", 1, 2), ("c", "b", 1, 2), ("x", "a", 1, 2)])
    assert {tuple(r) for r in graph.reachable(e).collect()} == {("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c"), ("x", "a"), ("x", "b"), ("x", "c")}
    rel = spark.createDataFrame([("D", "B"), ("D", "C"), ("B", "A"), ("C", "A"), ("A", "D")], "child string, parent string")
    assert {(r.type, r.ancestor, r.depth) for r in graph.ancestors(rel).where("type = 'D'").collect()} == {("D", "B", 1), ("D", "C", 1), ("D", "A", 2), ("D", "D", 3)}
    assert graph.ancestors(rel.limit(0)).count() == 0


def test_missing_and_types(spark):
    p = spark.createDataFrame([("f", "named", "A", "f", 1), ("f", "named", "Sub", "f", 2), ("f", "unknown", None, "g", 3), ("g", "unknown", None, "g", 4), ("g", "rethrow", "e", "g", 5), ("h", "named", "AB", "h", 6), ("i", "named", "A", "i", 7)], "fn string, kind string, name string, origin_fn string, origin_start int")
    d = spark.createDataFrame([("f", "Base"), ("f", "A"), ("g", "unknown"), ("h", "A"), ("h", "B"), ("i", "AB")], "fn string, error_type string")
    left = lambda r: {(x.fn, x.kind, x.name) for x in declarations.missing_declarations(p, d, r).collect()}
    assert left(None) == {("f", "named", "Sub"), ("f", "unknown", None), ("g", "rethrow", "e"), ("h", "named", "AB"), ("i", "named", "A")}
    rel = spark.createDataFrame([("Sub", "Mid"), ("Mid", "Base")], "child string, parent string")
    aliases = spark.createDataFrame([("AB", "A"), ("AB", "B")], "alias string, member string")
    known = spark.createDataFrame([("g", 3, "Known")], "fn string, start int, type string")
    assert left(StructuralResolver(rel, aliases, known)) == {("f", "named", "Known"), ("g", "rethrow", "e")}


def test_substitution(spark):
    methods = spark.createDataFrame([("m1", "Impl", "find"), ("m2", "Impl", "save"), ("m3", None, "find"), ("m4", "Deep", "find")], "fn string, class_name string, method_name string")
    thrown = spark.createDataFrame([("m1", "named", "A"), ("m1", "named", "B"), ("m1", "unknown", None), ("m2", "unknown", None), ("m3", "named", "B"), ("m4", "named", "B")], "fn string, kind string, name string")
    rel = spark.createDataFrame([("Impl", "Repo"), ("Deep", "Impl"), ("Repo", "Repo")], "child string, parent string")
    sig = spark.createDataFrame([("Repo", "find", ["X"], 0), ("Repo", "find", ["A"], 1), ("Repo", "save", [], 2)], "type_name string, method_name string, declared array<string>, ordinal int")
    got = {(r.fn, r.kind, r.name) for r in declarations.substitution_violations(methods, thrown, rel, sig).collect()}
    assert got == {("m1", "named", "B"), ("m2", "unknown", None), ("m4", "named", "B")}


def test_resolution(spark):
    f = spark.createDataFrame([("a1", "x", "f", 0, 5, 1, False), ("a2", "x", "f", 9, 20, 3, True), ("b1", "y", "f", 0, 5, 7, True)], "fn string, file string, name string, start int, end int, name_line int, has_body boolean")
    c = spark.createDataFrame([(1, "x", "f", 50), (2, "x", "f", 60), (3, "y", "g", 70), (4, "y", "g", 80)], "call int, file string, callee_name string, callee_start int")
    t = spark.createDataFrame([("x", 60, "y", 7), ("y", 80, "x", 99)], "file string, callee_start int, def_file string, def_line int")
    assert {(r.call, r.callee) for r in resolution.resolve(c, t, f, ["call"]).collect()} == {(1, "a2"), (2, "b1")}


def test_help_types(spark):
    m = spark.createDataFrame([("f", 1, "A"), ("f", 2, "A"), ("f", 3, None), ("f", 4, "A"), ("g", 1, None)], "fn string, start int, name string")
    assert {(r.fn, r.types) for r in declarations.help_types(m, ["fn"], ["start"]).collect()} == {("f", "A, unknown, A"), ("g", "unknown")}


def test_everything_empty(spark):
    assert climb(spark) == set()
    t, b, e = frames(spark)
    assert catching.with_rethrow_flag(b, t).count() == 0 and graph.reachable_edges(e).count() == 0
