"""Closures by blocks of roots against a walk, and against rounds of joins."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import fingerprint, graph, reach


def walk(edges, root):
    seen, todo = set(), [root]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def graph_of(seed):
    rng = random.Random(seed)
    n = 90
    return {(f"f{rng.randrange(n)}", f"f{rng.randrange(n)}") for _ in range(130)} | {(f"c{k}", f"c{k + 1}") for k in range(70)} | {("self", "self")}


@pytest.mark.parametrize("seed", range(2))
def test_blocks_against_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "rounds", None)  # no pair of the closure is a row of a shuffle
    monkeypatch.setattr(reach, "BATCH", 7)
    edges = graph_of(seed)
    e = spark.createDataFrame(sorted(edges) * 2, "caller string, callee string")
    want = {(r, x) for r in {a for a, _ in edges} for x in walk(edges, r)}
    got = list(map(tuple, graph.reachable(e).collect()))
    assert len(got) == len(want) and set(got) == want
    below = {(r, a, b) for r in {a for a, _ in edges} for a, b in edges if a == r or (r, a) in want}
    got = list(map(tuple, graph.reachable_edges(e).collect()))
    assert len(got) == len(below) and set(got) == below
    roots = spark.createDataFrame([("f1",), ("c3",), ("elsewhere",)], "root string")
    assert {tuple(r) for r in graph.reachable(e, roots).collect()} == {p for p in want if p[0] in ("f1", "c3")}
    monkeypatch.setattr(reach, "ROOM", 1 << 10)  # edges by few, words by one
    assert {tuple(r) for r in graph.reachable(e).collect()} == want


def test_rounds_where_the_graph_is_too_large(spark, monkeypatch):
    edges = graph_of(2)
    edges = {x for x in edges if x[0][0] != "c" or int(x[0][1:]) < 4}
    e = spark.createDataFrame(sorted(edges), "caller string, callee string")
    roots = spark.createDataFrame([("f1",), ("c1",), ("alone",)], "root string")
    facts = spark.createDataFrame([("f1", "x"), ("f1", "x"), ("c2", "y")], "fn string, fact string")
    run = lambda: [sorted(map(tuple, d.collect())) for d in (graph.reachable(e), graph.reachable_edges(e), fingerprint.closure_fingerprints(e, roots, facts, "m"))]
    blocks = run()
    for limit in ("NODES", "EDGES"):
        monkeypatch.setattr(reach, limit, 3)
        assert run() == blocks
        monkeypatch.undo()


def test_empty_graph(spark):
    e = spark.createDataFrame([], "caller long, callee long")
    roots, facts = spark.createDataFrame([(1,)], "root long"), spark.createDataFrame([], "fn long, fact string")
    assert graph.reachable(e).count() == 0 and graph.reachable_edges(e).count() == 0
    one = fingerprint.closure_fingerprints(e, roots, facts).collect()
    at = spark.createDataFrame([(1, 1)], "root long, fn long")
    assert one == fingerprint.function_fingerprints(at, facts).collect() and len(one) == 1


def test_sums_beyond_64_bits(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)], "caller long, callee long")
    p = spark.range(41).select(F.col("id").alias("fn"), F.lit((1 << 60) - 1).alias("p0"))
    g = reach.pack(e, spark.range(41).toDF("root"))
    assert {r.root: (r.n, int(r.s0)) for r in reach.sums(e, g, p).collect()} == {k: (41 - k, (41 - k) * ((1 << 60) - 1)) for k in range(41)}


def test_large_closures_send_nothing_through_the_driver(spark, monkeypatch):
    """Configurations that refer to others: tables of many rows are joined by shuffles, however small their files are."""
    from faultline.sources import config

    refs = spark.createDataFrame([(f"p{k}", f"p{k // 3}" if k % 5 else None) for k in range(60)], "path string, target string")
    edges = [(f"p{k}", f"p{k // 3}") for k in range(60) if k % 5]
    want = {(r, x) for r in {a for a, _ in edges} for x in walk(edges, r)}
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    for most, sent in ((0, False), (1000, True)):
        plans.clear()
        monkeypatch.setattr(graph, "BROADCAST", most)
        assert {tuple(r) for r in config.closure(refs).collect()} == want
        assert any("BroadcastExchange" in p for p in plans) == sent and len(plans) > 2
    found = config.references(spark.createDataFrame([("/a/tsconfig.json", '{"extends": "./b.json"}'), ("/a/b.json", "{}")], "path string, content string"))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.target for r in found.collect()] == ["/a/b.json"]
