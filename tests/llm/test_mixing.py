import hashlib

import pytest
from pyspark.sql import functions as F

from faultline.llm import mixing
from faultline.llm.mixing import invert, mix, plan_mix


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t | {s: most * sizes[s] for s in full}
        full |= over


def size(t):
    return len((t or "").encode().split())


ROWS = [(k, " ".join(["w"] * (k * 37 % 50)), ["a", "é", "B", None, "z"][k % 7 % 5], "c") for k in range(300)]
ROWS += [(1000, None, "a", "c"), (1001, "", None, "c"), (None, "some words here", "B", None), (1002, "v " * 20_000, "a", "c"), (7, ROWS[7][1], ROWS[7][2], "c"), (1003, " \n", "only blank", "c")]


@pytest.mark.parametrize("rows_a_range", [4096, 4])
def test_against_brute_force(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_a_range)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, taken string").repartition(5)
    got = plan_mix(df).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, t, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.whole * r["size"] + r.part
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5
    # the random order: within a source, whoever stands earlier is taken first
    for s in sizes:
        mine = sorted(((hashlib.md5(str("" if r.id is None else r.id).encode()).hexdigest(), r.id or -1, r["size"]), r) for r in got if r.source == s)
        at = 0
        for _, r in mine:
            assert r.before == at
            at += r["size"]
    again = plan_mix(df.repartition(2)).collect()
    key = lambda r: (str(r.id), r["size"], r.taken, str(r.position))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_inversion(spark):
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0))):
        shares = [i / 40 for i in range(41)]
        out = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").orderBy("s").select(invert(F.col("s"), knots)).collect()]
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        for s, t in zip(shares, out):
            area = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                x = min(max(t, t0), t1)
                area += (x - t0) * (w0 + w0 + (w1 - w0) * (x - t0) / (t1 - t0)) / 2
            assert 0 <= t <= 1 and abs(area / whole - s) < 1e-9
    for bad in (((0.0, 1.0),), ((0.0, 0.0), (1.0, 0.0)), ((0.5, 1.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            invert(F.lit(0.5), bad)


def test_mix(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, position string").withColumn("copy", F.lit(1))
    out = mix(df)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    for r in plan_mix(df).collect():
        if r.id not in (7, None):
            assert n.get(r.id, 0) == r.whole + (2 * r.part >= max(1, r["size"]))
    assert mix(df.limit(0)).count() == plan_mix(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert mix(blank).count() == 0 and [r.taken for r in plan_mix(blank).collect()] == [0, 0]
