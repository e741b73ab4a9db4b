import hashlib
from collections import defaultdict

import pytest

from faultline.llm.exact_dedup import drop_exact_copies, exact_groups

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, keep):
    by = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        by[(t or "").translate(LOWER)].append((k, i))
    out = []
    for t, members in by.items():
        ids = [i for _, i in members if i is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        out += [(i, best, len(members), hashlib.sha256(t.encode()).hexdigest()) for _, i in members]
    return sorted(out, key=str)


def corpus():
    rows = [(k, f"Text {k % 7} É" if k % 3 == 0 else f"own {k}") for k in range(400)]
    return rows + [(1000, None), (1001, ""), (1002, "TEXT 1 É"), (1003, "text 1 é"), (None, "own 1"), (None, None), (5, "x" * 300_000), (7, "X" * 300_000)]


@pytest.mark.parametrize(("keep", "fan_in"), [("max", 2), ("min", 8)])
def test_against_grouping(spark, keep, fan_in):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_groups(df, keep=keep, fan_in=fan_in).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, bytes(r.sha256).hex()) for r in got), key=str) == brute(rows, keep)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({bytes(r.sha256) for r in got}) and all(r.id == r.keep_id for r in kept)


def test_repeated_rows_and_clashes(spark):
    rows = [(1, "a", "p", 1), (1, "A", "p", 1), (2, "a", None, 2), (3, "b", "q", 3), (3, "c", "q", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n int").withColumnRenamed("n", "digest")
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text.lower()) for r in kept.collect()) == [(1, "a"), (3, "b"), (3, "c")]
    assert exact_groups(df.limit(0)).count() == 0 and drop_exact_copies(df.limit(0)).count() == 0
    plain = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_exact_copies(plain).collect()) == [1, 3]
    with pytest.raises(ValueError):
        exact_groups(df, keep="first")


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "A", 6), (3, None, 7), (4, "", 8)], "doc_id long, text string, row int").selectExpr("*", "1 as __id", "2 as sha256", "3 as kept", "'x' as `a.b`")
    out = drop_exact_copies(df)
    assert out.columns == df.columns and sorted((r.doc_id, r["a.b"]) for r in out.collect()) == [(1, "x"), (3, "x")]
    again = drop_exact_copies(df.union(df.where("doc_id = 1")))
    assert sorted(r.doc_id for r in again.collect()) == [1, 3]
