import random

import pytest

from faultline.llm import near_dup
from faultline.llm.near_dup import banding, drop_near_copies, near_duplicates


def grams(text, n=3):
    w = bytes((text or "").encode().lower()).split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold):
    """Class of each id by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and both / len(sets[x] | sets[y]) >= threshold:
                join(rows[x][0], rows[y][0])
    return {i: find(i) for i, _ in rows}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, header = [], "the shared first line of many pages here"
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        rows.append((len(rows), " ".join(base)))
        if i % 3 == 0:
            for _ in range(rng.randint(1, 6)):
                copy = [rng.choice(vocab) if rng.random() < 0.04 else w for w in base]
                rows.append((len(rows), " ".join(copy)))
        if i % 4 == 0:
            rows.append((len(rows), header + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 20)))))
        if i % 10 == 0:
            rows += [(len(rows) + k, " ".join(base).upper()) for k in range(5)]
    return rows


def test_banding():
    for t, r in ((0.5, 0.95), (0.8, 0.99), (0.7, 0.9)):
        b, rows = banding(t, r)
        assert 1 - (1 - t**rows) ** b >= r > 1 - (1 - t**rows) ** (b - 1)
    with pytest.raises(ValueError):
        banding(1.0, 0.5)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    classes, links = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999, every_link=True)
    got = {r.id: r.class_id for r in classes.collect()}
    assert got == brute(rows, 0.5)
    sets = dict((i, grams(t)) for i, t in rows)
    for r in links.collect():
        assert r.a != r.b and abs(r.jaccard - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 1e-12 and r.jaccard >= 0.5


def test_blocks_within_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(25):  # several groups that meet in the same buckets without being linked through the least member
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(40)] = f"x{rng.randrange(30)}"
        rows.append((100 - i, " ".join(w)))
    classes, _ = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999)
    assert {r.id: r.class_id for r in classes.collect()} == brute(rows, 0.5)


def test_odd_rows(spark, monkeypatch):
    long = " ".join(f"q{i}" for i in range(60_000))
    rows = [(5, None, "a"), (4, "", None), (3, "one", "a"), (2, "One", "a"), (None, "one", "a"), (9, long, "a"), (8, long + " tail", "a"), (8, long + " tail", "a"), (7, " \n\t", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").selectExpr("*", "doc_id as id", "'x' as class_id", "0 as a")
    classes, _ = near_duplicates(df)
    got = sorted(((r.id, r.class_id, r.n_links) for r in classes.collect()), key=str)
    assert got == sorted([(5, 5, 0), (4, 4, 0), (3, 2, 0), (2, 2, 0), (None, None, 0), (9, 8, 1), (8, 8, 1), (8, 8, 1), (7, 7, 0)], key=str)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, 4, 2, None, 8, 8, 7], key=str)
    classes, links = near_duplicates(df.limit(0))
    assert classes.count() == links.count() == 0


def test_all_links_within_components(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(vocab) if rng.random() < 0.04 else w for w in base)) for i in range(80)]
    sets = [grams(t) for _, t in rows]
    want = {(a, b) for b in range(80) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes, links = near_duplicates(df, recall=0.9999, every_link=True)
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 2000
    counts = {i: sum(i in p for p in want) for i in range(80)}
    assert {r.id: r.n_links for r in classes.collect()} == counts
    classes, links = near_duplicates(df, recall=0.9999)  # counts are whole although few links leave a block
    assert {(r.id, r.class_id): r.n_links for r in classes.collect()} == {(i, 0): n for i, n in counts.items()}
    assert links.count() < 80 * 7 and {(r.a, r.b) for r in links.collect()} <= want


def test_each_text_of_an_id_is_linked(spark):
    one, two = [" ".join(f"{c}{i}" for i in range(100)) for c in "xy"]
    rows = [(1, one), (1, two), (2, one + " tail"), (3, two + " tail")]
    classes, links = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999, every_link=True)
    assert sorted((r.a, r.b) for r in links.collect()) == [(1, 2), (1, 3)]
    assert {(r.id, r.class_id) for r in classes.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_ids_with_two_texts_each_with_a_copy(spark):
    rng = random.Random(3)
    text = lambda: [rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(60)]
    rows = []
    for i in range(100):
        for k in (1, 2):
            w = text()
            rows += [(i, " ".join(w)), (1000 * k + i, " ".join(w[:-2] + ["x"]))]
    classes, links = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999, every_link=True)
    assert {(r.a, r.b) for r in links.collect()} == {(i, 1000 * k + i) for i in range(100) for k in (1, 2)}
    got = {r.id: (r.class_id, r.n_links) for r in classes.collect()}
    assert all(got[i] == (i, 2) and got[1000 + i] == got[2000 + i] == (i, 1) for i in range(100))


def test_chains_are_compared_by_bucket(spark, monkeypatch):
    """Texts that share a passage with the next ones only: buckets chain them, few of them are alike."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 60])) for i in range(250)]
    rows += [(1000 + i, t + " end") for i, t in rows[::5]]
    got = {}
    for size in (4, 10**6):
        monkeypatch.setattr(near_dup, "BLOCK_ROWS", size)
        classes, links = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), every_link=True, sigmas=None)
        got[size] = {(r.a, r.b, round(r.jaccard, 9)) for r in links.collect()}, {(r.id, r.class_id, r.n_links) for r in classes.collect()}
    assert got[4] == got[10**6] and len(got[4][0]) > 200


def test_recall_at_the_threshold(spark):
    """At the query's own setting, links of texts just above the threshold: recall of at least 0.93."""
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(400):
        w = [str(rng.randrange(10**9)) for _ in range(90)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:60] + [str(rng.randrange(10**9)) for _ in range(28)]))]
        a, b = grams(rows[-2][1]), grams(rows[-1][1])
        if len(a & b) / len(a | b) >= 0.48:
            want.add(2 * i)
    _, links = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.48, recall=0.95)
    assert len({r.a for r in links.collect()} & want) >= 0.93 * len(want) > 300


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d e", 6)], "doc_id long, text string, row int").selectExpr("*", "1 as id", "2 as __gone", "3 as t", "'s' as sig")
    assert drop_near_copies(df).columns == df.columns and [r.doc_id for r in drop_near_copies(df).collect()] == [1]
