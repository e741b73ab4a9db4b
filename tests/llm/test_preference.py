import random

from faultline.llm.preference import examples, paired, segments


def brute(chosen, rejected):
    """(prompt, chosen, rejected, spans of each) of a pair of [(role, text)]."""
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda r, t: f"<|{r or ''}|>\n{t or ''}<|end|>\n"

    def side(turns):
        out, spans = "", []
        for r, t in turns:
            s = show(r, t)
            if r == "assistant":
                spans.append((len(out) + len(f"<|{r}|>\n"), len(out) + len(s)))
            out += s
        return out, spans

    return ("".join(show(*t) for t in chosen[:n]), *side(chosen[n:]), *side(rejected[n:]))


def test_against_brute_force(spark):
    rng = random.Random(2)
    pairs = {}
    for c in range(60):
        base = [(rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "", None, "é🙂", "long " * 50])) for _ in range(rng.randint(0, 7))]
        other = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b"])) for _ in range(rng.randint(0, 3))]
        pairs[c] = (base, other)
    rows = lambda k: [(c, i, r, t, "z") for c, p in pairs.items() for i, (r, t) in enumerate(p[k])] + [(None, 0, "user", "x", "z"), (3, None, "user", "x", "z")]
    frame = lambda k: spark.createDataFrame(rows(k), "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in examples(segments(frame(0), frame(1))).collect()}
    plain = lambda p: [(r or "", t or "") for r, t in p]
    for c, (a, b) in pairs.items():
        if not a and not b:
            assert c not in got
            continue
        r = got[c]
        assert (r.prompt, r.chosen, [tuple(s) for s in r.chosen_spans], r.rejected, [tuple(s) for s in r.rejected_spans]) == brute(plain(a), plain(b))


def test_repeated_turns_and_empty(spark):
    kind = "conv_id long, turn int, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, 5, "user", "alone")], kind)
    b = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "c")], kind)
    got = sorted((r.conv_id, r.part, r.turn, r.k, r.rendered.split("\n")[1][:-7]) for r in segments(a, b).collect())
    assert got == [(1, "chosen", 1, 2, "b"), (1, "prompt", 0, 1, "q"), (1, "prompt", 1, 1, "a"), (1, "rejected", 1, 2, "c"), (2, "chosen", 5, 1, "alone")]
    assert segments(a.limit(0), b.limit(0)).count() == 0 and examples(segments(a.limit(0), b.limit(0))).count() == 0


def test_completions_stand_side_by_side(spark):
    kind = "conv_id long, turn int, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more")], kind)
    b = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad")], kind)
    got = [(r.turn, r.part, r.chosen and r.chosen.rendered[r.chosen.mask_from :], r.rejected and r.rejected.rendered[r.rejected.mask_from :]) for r in paired(a, b).orderBy("turn").collect()]
    assert got == [(0, "prompt", "", None), (1, "completion", "good<|end|>\n", "bad<|end|>\n"), (2, "completion", "", None)]


def test_query_against_sql(spark):
    import duckdb

    from faultline.llm.q_preference import ORACLE, op6_preference

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    got, want = op6_preference(spark, d), con.execute(ORACLE["op6_preference"])
    names = sorted(got.columns)
    assert names == sorted(c[0] for c in want.description)
    rows = want.fetchdf()[names].astype(object).where(lambda x: x.notna(), None)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    norm = lambda t: tuple(int(x) if isinstance(x, float) else x for x in t)
    assert sorted((norm(t) for t in rows.itertuples(index=False, name=None)), key=key) == sorted((tuple(r) for r in got.select(names).collect()), key=key)
