import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import kernels, toxicity
from faultline.llm.boosting import Isotonic, Trees


def test_trees_learn_interactions():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = Trees().fit(x[:3000], y[:3000])
    assert ((t.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    for n, y0 in ((0, np.zeros(0)), (3, np.zeros(3)), (3, np.ones(3))):
        m = Trees().fit(np.zeros((n, 5)), y0).margin(x[:2])
        assert np.isfinite(m).all()


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(1)
    m = np.round(rng.standard_normal(300), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float)
    f = Isotonic().fit(m, y)
    assert (np.diff(f.y) > 0).all() and (np.diff(f(np.sort(m))) >= -1e-12).all()
    # the greatest convex minorant's slopes, point by point
    order = np.argsort(m, kind="stable")
    best = [max(min(y[order][a : b + 1].mean() for b in range(j, 300)) for a in range(j + 1)) for j in (0, 120, 299)]
    blocks = np.interp(m[order][[0, 299]], f.x, f.y)
    assert blocks[0] == pytest.approx(min(f.y)) and blocks[1] == pytest.approx(max(f.y)) and best[0] <= best[1] <= best[2]
    assert Isotonic().fit(np.zeros(0), np.zeros(0))(np.array([0.0]))[0] == 0.5


def test_features(monkeypatch):
    lex = toxicity.Lexicon({}, {})
    f = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(["You are an idiot, YOU IDIOT!!", None, "i.d.i.o.t 1d10t m0r0n", "fine words"]), lex).T))
    hits = np.expm1(f["log_hits"]).round().tolist()
    assert hits == [2, 0, 0, 0] and np.expm1(f["log_hidden"]).round().tolist() == [0, 0, 3, 0]
    assert np.expm1(f["log_near"]).round().tolist() == [2, 0, 0, 0] and f["capitals"][0] > 0.3 > f["capitals"][3]
    assert all(v[1] == 0 for v in f.values())
    texts = pa.array(["you idiot " * 50, "x", None, "clean text here " * 40])
    whole = toxicity.features(texts, lex)
    blocks = kernels.blocks
    monkeypatch.setattr(toxicity, "blocks", lambda d, o: blocks(d, o, 64))
    assert np.allclose(toxicity.features(texts, lex), whole, atol=0.02)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you are stupid scum" if i % 3 == 0 else f"a fine day {i}", "k") for i in range(60)] + [(100, None, "k"), (None, "idiot", "k"), (5, "a fine day 5", "k"), (101, "idiot " * 200_000, "k")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, None), (None, 1), (5, 0), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 64
    got = {r.doc_id: r for r in out.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[3].predicted == 1 and got[4].predicted == 0 and got[101].predicted == 1
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(docs, toxicity.fit(docs, some)).count() == 64
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from faultline.llm.q_toxicity import op5_toxicity

    d = "/root/testdata/sf0.1"
    r = op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").toPandas()
    # a part of the labels is noise: some texts marked toxic hold nothing toxic
    assert r.predicted[r.toxic == 1].mean() > 0.8 and r.predicted[r.toxic == 0].mean() < 0.02


def test_scores_against_one_tree_at_a_time(spark):
    """The query's scores, from the features on: trees walked row by row, calibration interpolated by hand."""
    docs = spark.createDataFrame([(i, f"you are stupid scum number {i % 7}" if i % 3 == 0 else f"a fine day {i}!" + " SO IT IS" * (i % 5)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 17 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len({round(r.score, 9) for r in got.values()}) > 1 and model.trees.trees
    for i, text in [(r.doc_id, r.text) for r in got.values()]:
        x = toxicity.features(pa.array([text]), model.lex)[0]
        f = model.trees.base
        for feature, cut, value in model.trees.trees:
            k = 0
            while feature[k] >= 0 and k < 7:
                k = 2 * k + (2 if sum(e < x[feature[k]] for e in model.trees.edges[feature[k]]) > cut[k] else 1)
            f += value[k]
        xs, ys = list(model.scale.x), list(model.scale.y)
        if f <= xs[0] or f >= xs[-1]:
            want = ys[0] if f <= xs[0] else ys[-1]
        else:
            b = next(b for b in range(len(xs)) if xs[b] >= f)
            want = ys[b - 1] + (ys[b] - ys[b - 1]) * (f - xs[b - 1]) / (xs[b] - xs[b - 1])
        assert abs(got[i].score - want) < 1e-9


def test_calibration_rows_teach_no_lexicon(spark):
    """A word that only calibration rows hold isn't in the lexicon."""
    from pyspark.sql import functions as F

    ids = spark.range(2000).withColumn("held", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0)
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("held") & (F.col("id") % 2 == 0), "blorp zig").when(F.col("id") % 2 == 0, "snarg zig").otherwise("zig zag").alias("text"))
    model = toxicity.fit(docs, ids.select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("toxic")))
    found = toxicity.features(pa.array(["blorp", "snarg", "zag"]), model.lex)[:, toxicity.FEATURES.index("log_hits")]
    assert found[1] > 0 and found[0] == found[2] == 0
