import numpy as np

from faultline.llm import language
from faultline.llm.language import Codebook, predict, prototypes

BOOK = Codebook()


def slow_vector(text):
    """The text's vector, n-gram by n-gram."""
    table = language._is_letter()
    words, word = [], []
    for c in text.lower():
        if table[ord(c)]:
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    words += [word] if word else []
    total = np.zeros(BOOK.dim)
    for w in words:
        s = [0, *w, 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            va, vb, vc = BOOK.letters(np.array([a, b, c])).astype(float)
            total += np.roll(va, 2) * np.roll(vb, 1) * vc
    return total


def test_vectors_against_a_loop():
    texts = ["Hello, hello!", "", "3 4 5", "übel—Straße", "a", "日本語 テスト", "x\ny"]
    got, letters = BOOK.bundled(texts, np.arange(len(texts)), len(texts))
    for k, t in enumerate(texts):
        assert np.allclose(got[k], slow_vector(t)), t
    assert letters.tolist()[:3] == [10, 0, 0]


def test_odd_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 40)
    monkeypatch.setattr(language, "CHUNK_CHARS", 90)
    train = [(1, "the cat sat on the mat and then the dog", "en", "x"), (2, "der hund und die katze sind im haus", "de", "x"), (3, None, "en", "x"), (4, "ignored", None, "x")]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string, score string")
    langs, protos = prototypes(df, BOOK)
    assert langs == ["de", "en"]
    assert np.allclose(protos[1], slow_vector(train[0][1]))
    rows = [(1, "then the mat sat " * 30, "de"), (2, None, None), (3, "12 !?", None), (4, "", None), (5, "die katze und der hund " * 40, None), (6, "the", None), (6, "the", None)]
    out = predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").coalesce(1), langs, protos, BOOK)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = out.collect()
    assert [r.lang_pred for r in got] == ["en", "und", "und", "und", "de", "en", "en"]
    for r in got:
        v = slow_vector(r.text or "")
        want = max((v @ p) / np.linalg.norm(v) / np.linalg.norm(p) for p in protos) if v.any() else 0.0
        assert abs(r.score - max(0.0, want)) < 1e-4
    assert {r.lang_pred for r in predict(df, [], np.zeros((0, BOOK.dim)), BOOK).collect()} == {"und"}
    assert prototypes(df.limit(0), BOOK)[0] == [] and predict(df.limit(0), langs, protos, BOOK).count() == 0


def test_held_out_accuracy(spark):
    from faultline.llm.q_language import op3_language_id

    d = "/root/testdata/sf0.01"
    r = op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(r) > 200 and (r.lang == r.lang_pred).mean() > 0.97 and r.score.between(0, 1).all()


def test_memory_of_texts_without_spaces():
    """Peak of one worker on large alphabets: one long text, and many texts with few n-grams in common."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from faultline.llm.language import Codebook, _chunks
rng, b = np.random.default_rng(0), Codebook()
cjk = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9F00, n)))
b.bundled(["warm up"], np.zeros(1, int), 1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for texts in ([cjk(400_000)], [cjk(1500) for _ in range(256)]):
    pieces = list(_chunks(texts))
    for at, part in pieces:
        b.bundled(part, np.arange(len(part)), len(part))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    peak = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert peak < 400


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "the cat", 5)], "doc_id long, text string, row int").selectExpr("*", "1 as __text", "2 as o0", "'x' as `a.b`")
    langs, protos = prototypes(df.withColumn("lang", df.doc_id.cast("string")), BOOK)
    out = predict(df, langs, protos, BOOK)
    assert out.columns == [*df.columns, "lang_pred", "score"] and out.first().lang_pred == "1"
