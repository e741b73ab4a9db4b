"""Doc comments, positions and expression texts against plain Python models."""

import random

from pyspark.sql import functions as F

from faultline.functions import docs, text


def declared(spark, comments):
    rows = spark.createDataFrame(list(enumerate(comments)), "k int, c string").select("k", docs.declarations(F.col("c")).alias("d")).orderBy("k").collect()
    return [None if r.d is None else [tuple(x) for x in r.d] for r in rows]


def test_declarations(spark):
    got = declared(spark, [
        "/** @throws {Failure} */", "/** @throws {Failure} When it fails */", "/** @throws {Db} from db.ts:query */", "/** @throws {Db} Lost link from db.ts:query */",
        "/** @throws {A | Db} from service.ts:save */", "/** @throws {A} when reading from disk */", "/**\n * text\n * @throws Plain some words\r\n * @throws {Open\n * @throws {| B |} x\n */",
        "/** nothing */", None, "/** @throws */", "/** @throws {A} from : from x.ts: from a:b:c d */", "// @throws {A}", "/** @throws {é} ü **/",
    ])
    assert got == [
        [("Failure", None, None, None)], [("Failure", "When it fails", None, None)], [("Db", None, "db.ts", "query")], [("Db", "Lost link", "db.ts", "query")],
        [("A", None, "service.ts", "save"), ("Db", None, "service.ts", "save")], [("A", "when reading from disk", None, None)], [("Plain", "some words", None, None), ("B", "x", None, None)],
        [], None, [("*/", None, None, None)], [("A", "from : from x.ts:", "a:b", "c")], [("A", None, None, None)], [("é", "ü", None, None)],
    ]


def model_origin(t):
    """First ``from `` whose next word holds a colon inside."""
    at = -1
    while (at := t.find("from ", at + 1)) >= 0:
        word = (t[at + 5 :].split() or [""])[0]
        c = word.rfind(":")
        if 0 < c < len(word) - 1:
            return (t[:at].strip() or None, word[:c], word[c + 1 :])
    return (t or None, None, None)


def test_origin_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["from ", "from", " ", "a", "b.ts", ":", ":f", "x y", "\t"]) for _ in range(rng.randint(0, 9))).strip() for _ in range(400)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", docs.origin(F.col("t")).alias("o")).orderBy("k").collect()
    assert [tuple(r.o) for r in got] == [model_origin(t) for t in texts]


def test_positions_are_bytes(spark):
    t = "aé\n日本x\r\n\nz"
    at = [0, 1, 3, 4, 7, 10, 11, 12, 13, 14]
    rows = spark.createDataFrame([(t, a) for a in at], "t string, a int").select("a", text.line_of(F.col("t"), F.col("a")).alias("l"), text.column_of(F.col("t"), F.col("a")).alias("c")).orderBy("a").collect()
    for r in rows:
        head = t.encode()[: r.a].decode()
        assert (r.l, r.c) == (head.count("\n") + 1, len(head.split("\n")[-1]) + 1)


def test_preceding_doc_and_thrown_text(spark):
    cases = ["/** a */\n", "/** a */ x\n", "/* a */\n", "/** b */ /** c\n */  ", "", "// x\n"]
    df = spark.createDataFrame([(k, c + "f()", len(c.encode())) for k, c in enumerate(cases)], "k int, t string, a int")
    assert [r[0] for r in df.orderBy("k").select(text.preceding_doc(F.col("t"), F.col("a"))).collect()] == ["/** a */", None, None, "/** c\n */", None, None]
    texts = ["throw new A('x');", "throw new a.B()", "throw makeError(1)", "throw make(1)", "throw e", "throw f;", "throw new A<T>()", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.thrown_text(F.col("t"), F.array(F.lit("e"))).alias("r"))
    assert [tuple(r.r) for r in df.orderBy("k").collect()] == [("named", "A"), ("unknown", None), ("named", "makeError"), ("unknown", None), ("rethrow", "e"), ("unknown", None), ("named", "A"), ("unknown", None)]
