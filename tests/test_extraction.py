"""The extraction stage: how its rows are spread and batched."""

import random

from pyspark.sql import functions as F

from faultline.parse.tokens import tokenize
from faultline.sources import extraction


def test_files_of_one_task_are_spread(spark):
    """A table that one task reads is parsed by many, and rows go on in batches."""
    one = spark.range(0, 400, 1, 1).select(F.format_string("/s%d.ts", "id").alias("path"), F.format_string("function f%d() { throw new E(); }", "id").alias("content"), F.lit("h").alias("content_hash"))
    rows = extraction.extractions(one).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 4
    assert sorted((r.path, r.functions[0].name, r.throws[0].name) for r in rows) == sorted((f"/s{k}.ts", f"f{k}", "E") for k in range(400))


def test_small_batches_give_all_rows(spark, monkeypatch):
    files = spark.createDataFrame([(f"/s{k}.ts", None if k % 7 == 0 else "f(" if k % 7 == 1 else f"function f{k}() {{}}", "h") for k in range(50)], "path string, content string, content_hash string")
    whole = sorted(map(repr, extraction.extractions(files).collect()))
    monkeypatch.setattr(extraction, "FILES", 3)
    monkeypatch.setattr(extraction, "CHARACTERS", 20)
    assert sorted(map(repr, extraction.extractions(files).collect())) == whole and len(whole) == 50


def test_plain_tokens_are_those_of_the_other_rules(monkeypatch):
    """Tokens taken by the quick rule are the same as without it."""
    import re

    from faultline.parse import tokens

    pieces = ["a", "b1", "$x", "é", "\\u0061", "‍", "\\", " ", "\n", "\r\n", " ", "//c\n", "/*x*/", "`", "${", "}", "{", "(", ")", "[", ";", ",", ":", "?.", "@", "#p", "1.5", "'s'", "/re/g", "=>", "...", "return"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(5000)]

    def run(s):
        try:
            return tokenize(s)
        except tokens.SourceError as e:
            return str(e)

    quick = [run(s) for s in texts]
    monkeypatch.setattr(tokens, "_PLAIN", re.compile(r"(?!)"))
    assert quick == [run(s) for s in texts]
