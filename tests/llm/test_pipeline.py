import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import toxicity
from faultline.llm.mixing import plan_mix
from faultline.llm.storage import materialize

from .test_near_dup import brute


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "bpe"]
    for s in steps[1:-1]:
        assert s.columns == steps[0].columns


def test_toxicity(spark, sf_dir, steps):
    model = toxicity.fit(steps[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in toxicity.score(steps[0], model).where("score < 0.3").collect()}
    assert {i for i, _ in rows(steps[1])} == good


def test_exact(steps):
    first = {}
    for i, t in rows(steps[1]):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        first[k] = min(i, first.get(k, i))
    assert [i for i, _ in rows(steps[2])] == sorted(first.values(), key=str)


def test_near(steps):
    classes = brute(rows(steps[2]), 0.5)
    kept = {i for i, _ in rows(steps[3])}
    exact = {i for i, c in classes.items() if i == c}
    # MinHash finds a pair at the threshold with a probability of 0.95
    assert exact <= kept and len(kept - exact) <= max(1, len(classes) // 100)


def test_mix(steps):
    n = {}
    for i, _ in rows(steps[4]):
        n[i] = n.get(i, 0) + 1
    for r in plan_mix(steps[3]).collect():
        assert n.get(r.id, 0) == r.whole + (2 * r.part >= max(1, r["size"]))


def test_bpe_and_run(spark, sf_dir, steps):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(x := ref.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(ref.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t in rows(steps[4]))
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in steps[5].collect()) == want
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_odd_rows_at_every_stage(spark, sf_dir):
    """Nulls in any column, empty and repeated rows, clashing names; and an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, id int"
    odd = [(1, "one two three four five", "en", "s", 23, 0.5, "r", 1), (1, "one two three four five", "en", "s", 23, 0.5, "r", 1), (2, None, None, None, None, None, None, None), (3, "", "en", None, 0, 0.1, "q", 2), (None, "no id at all here", "de", "t", 4, 0.2, "p", 3), (4, "ONE two three four five", None, "s", 23, 0.9, "o", 4), (5, "x" * 200_000, "en", "s", 9, 0.3, "n", 5)]
    docs = spark.createDataFrame(odd, kind)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"odd-{name}")
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
        if name != "bpe":
            assert docs.columns == [x.split()[0] for x in kind.split(", ")]
            assert all(r.score == dict((o[0], o[5]) for o in odd)[r.doc_id] for r in docs.collect())
    assert kept["toxicity"] == sorted([r[0] for r in odd], key=str) and kept["exact_dedup"] == kept["ngram_jaccard"] == sorted([1, 2, 5, None], key=str)
    assert set(kept["mixing"]) == set(kept["bpe"]) <= {1, 5, None} and kept["bpe"]
    empty = spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf_dir), f"empty-{name}")
        assert empty.count() == 0
