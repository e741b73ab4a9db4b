import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import bpe

SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
ENC = bpe.Encoder(bpe.Vocabulary(SPEC))
REF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
HARD = [
    "", " ", "\n\n  x", "don't we'll I'M 's", "a" * 3000, "naïve Ünïcode — “quotes” 日本語 🙂🙂👩‍👩‍👧", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x\x1cy\x85z  　w", "  lead", "trail  ", "\t\ttabs\r\n", "1234567890 12a3", "\u0000�퟿", "ab" * 500 + " " + "z" * 40,
]


def ids(text):
    return np.concatenate([part for _, part in ENC.encode([text])]).tolist()


@pytest.mark.parametrize("text", HARD)
def test_as_the_library(text):
    assert ids(text) == REF.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'ste<|>dofx")), max_size=80))
def test_any_text(text):
    want = REF.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert ENC.v.decode(want) == REF.decode(want, skip_special_tokens=False) == text


def test_pieces_do_not_matter(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["the ", "of  ", "é", "\n", "x1 ", " ,", "word "]) for _ in range(4000))
    whole = ids(text)
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "CACHED", 20)
    assert ids(text) == whole == REF.encode(text, add_special_tokens=False).ids


def test_frames(spark):
    rows = [(1, "Hello there", "k"), (2, None, "k"), (2, "", None), (None, "Hello there", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, outputs=tuple(bpe.OUTPUTS)).collect()
    assert sorted(out[0].asDict()) == sorted(["doc_id", "text", *bpe.OUTPUTS])
    for r, (i, text, _) in zip(out, rows):
        want = REF.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, list(r.ids), r.n_tokens, r.decoded) == (i, want, len(want), text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0)).count() == 0
    back = bpe.decode(spark.createDataFrame([([15496, 612],), (None,), ([],), ([999999, None],)], "ids array<int>"))
    assert [r.decoded for r in back.collect()] == [REF.decode([15496, 612], skip_special_tokens=False), None, "", ""]


def test_op10_against_the_library(spark, sf_dir):
    from faultline.llm.q_bpe import op10_bpe

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op10_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        want = REF.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(REF.decode(want, skip_special_tokens=False).encode()).hexdigest()
