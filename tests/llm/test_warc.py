import gzip
import hashlib
import io

import pytest

from faultline.llm import warc
from faultline.llm.storage import new_path


def member(payload, page_id=1, refers=None):
    out = io.BytesIO()
    warc.write_record(out, page_id, "http://a/b c\r\nx", hashlib.sha256(payload).hexdigest(), len(payload), None if refers else memoryview(payload), refers)
    return out.getvalue()


@pytest.mark.parametrize("size", [0, 1, 99, 1000, 1001, 70_000, 3_000_000])
def test_chunks_of_a_record(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    rows = list(warc.read_chunks(io.BytesIO(member(b"before") + member(payload, 5) + member(b"after")), 1000))
    mine = [r for r in rows if r["page_id"] == 5]
    assert b"".join(r["data"] for r in mine) == payload and [r["chunk_no"] for r in mine] == list(range(len(mine)))
    assert all(len(r["data"]) == 1000 for r in mine[:-1]) and [r["last"] for r in mine] == [False] * (len(mine) - 1) + [True]
    at = 0
    for r in mine:
        at += len(r["data"])
        assert r["bytes_so_far"] == at and r["sha256_so_far"] == hashlib.sha256(payload[:at]).hexdigest()


def test_very_long_header():
    out = io.BytesIO()
    url = "http://a/" + "é" * 600_000
    warc.write_record(out, 3, url, hashlib.sha256(b"page").hexdigest(), 4, memoryview(b"page"), None)
    (r,) = warc.read_chunks(io.BytesIO(out.getvalue() + member(b"next")[:0]))
    assert r["uri"] == url and r["data"] == b"page" and r["page_id"] == 3


def test_damage_is_seen():
    good = member(b"x" * 5000)
    with pytest.raises(ValueError):
        list(warc.read_chunks(io.BytesIO(good[: len(good) // 2])))
    plain = gzip.decompress(good).replace(b"xxxx", b"xxyx", 1)
    with pytest.raises(ValueError):
        list(warc.read_chunks(io.BytesIO(gzip.compress(plain))))
    assert list(warc.read_chunks(io.BytesIO(b""))) == []


def test_plain_headers():
    text = gzip.decompress(member(b"hello", 3)).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "WARC-Target-URI: http://a/b%20c%0D%0Ax\r\n" in text and text.endswith("hello\r\n\r\n")
    r = next(warc.read_chunks(io.BytesIO(member(b"hello", 4, 3))))
    assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) == ("revisit", "3", 5, hashlib.sha256(b"hello").hexdigest())


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_FILE", 2000)
    big = "é" * 400_000
    same = "same " * 30
    rows = [(1, "u", same, "k"), (2, None, same, "k"), (3, "", "short", "k"), (4, "u", "short", None), (5, "u", None, None), (None, "u", same, "k"), (7, "u", big, "k"), (6, "u", big, "k"), (2, "u", same, "k"), (1, "u", same, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = new_path(spark, "warc")
    files = warc.write(warc.with_revisits(df), folder)
    assert files.count() >= 3
    table = warc.read(spark, files, folder, chunk_bytes=100_000).collect()
    got = []
    for r in table:
        if r.last and r.record_type == "response":
            chunks = sorted((x for x in table if x.record_id == r.record_id and x.page_id == r.page_id and x.record_type == "response"), key=lambda x: x.chunk_no)
            if r.page_id in (6,):
                assert b"".join(bytes(x.data) for x in chunks).decode() == big and len(chunks) == 8
        if r.last:
            got.append((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    want = []
    for i, _, html, _ in rows:
        b = (html or "").encode()
        first = {same: 1, big: 6}.get(html)
        again = first is not None and i is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first) if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = warc.write(warc.with_revisits(df.limit(0)), folder)
    assert warc.read(spark, empty, folder).count() == 0
