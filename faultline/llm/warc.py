"""WARC archives as a chunked record table (operator 4).

Writing: every task streams its rows into gzipped WARC/1.1 files, one gzip member a record; payloads go through in slices.
File names carry a random part, and only the files that a finished task reports are read, so lost or repeated tasks leave
nothing behind that counts.  Reading: a file is inflated piece by piece; a payload of any size becomes rows of record
identifier, chunk number, bytes, and the SHA-256 of all its bytes so far, and is never held whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, new_path, open_fs

PIECE = 1 << 16
MAX_FILE = 256 << 20
LEAST_SHARED = 100
_SPACE = uuid.UUID("6f1a2c9e-4b7d-5e30-9c11-0d2f8a7b6c54")
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, page_id long, record_type string, refers_to string, uri string, payload_digest string, payload_bytes long, chunk_no int, data binary, bytes_so_far long, sha256_so_far string, last boolean"


def record_id(page_id: int | None) -> str:
    """Identifier of a page's record; the same page always has the same one, rows without id have random ones."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(_SPACE, str(page_id))}>"


def _clean(value: str) -> str:
    """Header text on one line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def write_record(out: BinaryIO, page_id: int | None, uri: str | None, digest: str, size: int, payload: memoryview | None, refers_to: int | None, level: int = 3) -> int:
    """One gzip member; returns its bytes.  Without payload it is a revisit of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_clean(uri or 'about:blank')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(http) + (size if payload is not None else 0)}")
    z, total = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    total += out.write(z.compress(("\r\n".join(head) + "\r\n\r\n").encode() + http))
    for s in range(0, size if payload is not None else 0, 1 << 20):
        total += out.write(z.compress(payload[s : s + (1 << 20)]))
    return total + out.write(z.compress(b"\r\n\r\n") + z.flush())


#: A header (with its URL) is held whole; one beyond this is taken for a damaged file.
MOST_HEADER = 1 << 28


class _Inflated:
    """Bytes of a gzipped file of many members, in pieces of bounded size."""

    def __init__(self, source: BinaryIO):
        self.source, self.z, self.rest, self.buffer, self.over = source, zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        while not self.over:
            if not self.rest:
                self.rest = self.source.read(PIECE)
                if not self.rest:
                    self.over = True
                    break
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            data = self.z.decompress(self.rest, PIECE)
            self.rest = self.z.unconsumed_tail if not self.z.eof else self.z.unused_data
            if data:
                self.buffer += data
                return True
        return False

    def until(self, mark: bytes, most: int = MOST_HEADER) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if len(self.buffer) > most:
                raise ValueError("a WARC header has no end")
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("a WARC file ends within a record")
                return None
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("a WARC file ends within a record")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def read_chunks(source: BinaryIO, chunk_bytes: int = 1 << 20, with_data: bool = True) -> Iterator[dict]:
    """Rows of CHUNKS of a file.  Each record has a row at least; a payload that disagrees with its digest raises."""
    f = _Inflated(source)
    while True:
        head = f.until(b"\r\n\r\n")
        while head is not None and not head.strip():
            head = f.until(b"\r\n\r\n")
        if head is None:
            return
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError("no WARC record")
        h = _headers(head.lstrip())
        length = int(h["content-length"])
        http, size, whole = {}, 0, length
        if h.get("content-type", "").startswith("application/http"):
            start = f.until(b"\r\n\r\n")
            http, whole = _headers(start), length - len(start)
        kind = h.get("warc-type", "")
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
        base = {"record_id": h.get("warc-record-id"), "page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "record_type": kind, "refers_to": h.get("x-refers-to-page") or h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "payload_digest": digest or None, "payload_bytes": int(http["content-length"]) if "content-length" in http else whole}
        sha, no, held = hashlib.sha256(), 0, []
        filled = 0
        for part in f.take(whole):
            while part:
                piece, part = part[: chunk_bytes - filled], part[chunk_bytes - filled :]
                sha.update(piece)
                size, filled = size + len(piece), filled + len(piece)
                if with_data:
                    held.append(piece)
                if filled == chunk_bytes and size < whole:
                    yield base | {"chunk_no": no, "data": b"".join(held) if with_data else None, "bytes_so_far": size, "sha256_so_far": sha.hexdigest(), "last": False}
                    no, held, filled = no + 1, [], 0
        if kind == "response" and digest and sha.hexdigest() != digest:
            raise ValueError(f"{base['record_id']}: the payload isn't the one that was written")
        yield base | {"chunk_no": no, "data": b"".join(held) if with_data else None, "bytes_so_far": size, "sha256_so_far": sha.hexdigest(), "last": True}


def with_revisits(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """``page_id, uri, digest, bytes, refers_to, payload`` (null payload for revisits), a row for each row of pages.

    Of equal payloads of at least ``least`` bytes the row with the smallest id is the response, the others revisit it;
    rows that share that id are all responses, and so are rows with a null id and shorter payloads.  Null payload is empty.
    """
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{uri_col}`").alias("uri"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    narrow = base.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("most > refers_to").select("digest", "refers_to")
    again = narrow.join(groups, "digest").where("page_id != refers_to").distinct().toDF("d", "i", "refers_to")
    rows = base.join(again, (base.page_id == again.i) & (base.digest == again.d), "left")
    return rows.select("page_id", "uri", "digest", "bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))


def write(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows of ``with_revisits``; returns the table of files (path, records, bytes) that hold them."""
    where = folder or new_path(rows.sparkSession, "warc")
    fs, root = open_fs(where)
    fs.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(where)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            ids, uris, digests, sizes, refers = (batch.column(k).to_pylist() for k in range(5))
            payload = batch.column(5)
            for k in range(batch.num_rows):
                if out is None or size > MAX_FILE:
                    if out is not None:
                        out.close()
                        done.append((name, records, size))
                    name, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                body = payload[k]
                size += write_record(out, ids[k], uris[k], digests[k], sizes[k], memoryview(body.as_buffer()) if body.is_valid else None, refers[k])
                records += 1
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return materialize(rows.select("page_id", "uri", "digest", "bytes", "refers_to", "payload").mapInArrow(run, "path string, records long, bytes long"), "files")


def read(spark: SparkSession, files: DataFrame, folder: str, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """The chunk table of the files (column ``path``; ``folder``: URI of any folder in their file system), a task a file.
    Without ``with_data`` the bytes are read and digested but not returned."""
    kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha256_so_far", pa.string()), ("last", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for r in read_chunks(f, chunk_bytes, with_data):
                        rows.append(r)
                        size += 500 + len(r["data"] or b"")
                        if size > 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, CHUNKS)
