"""Language identification (operator 3): hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds its letters' vectors, each rotated by its place,
by multiplication; a text's vector bundles those of its n-grams by addition, a language's those of its training texts.
The predicted language is the one whose prototype has the largest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import with_outputs
from .kernels import U, mix

CHUNK_CHARS, CHUNK_TEXTS, PIECE = 400_000, 256, 200_000
BITS = 21  # of a code point
GRAMS = 2048  # n-gram vectors that are held at once
UNKNOWN = "und"
_TABLE: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _TABLE:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _TABLE.append(table)
    return _TABLE[0]


class Codebook:
    """Letter vectors, and n-gram vectors bound from them.  A letter's vector is made from a hash of its code point, so every
    letter of every script has its own and none is stored; 0 is the boundary of a word."""

    def __init__(self, dim: int = 1024, n: int = 3, seed: int = 11):
        if not 1 <= n <= 3 or dim % 64:
            raise ValueError("n is 1 to 3, dim a multiple of 64")
        self.dim, self.n, self.seed = dim, n, seed

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """+1 and -1 of each code point."""
        h = mix(codes.astype(np.uint64)[:, None] * U(0x9E3779B97F4A7C15) + mix(np.arange(1, self.dim // 64 + 1, dtype=np.uint64) + U(self.seed << 20)))
        return (np.unpackbits(h.view(np.uint8), axis=1).astype(np.int8) << 1) - 1

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dim), np.int8)
        for k in range(self.n):  # the last letter isn't rotated
            codes, at = np.unique(grams >> (BITS * k) & ((1 << BITS) - 1), return_inverse=True)
            out *= np.roll(self.letters(codes), k, axis=1)[at]
        return out.astype(np.float32)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-gram, text number) of all n-grams with letters inside, boundaries allowed at the ends; letters of each text."""
        low = [t.lower() for t in texts]
        size = np.array([len(t) + 1 for t in low])
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.where(_is_letter()[code], code, 0)
        text = np.repeat(np.arange(len(texts)), size)
        letters = np.bincount(text[s > 0], minlength=len(texts))
        keep = np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0))) | np.concatenate(([True], text[1:] != text[:-1]))
        s, text = s[keep].astype(np.int64), text[keep]
        # a boundary stands before each text too
        first = np.concatenate(([True], text[1:] != text[:-1]))
        at = np.flatnonzero(first)
        s, text = np.insert(s, at, 0), np.insert(text, at, text[at])
        m = len(s) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
        g = np.zeros(m, np.int64)
        ok = text[:m] == text[self.n - 1 :]
        for k in range(self.n):
            part = s[k : k + m]
            g = g << BITS | part
            if 0 < k < self.n - 1 or self.n == 1:
                ok &= part > 0
        if self.n == 2:
            ok &= (s[:m] > 0) | (s[1:] > 0)
        return g[ok], text[:m][ok], letters

    def bundled(self, texts: list[str], of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the texts' vectors by row, ``of`` being each text's row; letters of each text).

        N-gram vectors are made for GRAMS n-grams at a time.  Where few n-grams are shared, counts are added one by one
        instead of by a matrix of counts.
        """
        g, text, letters = self.grams(texts)
        out = np.zeros((rows, self.dim), np.float32)
        if not len(g):
            return out, letters
        order = np.argsort(g, kind="stable")
        g, row = g[order], of[text[order]]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        for s in range(0, len(first), GRAMS):
            at = first[s : s + GRAMS]
            e = first[s + GRAMS] if s + GRAMS < len(first) else len(g)
            v = self.vectors(g[at])
            place = np.repeat(np.arange(len(at)), np.diff(np.append(at, e)))
            cell, n = np.unique(row[at[0] : e] * len(at) + place, return_counts=True)
            r, k = cell // len(at), cell % len(at)
            if rows * len(at) > 20 * len(cell):
                edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                for i, j in zip(edge, [*edge[1:], len(r)]):
                    out[r[i]] += n[i:j].astype(np.float32) @ v[k[i:j]]
            else:
                c = np.zeros((rows, len(at)), np.float32)
                c[r, k] = n
                out += c @ v
        return out, letters


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, texts) of chunks; long texts come in pieces, next to each other.  A piece ends at a space; in a run of
    more than PIECE characters without one it ends where it is full, and there a word ends."""
    rows: list[int] = []
    out: list[str] = []
    size = 0
    for k, t in enumerate(texts):
        t, s = t or "", 0
        while True:
            e = len(t) if len(t) - s <= PIECE else t.find(" ", s + PIECE, s + 2 * PIECE)
            e = min(len(t), s + 2 * PIECE) if e < 0 else e
            rows.append(k)
            out.append(t[s:e])
            size += e - s
            if size >= CHUNK_CHARS or len(rows) >= CHUNK_TEXTS:
                yield rows, out
                rows, out, size = [], [], 0
            s = e
            if s >= len(t):
                break
    if rows:
        yield rows, out


def prototypes(docs: DataFrame, book: Codebook, text_col: str = "text", lang_col: str = "lang", allowed: Column | None = None, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """(languages, their prototype vectors), bundled over all allowed rows with text and language.

    Rows with a null text or language teach nothing, nor do texts without letters; repeated rows count as often as they
    come; texts of any length are read in pieces.  No rows give no languages.  Other columns are ignored.
    """
    rows = docs if allowed is None else docs.where(allowed)
    rows = rows.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    spread = docs.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, total = spread.value, {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, texts in _chunks(batch.column(0).to_pylist()):
                names = sorted({langs[k] for k in at})
                v, _ = b.bundled(texts, np.array([names.index(langs[k]) for k in at]), len(names))
                for name, v in zip(names, v):
                    total[name] = total.get(name, 0) + v.astype(np.float64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.dim), pa.array(np.arange(b.dim, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))], names=["lang", "dim", "value"])

    parts = rows.select(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string")).mapInArrow(run, "lang string, dim int, value long")
    sums = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    got = sums.limit(max_languages * book.dim + 1).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out = np.zeros((len(langs), book.dim))
    place = {name: k for k, name in enumerate(langs)}
    out[[place[x] for x in got.column("lang").to_pylist()], got.column("dim").to_numpy()] = got.column("value").to_numpy()
    return langs, out


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, book: Codebook, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of docs (all by default) with ``lang_pred`` and ``score``, the cosine (0 to 1; below 0 counts as 0).

    ``und`` and 0 for a text that is null or has no letter, and for every text if no language was learned.  Of equal
    cosines the first language by code point is taken.  Columns of these names are replaced.
    """
    norm = np.linalg.norm(protos, axis=1)
    unit = (protos / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32).T
    spread = docs.sparkSession.sparkContext.broadcast((book, langs, unit))
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def run(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        b, langs_, unit_ = spread.value
        for column in columns:
            n = len(column)
            pred, score = [UNKNOWN] * n, np.zeros(n)
            last, held, letters = -1, np.zeros(b.dim), 0  # of the text under way

            def over() -> None:
                size = np.sqrt(held @ held)
                if letters and langs_ and size > 0:
                    cos = (held @ unit_) / size
                    k = int(cos.argmax())
                    pred[last], score[last] = langs_[k], min(1.0, max(0.0, float(cos[k])))

            for at, texts in _chunks(column.to_pylist()):
                v, seen = b.bundled(texts, np.arange(len(texts)), len(texts))
                if len(set(at)) == len(at) and at[0] != last and len(at) > 1 and langs_:
                    # whole texts, but the last may go on in the next chunk
                    if last >= 0:
                        over()
                    size = np.sqrt(np.einsum("ij,ij->i", v, v))
                    cos = (v @ unit_) / np.where(size > 0, size, 1)[:, None]
                    best = cos.argmax(1)
                    for i, k in enumerate(at[:-1]):
                        if seen[i] and size[i] > 0:
                            pred[k], score[k] = langs_[best[i]], min(1.0, max(0.0, float(cos[i, best[i]])))
                    last, held, letters = at[-1], v[-1].astype(np.float64), int(seen[-1])
                    continue
                for i, k in enumerate(at):
                    if k != last:
                        if last >= 0:
                            over()
                        last, held, letters = k, np.zeros(b.dim), 0
                    held, letters = held + v[i], letters + int(seen[i])
            if last >= 0:
                over()
            yield [pa.array(pred, pa.string()), pa.array(score)]

    return with_outputs(docs, text_col, names, {"lang_pred": "string", "score": "double"}, run)
