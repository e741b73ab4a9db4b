"""BPE encoding and decoding (operator 10): contiguous rank arrays.

A word is one row of a small matrix: its parts, side by side, and the ranks of adjacent parts.  The rank row is scanned
for its minimum (leftmost of equals), that boundary is deleted, and only the two neighbouring ranks are looked up again,
until no adjacent pair has a rank.  Words of one length are handled together, so each scan is one vector operation over
all of them.  Long words, where scanning would be quadratic, use a heap over the same ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .carry import with_outputs

_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A word always begins at a space between a non-space and a letter, so long texts can be cut there.
_CUT = regex.compile(rf"(?<=[^{_S}]) (?=\p{{L}})")
_BIG = np.int32(1 << 30)
PIECE, SHORT, CACHED = 1 << 20, 24, 200_000
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ranks, ids and bytes of a byte-level BPE file of the tokenizers library (about 50,000 pairs: a bounded size)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], _byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
            raise ValueError("not a byte-level BPE file")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.base = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.base[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # open addressing: slot -> key, rank, merged id
        self.bits = max(4, int(np.ceil(np.log2(max(2, 4 * len(self.pairs))))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _BIG, np.int32)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.probes = 1
        for (a, b), (rank, to) in self.pairs.items():
            key = a << 32 | b
            slot, n = self._slot(np.array([key]))[0], 1
            while self.key[slot] != -1:
                slot, n = (slot + 1) & ((1 << self.bits) - 1), n + 1
            self.key[slot], self.rank[slot], self.to[slot] = key, rank, to
            self.probes = max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or of none: the rank there is then not below _BIG."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        out = np.full(key.shape, -1, np.int64)
        open_ = np.arange(key.size)
        flat, k, o = slot.ravel(), key.ravel(), out.ravel()
        for _ in range(self.probes):
            s = flat[open_]
            there = self.key[s]
            hit = there == k[open_]
            o[open_[hit]] = s[hit]
            go = ~hit & (there != -1)
            open_ = open_[go]
            if not len(open_):
                break
            flat[open_] = (flat[open_] + 1) & ((1 << self.bits) - 1)
        return o.reshape(key.shape)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self.find(a, b)
        return np.where(slot >= 0, self.rank[slot], _BIG)

    def equal_length(self, words: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of bytes."""
        n, length = words.shape
        ids = self.base[words]
        out: list = [None] * n
        at, size = np.arange(n), length
        rank = self.ranks(ids[:, :-1], ids[:, 1:]) if length > 1 else np.zeros((n, 0), np.int32)
        while len(at):
            if size > 1:
                k = rank.argmin(axis=1)
                done = rank[np.arange(len(at)), k] >= _BIG
            else:
                done = np.ones(len(at), bool)
            if done.any():
                for r, i in zip(ids[done, :size], at[done].tolist()):
                    out[i] = r
                go = ~done
                if not go.any():
                    break
                at, ids, rank, k = at[go], ids[go], rank[go], k[go]
            row = np.arange(len(at))
            merged = self.to[self.find(ids[row, k], ids[row, k + 1])]
            cols = np.arange(size - 1)
            ids = np.take_along_axis(ids, cols + (cols > k[:, None]), 1)  # the boundary goes
            ids[row, k] = merged
            cols = np.arange(size - 2)
            rank = np.take_along_axis(rank, cols + (cols >= k[:, None]), 1)
            size -= 1
            left, right = np.flatnonzero(k > 0), np.flatnonzero(k < size - 1)
            rank[left, k[left] - 1] = self.ranks(ids[left, k[left] - 1], merged[left])
            rank[right, k[right]] = self.ranks(merged[right], ids[right, k[right] + 1])
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        """The same merges with a heap and links, for words too long to scan."""
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = self.pairs[p][1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (q := (ids[a], ids[after[a]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[q][0], a, q))
        return np.array([x for x in ids if x is not None], np.int32)

    def words(self, words: Sequence[str]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        data = [w.encode() for w in words]
        for i, w in enumerate(data):
            if len(w) > SHORT:
                out[i] = self.long_word(w)
            else:
                by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            matrix = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), length)
            for i, ids in zip(at, self.equal_length(matrix)):
                out[i] = ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids; special tokens are kept, bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        get, n = self.bytes_of, len(self.bytes_of)
        return b"".join([get[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")


class Encoder:
    """Encodes texts; remembers the ids of up to ``CACHED`` words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, int] = {}
        self.flat, self.at, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0
        special = sorted(self.v.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _add(self, words: list[str]) -> None:
        for w, ids in zip(words, self.v.words(words)):
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)))
            if self.n + 2 > len(self.at):
                self.at = np.concatenate((self.at, np.zeros(len(self.at), np.int64)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.known[w] = self.n
            self.n += 1
            self.at[self.n] = self.used

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's ids end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.n > CACHED:
            self.known, self.used, self.n = {}, 0, 0
        get = self.known.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            self._add(list(dict.fromkeys(w for w, f in zip(words, found) if f < 0)))
            found = [self.known[w] for w in words]
        at = np.array(found, np.int64)
        start, count = self.at[at], self.at[at + 1] - self.at[at]
        end = np.cumsum(count)
        return self.flat[np.repeat(start - (end - count), count) + np.arange(end[-1])], end

    def _cuts(self, text: str) -> Iterator[str | int]:
        """Parts of a text that are split into words apart: plain strings, and ids of special tokens."""
        s = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text[s : m.start()])
            yield self.v.special[m[0]]
            s = m.end()
        yield from self._plain(text[s:] if s else text)

    def _plain(self, text: str) -> Iterator[str]:
        s = 0
        while len(text) - s > PIECE:
            cut = _CUT.search(text, s + PIECE)
            if not cut:
                break
            yield text[s : cut.start()]
            s = cut.start()
        yield text[s:] if s else text

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids) of parts of the texts, in order; each text has a part at least.  Words of many short
        texts are encoded together, a long text part by part."""
        words: list[str] = []
        parts: list[tuple[int, int | None, int]] = []  # text, special id or None, end within words
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            ids, end = self._ids(words)
            s = 0
            for k, special, last in parts:
                if special is not None:
                    yield k, np.array([special], np.int32)
                    continue
                e = int(end[last - 1]) if last else 0
                yield k, ids[s:e]
                s = e

        for k, text in enumerate(texts):
            for part in self._cuts(text):
                if isinstance(part, int):
                    parts.append((k, part, len(words)))
                    continue
                words += _SPLIT.findall(part)
                parts.append((k, None, len(words)))
                size += len(part)
                if size >= PIECE:
                    yield from flush()
                    words, parts, size = [], [], 0
        yield from flush()


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(spec))
    return _ENCODERS[key]


def encode(docs: DataFrame, text_col: str = "text", outputs: Sequence[str] = ("n_tokens", "ids"), path: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns of docs (all by default) and the named outputs of each whole text.

    ``ids`` as the tokenizers library gives them with add_special_tokens=False (special tokens' strings in a text become
    their ids); ``n_tokens`` their number; ``ids_sha256`` of the ids as little-endian unsigned 32-bit integers;
    ``decoded`` and ``decoded_sha256`` of the text that the ids decode to.  Null text is empty: no ids.  Rows are handled
    one by one (repeated rows give repeated results), in one pass without a shuffle.  Outputs replace columns of the same name.
    """
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"no such output: {sorted(unknown)}")
    with open(path or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    def run(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        e = encoder(spec.value)
        bytes_of = e.v.bytes_of
        for column in columns:
            out: dict[str, list] = {o: [] for o in outputs}
            at, n, ids, back, ids_hash, back_hash = -1, 0, [], [], None, None

            def over() -> None:
                for o, value in (("n_tokens", lambda: n), ("ids_sha256", lambda: ids_hash.hexdigest()), ("decoded_sha256", lambda: back_hash.hexdigest()), ("ids", lambda: np.concatenate(ids)), ("decoded", lambda: b"".join(back).decode())):
                    if o in out:
                        out[o].append(value())

            for k, part in e.encode([t or "" for t in column.to_pylist()]):
                if k != at:
                    if at >= 0:
                        over()
                    at, n, ids, back, ids_hash, back_hash = k, 0, [], [], hashlib.sha256(), hashlib.sha256()
                n += len(part)
                if "ids_sha256" in out:
                    ids_hash.update(part.astype("<u4").tobytes())
                if "ids" in out:
                    ids.append(part)
                if "decoded" in out or "decoded_sha256" in out:  # parts end where characters do
                    text = b"".join([bytes_of[i] for i in part.tolist()]).decode("utf-8", "replace").encode()
                    back_hash.update(text)
                    if "decoded" in out:
                        back.append(text)
            if at >= 0:
                over()
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
            yield [pa.array(out[o], kinds[o]) for o in outputs]

    return with_outputs(docs, text_col, names, {o: OUTPUTS[o] for o in outputs}, run)


def decode(rows: DataFrame, ids_col: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with column ``to``: the text of each array of ids (null: null; unknown and null ids are skipped)."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in rows.columns if c != to]

    def run(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        v = encoder(spec.value).v
        for column in columns:
            yield [pa.array([None if ids is None else v.decode([i for i in ids if i is not None]) for ids in column.to_pylist()], pa.string())]

    return with_outputs(rows, ids_col, names, {to: "string"}, run)
