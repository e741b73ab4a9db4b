"""Toxicity (operator 5): gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities of a lexicon (words and word beginnings that mark the label, learned from the training rows, besides a
short list of insults), how near hits stand to second-person words, capitals, punctuation, and obfuscation (symbols or
digits inside words; hits that appear once these are undone).  The classifier is fitted on at most ``max_rows`` labelled
rows (those with the smallest hashes of their ids), every text is then scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees
from .carry import with_outputs
from .kernels import U, Index, Words, blocks, counted, raw
from .storage import materialize

SEED_WORDS = "idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown disgusting dumbass imbecile cretin vermin bastard bitch asshole fool jerk retard idiota imbécil estúpido estúpida asqueroso basura tonto abschaum dummkopf arschloch widerlich abruti crétin connard salaud ordure dégoûtant".split()
SECOND = "you your yours yourself u ur du dich dir dein deine deiner deinen sie ihr euch ihre tu te toi ton ta tes vous votre vos tú ti tus usted ustedes su vosotros".split()
#: Kinds of lexicon entry: the whole word, or its first bytes.
PREFIXES = (4, 5, 6)
NEAR = 5
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_NO_LETTER = ~_LETTER
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LEET = np.arange(256, dtype=np.uint8)
for a, b in zip(b"013457@$!|", b"oieastasil"):
    _LEET[a] = b
_DROP = np.zeros(256, bool)
_DROP[list(b"*._-+~'")] = True
_LEETS = np.zeros(256, bool)
_LEETS[list(b"013457@$!|")] = True
FEATURES = ("log_words", "lexicon", "weight", "log_hits", "top_weight", "prefix", "log_prefix", "hidden", "log_hidden", "second", "near_second", "log_near", "capitals", "shouted", "exclaim", "ask", "marks", "repeated_marks", "mixed", "digits")


def _one(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return Words(data, np.array([0, len(data)], np.int64), _NO_LETTER).prefix_hash(np.array([0]), np.array([len(data)]))[0]


def _entries(w: Words) -> list[np.ndarray]:
    """Hash of each word, and of its first bytes for each of PREFIXES (0 where the word is no longer than that)."""
    out = [w.hash]
    for n in PREFIXES:
        long = w.end - w.start > n
        h = np.zeros(len(w.start), np.uint64)
        h[long] = w.prefix_hash(w.start[long], w.start[long] + n) ^ U(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append(h)
    return out


class Lexicon:
    def __init__(self, words: dict[int, float], prefixes: dict[int, float]):
        seeds = {int(_one(s)): 5.0 for s in SEED_WORDS}
        self.word, self.prefix = Index(np.array(list(words | seeds), np.uint64)), Index(np.array(list(prefixes), np.uint64))
        get = seeds | words
        self.weight = np.array([get[int(k)] for k in self.word.keys] + [0.0])
        self.prefix_weight = np.array([prefixes[int(k)] for k in self.prefix.keys] + [0.0])
        self.second = Index(np.array([_one(s) for s in SECOND], np.uint64))


def _undone(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with digits and symbols inside words turned into the letters they stand for, or left out."""
    n = len(data)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = _LETTER[data] | _LEETS[data]
    plain = np.zeros(n + 2, bool)
    plain[1:-1] = _LETTER[data]
    beside = plain[2:] | (plain[:-2] & letter[2:])
    out = np.where(_LEETS[data] & beside, _LEET[data], data)
    keep = ~(_DROP[data] & letter[:-2] & letter[2:] & (plain[:-2] | plain[2:]))
    total = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], total[off]


def features(texts: pa.Array, lex: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts are all zero."""
    data, off = raw(texts)
    n = len(off) - 1
    c = np.zeros((n, 17))
    for first, rows, d, o, _ in blocks(data, off):
        at = slice(first, first + rows)
        w = Words(d, o, _NO_LETTER)
        row, per = w.row, lambda x: np.bincount(w.row, x, rows)
        entry = _entries(w)
        hit = lex.word.find(entry[0])
        weight = lex.weight[hit]
        pre = np.max([lex.prefix_weight[lex.prefix.find(h)] for h in entry[1:]], axis=0) if len(row) else np.zeros(0)
        is_hit, is_pre = hit >= 0, pre > 0
        any_hit = is_hit | is_pre
        you = lex.second.find(entry[0]) >= 0
        pos = np.flatnonzero(you)
        near = np.zeros(len(row), bool)
        if len(pos):
            h = np.flatnonzero(any_hit)
            for side in (np.clip(np.searchsorted(pos, h), 0, len(pos) - 1), np.clip(np.searchsorted(pos, h) - 1, 0, len(pos) - 1)):
                near[h] |= (np.abs(pos[side] - h) <= NEAR) & (row[pos[side]] == row[h])
        c[at, 0] += per(None)
        c[at, 1] += per(is_hit)
        c[at, 2] += per(np.maximum(weight, pre))
        if any_hit.any():
            np.maximum.at(c[:, 3], first + row[any_hit], np.maximum(weight, pre)[any_hit])
        c[at, 4] += per(is_pre)
        c[at, 6] += per(you)
        c[at, 7] += per(near)
        d2, o2 = _undone(d, o)
        w2 = Words(d2, o2, _NO_LETTER)
        c[at, 5] += np.maximum(np.bincount(w2.row, lex.word.find(w2.hash) >= 0, rows) - per(is_hit), 0)
        doc = np.repeat(np.arange(rows), np.diff(o))
        tally = lambda m: np.bincount(doc[m], minlength=rows)
        upper = (d >= 65) & (d <= 90)
        c[at, 8] += tally(upper)
        c[at, 9] += tally(_LETTER[d])
        cum = np.concatenate(([0], np.cumsum(upper)))
        size = w.end - w.start
        c[at, 10] += per((size > 2) & (cum[w.end] - cum[w.start] == size))
        mark = _MARK[d]
        c[at, 11] += tally(d == 33)
        c[at, 12] += tally(d == 63)
        c[at, 13] += tally(mark)
        c[at, 14] += tally(mark & np.concatenate(([False], mark[:-1])))
        digit = (d >= 48) & (d <= 57)
        c[at, 16] += tally(digit)
        letter = _LETTER[d]
        inside = (digit | mark)[1:-1] & letter[:-2] & letter[2:]
        c[at, 15] += tally(np.concatenate(([False], inside, [False])) if len(d) > 2 else np.zeros(len(d), bool))
    words, chars = np.maximum(c[:, 0], 1), np.maximum(np.diff(off), 1)
    return np.stack(
        [np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / words, np.log1p(c[:, 1]), c[:, 3], c[:, 4] / words, np.log1p(c[:, 4]), c[:, 5] / words, np.log1p(c[:, 5]), c[:, 6] / words, c[:, 7] / words, np.log1p(c[:, 7]), c[:, 8] / np.maximum(c[:, 9], 1), c[:, 10] / words, c[:, 11] / chars, c[:, 12] / chars, c[:, 13] / chars, c[:, 14] / chars, c[:, 15] / words, c[:, 16] / chars], 1
    )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, entry, n1, n0): in how many texts of each label an entry occurs."""
    got: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        label = np.array(batch.column(1).to_pylist(), np.int64)
        data, off = raw(batch.column(0))
        for first, rows, d, o, _ in blocks(data, off):
            w = Words(d, o, _NO_LETTER)
            y = label[first : first + rows][w.row]
            salt = (w.row.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93)
            for kind, h in enumerate(_entries(w)):
                _, at = np.unique(h ^ salt, return_index=True)  # once a text
                for v in (0, 1):
                    part = h[at[y[at] == v]]
                    got.setdefault((kind, v), []).append(part[part != 0])
    for kind in range(1 + len(PREFIXES)):
        sides = [counted(np.concatenate(got.get((kind, v), [np.zeros(0, np.uint64)]))) for v in (0, 1)]
        keys = np.unique(np.concatenate((sides[0][0], sides[1][0])))
        n = []
        for k, m in sides:
            x = np.zeros(len(keys), np.int64)
            x[np.searchsorted(keys, k)] = m
            n.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n[1]), pa.array(n[0])], names=["kind", "entry", "n1", "n0"])


class Model:
    def __init__(self, lex: Lexicon, trees: Trees, scale: Isotonic):
        self.lex, self.trees, self.scale = lex, trees, scale

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.scale(self.trees.margin(features(texts, self.lex))) if len(texts) else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: Column | None, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents.  The ids are at most that many and so may be broadcast."""
    one = labels if allowed is None else labels.where(allowed)
    one = one.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("id is not null and label is not null")
    one = one.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    one = one.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(one), "id").select("text", "label", F.xxhash64("id", F.lit(1)).alias("h"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", allowed: Column | None = None, max_rows: int = 40_000, max_lexicon: int = 8192) -> Model:
    """Model of ``label_col`` (> 0 is toxic; of several labels of a document the largest).

    ``allowed``: condition on ``labels`` that training rows fulfil.  Unlabelled rows and null labels aren't used.  Without
    rows of both labels the model gives every text the training rate (0.5 without any rows).  Null texts count as empty;
    texts of any length are read in pieces; a document that comes repeatedly counts as often; other columns are ignored,
    whatever their names.

    The lexicon: entries in at least 3 toxic training documents, whose odds are above e^2 and whose log-likelihood ratio is
    above 30, the best ``max_lexicon`` of them.  Every fourth training row is kept for calibration: neither the lexicon nor
    the trees see it.
    """
    rows = materialize(training_rows(docs, labels, id_col, text_col, label_col, allowed, max_rows), "labelled")
    fitted = rows.where(F.pmod("h", F.lit(4)) != 0)
    n1, n0 = (x or 0 for x in fitted.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    counts = fitted.select("text", "label").mapInArrow(_document_counts, "kind int, entry long, n1 long, n0 long").groupBy("kind", "entry").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    words: dict[int, float] = {}
    prefixes: dict[int, float] = {}
    if n1 and n0:
        rate1, rate0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n0") + 0.5) / (n0 + 1.0)
        odds = F.log(rate1 / rate0)
        all_ = F.col("n1") + F.col("n0")
        share = n1 / (n1 + n0)
        xlogy = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
        g2 = 2 * (xlogy(F.col("n1"), all_ * share) + xlogy(F.col("n0"), all_ * (1 - share)))
        best = counts.where("n1 >= 3").select("kind", "entry", odds.alias("odds"), g2.alias("g2")).where("odds > 2 and g2 > 30").orderBy(F.desc("g2"), "entry").limit(max_lexicon)
        for r in best.collect():
            (words if r.kind == 0 else prefixes)[r.entry & (1 << 64) - 1] = r.odds
    lex = Lexicon(words, prefixes)
    spread = rows.sparkSession.sparkContext.broadcast(lex)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), spread.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "h"])

    table = rows.mapInArrow(dense, "x array<double>, label int, h long").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y, h = np.array(table.column("label").to_pylist(), float), np.array(table.column("h").to_pylist(), np.int64)
    order = np.lexsort((*x.T, h))
    x, y, h = x[order], y[order], h[order]
    hold = h % 4 == 0  # calibration rows: the trees don't see them
    if not (0 < y[hold].sum() < hold.sum() and 0 < y[~hold].sum() < (~hold).sum()):
        hold = np.zeros(len(y), bool)
    trees = Trees().fit(x[~hold], y[~hold])
    use = hold if hold.any() else np.ones(len(y), bool)
    return Model(lex, trees, Isotonic().fit(trees.margin(x[use]), y[use]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``keep`` columns of docs (all by default) with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Every whole text is scored; null counts as empty.  Columns of these names are replaced.  Repeated rows score alike.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]

    def run(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for column in columns:
            p = spread.value.score(column)
            yield [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return with_outputs(docs, text_col, names, {"score": "double", "predicted": "int"}, run)
