"""Approximate nearest neighbours (operator 7): a hash-prefix forest.

Each tree gives every vector a long bit string, the signs of its products with random directions; a tree is the sorted
array of these strings.  A query descends to its longest-prefix match in each tree and then ascends in all trees together,
one bit at a time, until the trees' ranges hold the wanted number of candidates; these are compared exactly.

A tree is cut into parts by leading bits, and a large part into blocks of bounded size, so that no task sees a whole tree
and a hot string is only more blocks.  Two passes: ranges are counted for every level first (strings only), which fixes the
level at which each query stops; then each block scores its part of the ranges.  Queries in sparse regions, whose ranges
within a part hold too few, go on in the same way over shorter parts, at last over whole trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

BITS = 62
INDEX_ROWS, QUERY_ROWS = 8192, 1024


class Forest:
    """Directions of ``trees`` trees; orthogonal within each run of ``dim`` bits."""

    def __init__(self, dim: int, trees: int = 16, seed: int = 3):
        self.dim, self.trees = dim, trees
        rng, parts, have = np.random.default_rng(seed), [], 0
        while have < trees * BITS:
            parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
            have += dim
        self.planes = np.concatenate(parts, 1)[:, : trees * BITS]
        self.weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(vector, tree) -> bit string as an integer."""
        return ((x @ self.planes > 0).reshape(len(x), self.trees, BITS) * self.weights).sum(2)


def wanted(n: int, factor: float = 4.0, power: float = 0.8) -> int:
    """Candidates a query should see: sublinear, half of a small table.  The factor gives a recall of 0.9 and more among
    the nearest 5 even for vectors without any structure in 64 dimensions."""
    return min(n // 2 + 1, math.ceil(factor * n**power))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows with an id and a non-zero vector of finite components, of the commonest length."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _hashed(rows: DataFrame, forest: Forest, bits: int, wire: type | None = None) -> DataFrame:
    """(tree, part, hash, id[, v]): each row once a tree; vectors as floats of type ``wire``, which holds them exactly."""
    spread = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = spread.value
        for big in batches:
            for s in range(0, big.num_rows, 1024):
                batch = big.slice(s, 1024)
                x = _matrix(batch.column(1))
                h = f.strings(x / np.abs(x).max(1, keepdims=True))
                vectors = pa.array([r.tobytes() for r in x.astype(wire)], pa.binary()) if wire else None
                for t in range(f.trees):
                    cols = [pa.array(np.full(len(x), t, np.int32)), pa.array((h[:, t] >> (BITS - bits)).astype(np.int64)), pa.array(h[:, t]), batch.column(0)]
                    if wire:
                        cols.append(vectors)
                    yield pa.RecordBatch.from_arrays(cols, names=["tree", "part", "hash", "id", *(["v"] if wire else [])])

    return rows.mapInArrow(run, "tree int, part long, hash long, id long" + ", v binary" * bool(wire))


def _blocks(index: DataFrame, queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Index rows and queries that meet, by (tree, part, i, j): blocks of at most about INDEX_ROWS x QUERY_ROWS."""
    key = ["tree", "part"]
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    extra = [c for c in queries.columns if c not in index.columns]
    some = [c for c in index.columns if c not in key]
    left = index.join(sizes, key).select(*key, own("ni").alias("i"), all_("nj").alias("j"), F.lit(False).alias("query"), *some, *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra])
    right = queries.join(sizes, key).select(*key, all_("ni").alias("i"), own("nj").alias("j"), F.lit(True).alias("query"), *some, *extra)
    return left.union(right)


def _ranges(hashes: np.ndarray, q: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the sorted ``hashes`` that agree with each of ``q`` in its first ``level`` bits."""
    shift = BITS - level
    low = (q >> shift) << shift
    return np.searchsorted(hashes, low, "left"), np.searchsorted(hashes, low + (np.int64(1) << shift), "left")


def _count(bits: int, top: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, hashes = group[group["query"]], np.sort(group.loc[~group["query"], "hash"].to_numpy())
        h, out = q["hash"].to_numpy(), []
        for level in range(bits, top + 1):
            lo, hi = _ranges(hashes, h, np.full(len(h), level, np.int64))
            some = hi > lo
            if not some.any():
                break
            out.append(pd.DataFrame({"id": q["id"].to_numpy()[some], "level": level, "n": (hi - lo)[some]}))
        return pd.concat(out) if out else pd.DataFrame({"id": np.zeros(0, np.int64), "level": 0, "n": np.zeros(0, np.int64)})

    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with the rows of ``b``, the same for a pair wherever it is computed."""
    dot = lambda x, y: np.add.reduce(x * y, axis=-1)
    sa, sb = np.abs(a).max(), np.abs(b).max(1)  # against overflow
    a, b = a / sa, b / sb[:, None]
    return dot(b, a[None, :]) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def best(a: np.ndarray, ids: np.ndarray, near: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest: (ids, exact cosines).  ``near``: cosines up to rounding, to choose by; ties go to the smaller id."""
    if len(ids) > k:
        least = np.partition(near, len(near) - k)[len(near) - k]
        keep = np.flatnonzero(near >= least - 1e-9)
        ids, vectors = ids[keep], vectors[keep]
    score = exact_cosine(a, vectors)
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def _score(k: int, wire: type):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, r = group[group["query"]], group[~group["query"]].sort_values(["hash", "id"])
        out = []
        if len(q) and len(r):
            mat = lambda g: np.frombuffer(b"".join(g["v"]), wire).reshape(len(g), -1).astype(np.float64)
            hashes, ids, x, y = r["hash"].to_numpy(), r["id"].to_numpy(), mat(r), mat(q)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            lo, hi = _ranges(hashes, q["hash"].to_numpy(), q["stop"].to_numpy().astype(np.int64))
            for s, e, a, i in zip(lo, hi, y, q["id"].to_numpy()):
                at = np.flatnonzero(ids[s:e] != i) + s
                if len(at):
                    found, score = best(a, ids[at], unit[at] @ (a / np.linalg.norm(a)), x[at], k)
                    out.append(pd.DataFrame({"query_id": i, "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, trees: int = 16, candidates: int | None = None, seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query, by cosine on the vectors as given.

    ``is_query``: condition on ``id``.  Candidates are all rows but the query's own.  Rows with a null id, a null or zero
    vector, null or non-finite components, or not of the commonest length (of equals the smallest) take no part.  Rows that
    share an id count as one.  Ties go to the smaller id.  A table of up to ``candidates`` rows, where that is given, is
    searched in full, with one tree.  Other columns are ignored, whatever their names; no usable rows give none.
    """
    rows = usable(vectors, id_col, vec_col)
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = size[0], size[1]
    rows = materialize(rows.where(F.size("v") == dim), "vectors")
    want = min(n, candidates or wanted(n))
    trees = trees if want < n else 1
    forest = Forest(dim, trees, seed)
    wire = np.float32 if vectors.schema[vec_col].dataType.elementType == T.FloatType() else np.float64
    # entries in all ranges together at which the distinct ones are expected to be enough; one tree then holds more than k
    entries = max(-n * math.log(1 - want / n), trees * (k + 1)) if want < n else math.inf
    level = 0 if entries == math.inf else max(0, int(math.floor(math.log2(trees * n / entries))))
    bits = min(16, max(0, level - 1))
    many = lambda c, m: F.greatest(F.ceil(c / F.lit(m)), F.lit(1)).cast("int")
    group = ["tree", "part", "i", "j"]

    def parts(strings: DataFrame, asked: DataFrame) -> DataFrame:
        sizes = strings.groupBy("tree", "part").agg(F.count("*").alias("a")).join(asked.groupBy("tree", "part").agg(F.count("*").alias("b")), ["tree", "part"])
        return materialize(sizes.select("tree", "part", many(F.col("a"), INDEX_ROWS).alias("ni"), many(F.col("b"), QUERY_ROWS).alias("nj")), "parts")

    queries, top, found = rows.where(is_query), BITS, None
    while True:
        strings, asked = _hashed(rows, forest, bits), _hashed(queries, forest, bits)
        sizes = parts(strings, asked)
        if entries == math.inf:
            stops = queries.select("id", F.lit(0).alias("stop")).distinct()
        else:
            seen = _blocks(strings, asked, sizes).groupBy(*group).applyInPandas(_count(bits, top), "id long, level int, n long").groupBy("id", "level").agg(F.sum("n").alias("n"))
            stop = F.max(F.when(F.col("n") >= entries, F.col("level")))
            stops = seen.groupBy("id").agg((stop if bits else F.coalesce(stop, F.lit(0))).alias("stop"))
        stops = materialize(stops, "stops")
        open_ = stops.where("stop is null")
        more = bits > 0 and open_.limit(1).count() > 0
        if more:
            stops = stops.where("stop is not null")
            sizes = parts(strings, asked.join(stops, "id", "left_semi"))
        asked = _hashed(queries, forest, bits, wire).join(stops, "id").select("tree", "part", "hash", "id", "v", "stop")
        some = _blocks(_hashed(rows, forest, bits, wire), asked, sizes).groupBy(*group).applyInPandas(_score(k, wire), "query_id long, vec_id long, score double")
        found = some if found is None else found.union(some)
        if not more:
            break
        queries, top, bits = queries.join(open_, "id", "left_semi"), bits - 1, bits // 2
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
