"""N-gram Jaccard join (operator 2): MinHash banding with verification on full n-gram sets.

1. Texts with equal n-gram sets become one class at once, so groups of copies of any size are one row.
2. Each class has a MinHash signature (16 bits a hash).  Rows per band and bands are chosen for the recall wanted at the
   threshold.  A band's rows are its key; the shuffle is on these keys.  Two classes are candidates if they share a key.
3. Buckets that share members are put together, so that a class moves once and not once a bucket.  Where this would bring
   together far more than the buckets themselves hold (chains of loosely related texts), the buckets are compared by
   signature first, and only what agrees stays together.
4. Groups are compared in blocks of bounded size: pairs that the signatures rule out (by ``sigmas`` standard deviations)
   go, the rest of the candidates are verified on whole n-gram sets.  A block gives each class's number of links and a
   spanning forest of its links, so what leaves it grows with its members, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U, Words, blocks, mix, raw
from .storage import materialize, open_fs

SIGMAS = 4.5
#: A block has at most about so many classes of either side, and so many n-grams.
BLOCK_ROWS, BLOCK_GRAMS = 2048, 1 << 21
#: Rows that are handled together, so that small blocks share their costs.
BATCH_ROWS = 2048


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, and for them the fewest bands, with which a pair at ``threshold`` shares a bucket with
    probability ``recall``, in at most ``most`` hash functions."""
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall lie between 0 and 1")
    best = None
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within so few hash functions")
    return best


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one text's word hashes, in order; a text of fewer words is one gram; no words, none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[k : k + m] + U(k + 1))
    return h


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text (null: none)."""
    data, off = raw(texts)
    pending: list[np.ndarray] = []
    row = -1
    for first, rows, piece, o, _ in blocks(data, off):
        w = Words(piece, o)
        h = w.hash
        for r in range(rows):
            part = h[w.first[r] : w.first[r + 1]]
            if first + r == row:  # a further piece of a long text
                pending.append(part)
                continue
            if row >= 0:
                yield np.unique(grams_of(np.concatenate(pending), n))
            row, pending = first + r, [part]
    if row >= 0:
        yield np.unique(grams_of(np.concatenate(pending), n))


def _profiles(n: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def part(ids: list, sets: list[np.ndarray], texts: pa.Array) -> pa.RecordBatch:
        size = np.array([len(s) for s in sets], np.int64)
        key, signatures = np.zeros(len(sets), np.uint64), [None] * len(sets)
        some = np.flatnonzero(size)
        if len(some):
            flat = np.concatenate([sets[i] for i in some])
            at = np.concatenate(([0], np.cumsum(size[some])[:-1]))
            s1, s2 = np.add.reduceat(mix(flat), at), np.add.reduceat(mix(flat ^ U(0xA5A5A5A55A5A5A5A)), at)
            key[some] = mix(s1 ^ mix(s2 + size[some].astype(np.uint64)))
            sig = np.empty((len(some), bands * rows), np.uint64)
            for k in range(bands * rows):
                sig[:, k] = np.minimum.reduceat((flat ^ add[k]) * mul[k] >> U(16), at)
            for i, k in zip(some.tolist(), (mix(sig) & U(0xFFFF)).astype(np.uint16)):
                signatures[i] = k.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key.view(np.int64), mask=size == 0), pa.array(size), pa.array(signatures, pa.binary()), texts], names=["id", "t", "size", "sig", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, first, sets, total = batch.column(0).to_pylist(), batch.column(1), 0, [], 0
            for k, s in enumerate(gram_sets(texts, n), 1):
                sets.append(s)
                total += len(s)
                if total > 200_000 or k == len(ids):
                    yield part(ids[first:k], sets, texts.slice(first, k - first))
                    first, sets, total = k, [], 0

    return run


def _keys(bands: int, rows: int):
    """(t, band) of signatures (t, sig): a row a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 2000):
                batch = big.slice(s, 2000)
                sig = _signatures(batch.column(1)).reshape(batch.num_rows, bands, rows).astype(np.uint64)
                h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
                for r in range(rows):
                    h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(h.reshape(-1).view(np.int64))], names=["t", "band"])

    return run


def _ruled_out(hashes: int, threshold: float, sigmas: float | None) -> int:
    """Least number of equal hashes with which a pair may still reach the threshold."""
    if sigmas is None:
        return 0
    p = threshold + (1 - threshold) / 65536
    return max(0, int(np.floor(hashes * p - sigmas * np.sqrt(hashes * p * (1 - p)))))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _blocked(members: DataFrame, found: DataFrame) -> DataFrame:
    """(grp, i, j, own, t, sig, text): the rows of each block; members: (grp, t, wide), wide being the group's number of
    parts; found: (t, sig, text).  Sorted by block within partitions; a group of many parts is many blocks, which stand
    anywhere."""
    own = members.withColumn("own", F.pmod(F.xxhash64("t"), F.col("wide")).cast("int")).join(found.hint("merge"), "t")  # its size isn't known: never broadcast
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "t", "sig", "text")
    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, edges between blocks) of some whole blocks each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for big in batches:
        for s in range(0, big.num_rows, BATCH_ROWS):
            held.append(big.slice(s, BATCH_ROWS))
            size += held[-1].num_rows
            if size < BATCH_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            edge = _edges(rows)
            if len(edge) > 2:  # the last block may go on
                yield rows.slice(0, edge[-2]), edge[:-1]
                rows = rows.slice(edge[-2])
            held, size = rows.to_batches(), rows.num_rows if len(edge) > 2 else 0
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, _edges(rows)


def _edges(rows: pa.Table) -> np.ndarray:
    change = np.zeros(max(0, rows.num_rows - 1), bool)
    for c in rows.columns[:3]:
        x = c.to_numpy()
        change |= x[1:] != x[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [rows.num_rows]))


def _candidates(rows: pa.Table, edge: np.ndarray, bands: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block that share a band and agree in at least ``least`` hashes."""
    i, j, own = (rows.column(k).to_numpy() for k in (1, 2, 3))
    sig = _signatures(rows.column(5))
    xs, ys = [], []
    two = edge[:-1][np.diff(edge) == 2]
    two = two[(i[two] == j[two]) | (own[two] != own[two + 1])]
    if len(two):
        two = two[np.count_nonzero(sig[two] == sig[two + 1], axis=1) >= least]
        xs.append(two)
        ys.append(two + 1)
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if e - s < 3:
            continue
        within = i[s] == j[s]
        left, right = s + np.flatnonzero(own[s:e] == i[s]), s + np.flatnonzero(own[s:e] == j[s])
        other = sig[right]
        for k, r in enumerate(left.tolist()):
            f = k + 1 if within else 0
            at = right[f:][np.count_nonzero(other[f:] == sig[r], axis=1) >= least]
            if len(at):
                xs.append(np.full(len(at), r))
                ys.append(at)
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(xs).astype(np.int64), np.concatenate(ys).astype(np.int64)
    wide = sig.reshape(len(sig), bands, -1)
    wide = np.ascontiguousarray(wide).view(np.uint64)[:, :, 0] if wide.shape[2] == 4 else wide
    share = np.zeros(len(x), bool)
    for s in range(0, len(x), 8192):
        same = wide[x[s : s + 8192]] == wide[y[s : s + 8192]]
        share[s : s + 8192] = (same.all(2) if same.ndim == 3 else same).any(1)
    return x[share], y[share]


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Numbers of pairs (x, y) of n nodes that connect all that the pairs connect, without cycles."""
    label, left, kept = np.arange(n), np.arange(len(x)), []
    while True:
        a, b = label[x[left]], label[y[left]]
        open_ = a != b
        left, a, b = left[open_], a[open_], b[open_]
        if not len(left):
            return np.sort(np.concatenate(kept)) if kept else left
        first = np.full(n, len(x))
        for ends in (a, b):  # the least pair of each label: the last that is written
            low = np.full(n, len(x))
            low[ends[::-1]] = left[::-1]
            np.minimum(first, low, out=first)
        chosen = np.unique(first[first < len(x)])
        kept.append(chosen)
        a, b, parent = label[x[chosen]], label[y[chosen]], np.arange(n)
        while True:
            low, now = np.minimum(parent[a], parent[b]), parent.copy()
            np.minimum.at(now, a, low)
            np.minimum.at(now, b, low)
            now = now[now]
            if (now == parent).all():
                break
            parent = now
        label = parent[label]


def _jaccard(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard of each pair (x, y) of numbers of ``sets``; pairs of one x stand together."""
    size = np.array([len(s) for s in sets], np.int64)
    grams, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(size)[:-1])
    out, mark = np.zeros(len(x)), np.zeros(len(grams), bool)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist()
    for s, e in zip(at, [*at[1:], len(x)]):
        own = codes[x[s]]
        mark[own] = True
        for f in range(s, e, 4096):
            some = y[f : min(e, f + 4096)]
            both = np.add.reduceat(mark[np.concatenate([codes[k] for k in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            out[f : f + len(some)] = both / (len(own) + size[some] - both)
        mark[own] = False
    return out


def _screened(bands: int, least: int):
    """(a, b): a spanning forest of each block's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _whole_blocks(batches):
            x, y = _candidates(rows, edge, bands, least)
            k = spanning(x, y, rows.num_rows)
            t = rows.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(t[x[k]]), pa.array(t[y[k]])], names=["a", "b"])

    return run


def _linked(n: int, bands: int, least: int, threshold: float, every: bool):
    """(a, b, jaccard, n): links (all, or a spanning forest of each block's) with n null, and a's number of links in the
    block with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _whole_blocks(batches):
            x, y = _candidates(rows, edge, bands, least)
            if not len(x):
                continue
            some, at = np.unique(np.concatenate((x, y)), return_inverse=True)
            sets = list(gram_sets(rows.column(6).take(pa.array(some)), n))
            x, y = at[: len(x)], at[len(x) :]
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            score = _jaccard(sets, x, y)
            ok = score >= threshold
            x, y, score = x[ok], y[ok], score[ok]
            t = rows.column(4).to_numpy()[some]
            if not every:
                count = np.bincount(x, minlength=len(t)) + np.bincount(y, minlength=len(t))
                has = np.flatnonzero(count)
                none = pa.nulls(len(has), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(t[has]), none, none.cast(pa.float64()), pa.array(count[has].astype(np.int64))], names=["a", "b", "jaccard", "n"])
                k = spanning(x, y, len(t))
                x, y, score = x[k], y[k], score[k]
            for s in range(0, len(x), 100_000):
                a, b = t[x[s : s + 100_000]], t[y[s : s + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score[s : s + 100_000]), pa.nulls(len(a), pa.int64())], names=["a", "b", "jaccard", "n"])

    return run


def _fetched(wanted: DataFrame, profiles: DataFrame, texts: bool = True) -> DataFrame:
    """(t, sig, text) of some classes, text null without ``texts``: each file of the written profiles is read where it lies
    by one task that knows which of its rows are wanted, so that nothing else moves.  A task gets at most as many keys as
    its file has rows."""
    columns = ["t", "sig", "text"] if texts else ["t", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, some in zip(batch.column(0).to_pylist(), batch.column(1)):
                fs, at = open_fs(path if "://" in path else path.replace(":/", ":///", 1))
                left = np.sort(some.values.to_numpy())
                with fs.open_input_file(at) as f:
                    for rows in pq.ParquetFile(f).iter_batches(512, columns=columns):
                        t = rows.column(0).fill_null(0).to_numpy()
                        first = np.zeros(len(t), bool)
                        first[np.unique(t, return_index=True)[1]] = True  # a class may have several rows
                        hit = first & np.isin(t, left)
                        if hit.any():
                            left = np.setdiff1d(left, t[hit], assume_unique=True)
                            rows = rows.filter(pa.array(hit))
                            text = rows.column(2) if texts else pa.nulls(rows.num_rows, pa.string())
                            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), text], names=["t", "sig", "text"])

    at = profiles.where("t is not null").select("t", F.col("_metadata.file_path").alias("path")).join(wanted, "t", "left_semi")
    files = at.groupBy("t").agg(F.min("path").alias("path")).groupBy("path").agg(F.collect_list("t").alias("ts"))
    tasks = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or few keys would make one task
    return files.repartition(tasks, F.xxhash64("path")).mapInArrow(run, "t long, sig binary, text string")


def _groups(profiles: DataFrame, bands: int, rows: int, least: int) -> DataFrame:
    """(grp, t): classes that share buckets, directly or through others; each class in at most one group."""
    spread = profiles.where("id is not null and t is not null").select("t", "sig").mapInArrow(_keys(bands, rows), "t long, band long")
    buckets = spread.groupBy("band").agg(F.min("t").alias("lead"), F.max("t").alias("top")).where("lead < top").select("band", "lead")
    members = materialize(spread.join(buckets, "band").distinct(), "members")
    labels = materialize(components(members.where("t != lead").select(F.col("lead").alias("a"), F.col("t").alias("b")).distinct()), "groups")
    inside = labels.groupBy("label").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_ROWS)
    sizes = members.groupBy("band").agg(F.min("lead").alias("lead"), F.count("*").alias("n"))
    compared = sizes.join(labels, F.col("lead") == F.col("node")).groupBy("label").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    loose = materialize(inside.join(compared, "label").where("m * m > 4 * pairs").select("label"), "loose")
    if not loose.limit(1).count():
        return labels.select(F.col("label").alias("grp"), F.col("node").alias("t"))
    some = labels.join(loose, "label", "left_semi").select(F.col("node").alias("t"))
    wide = sizes.select("band", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("wide"))
    parts = members.join(some, "t", "left_semi").join(wide, "band").select(F.col("band").alias("grp"), "t", "wide")
    edges = _blocked(parts, _fetched(some, profiles, False)).mapInArrow(_screened(bands, least), "a long, b long")
    tight = labels.join(loose, "label", "left_anti").select(F.col("label").alias("grp"), F.col("node").alias("t"))
    return tight.union(components(edges).select("label", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, recall: float = 0.95, seed: int = 7, sigmas: float | None = SIGMAS, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    ``classes``: one row per input row: ``id, class_id`` (least id of all that are linked, directly or through others),
    ``text_class`` (least id with the same n-gram set), ``n_links`` (verified links of its n-gram set; of an id with several
    texts the sum over its sets).  ``links``: ``a, b, jaccard`` of different n-gram sets, named by their least ids: with
    ``every_link`` all links found, else a spanning forest of those of each block; counts are whole either way.

    Linked are all pairs that share a bucket and reach the threshold on whole n-gram sets, but for those that the screen by
    signatures drops (3 in 10^6 at the threshold; ``sigmas=None`` verifies all).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; n-grams are of ``n`` words (a shorter text is
    one gram).  Null and empty texts have no grams: each is its own class without links.  Rows with a null id have null
    classes.  Rows that share an id are one document, whose texts all link.  Empty input gives no rows.  Other columns are
    ignored, whatever their names.
    """
    bands, rows = banding(threshold, recall)
    least = _ruled_out(bands * rows, threshold, sigmas)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    profiles = materialize(source.mapInArrow(_profiles(n, bands, rows, seed), "id long, t long, size long, sig binary, text string"), "profiles")
    known = profiles.where("id is not null and t is not null")
    reps = materialize(known.groupBy("t").agg(F.min("id").alias("text_class"), F.max("size").alias("size")), "classes")
    groups = materialize(_groups(profiles, bands, rows, least), "grouped")
    wide = groups.join(reps.select("t", "size"), "t").groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("wide"))
    blocked = _blocked(groups.join(wide, "grp"), _fetched(groups.select("t"), profiles))
    found = materialize(blocked.mapInArrow(_linked(n, bands, least, threshold, every_link), "a long, b long, jaccard double, n long"), "links")
    pairs = found.where("b is not null")
    ends = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).withColumn("n", F.lit(1).cast("long")) if every_link else found.where("b is null").select(F.col("a").alias("t"), "n")
    count = ends.groupBy("t").agg(F.sum("n").alias("n_links"))
    named = known.select("id", "t").distinct()
    # an id that came with several texts ties their classes together
    ties = named.groupBy("id").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a != z")
    ties = named.join(ties.select("id", "a"), "id").where("t != a").select("a", F.col("t").alias("b"))
    labels = components(pairs.select("a", "b").union(ties))
    least_id = labels.join(reps.select(F.col("t").alias("node"), "text_class"), "node").groupBy("label").agg(F.min("text_class").alias("class_id"))
    per_text = reps.select("t", "text_class").join(labels.join(least_id, "label").select(F.col("node").alias("t"), "class_id"), "t", "left").join(count, "t", "left")
    own = profiles.where("id is not null").select("id", "t").distinct().join(per_text, "t", "left")
    per_id = own.groupBy("id").agg(F.min(F.coalesce("class_id", "text_class", "id")).alias("class_id"), F.min(F.coalesce("text_class", "id")).alias("text_class"), F.sum("n_links").alias("n_links"))
    classes = profiles.select("id").join(per_id, "id", "left").select("id", "class_id", "text_class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    name = lambda side: reps.select(F.col("t").alias(side), F.col("text_class").alias(f"{side}_id"))
    links = pairs.join(name("a"), "a").join(name("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "jaccard")
    return classes, links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose id is the least of its class; rows with a null id
    stay, and so do all rows of an id that stays.  Empty input gives no rows; null and empty texts stay."""
    classes, _ = near_duplicates(docs, id_col, text_col, **options)
    gone = classes.where("id != class_id").select("id").distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
