"""Exact dedup (operator 8): tree-merge of sorted digest runs.

Every input partition makes one run: its distinct digests, each with the identifier that stays and the number of rows.
Runs then meet in binomial rounds.  In round k a run sends each digest to the run whose number differs from its own in
digit k only, so that the digit agrees with the digest's shard; the runs that meet are merged (sorted, one row per
digest, best identifier, sum of rows).  After log_fan_in(runs) rounds each digest is in one place, and no task ever held
more than its shard.  A group of any size is one row per run from the first round on, so hot groups cost nothing extra.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
_SCHEMA = "is_run boolean, run int, seq long, id long, digest binary, checksum long, n long"


def _digests(keep_largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, best = TaskContext.get().partitionId(), 0, {}
        low = -(1 << 63) - 1
        for batch in batches:
            ids, digests, sums = batch.column(0).to_pylist(), [], []
            for text in batch.column(1):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes().translate(_TABLE)
                digests.append(hashlib.sha256(data).digest())
                sums.append(zlib.crc32(data) << 24 ^ len(data))
            for k, (d, i) in enumerate(zip(digests, ids)):
                # a null id loses to any other; of equal ids the first row stays
                at = ((low if i is None else i if keep_largest else -i), -(seq + k))
                old = best.get(d)
                best[d] = (at, i, seq + k, 1, sums[k]) if old is None else (*(old[:3] if old[0] >= at else (at, i, seq + k)), old[3] + 1, old[4])
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * n), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sums, pa.int64()), pa.array([1] * n, pa.int64())],
                names=["is_run", "run", "seq", "id", "digest", "checksum", "n"],
            )
            seq += n
        order = sorted(best)
        for s in range(0, len(order), 10_000):
            keys = order[s : s + 10_000]
            rows = [best[k] for k in keys]
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * n), pa.array([part] * n, pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(keys, pa.binary()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                names=["is_run", "run", "seq", "id", "digest", "checksum", "n"],
            )

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8, max_runs: int = 1 << 14) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256 (binary), run, seq``.

    Texts are equal if they are the same after lower-casing A-Z only.  ``keep``: 'min' or 'max' identifier stays.
    Null text counts as empty; a null id loses to any other id; of rows with the same id and text one stays.  Digests are
    verified at every level by a second checksum and the length; a mismatch raises.  Empty input gives no rows.  Other
    columns are ignored.  Runs beyond ``max_runs`` share shards with others (each run of a shuffle has an index entry for
    every shard, so their number is bounded): a shard is then larger, and its sort spills to disk.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    both = materialize(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(_digests(keep == "max"), _SCHEMA), "digests")
    rows, runs = both.where("not is_run").select("run", "seq", "id", "digest"), both.where("is_run")
    most = runs.agg(F.max("run")).first()[0]
    bits = 0
    while most is not None and 1 << (bits + 1) <= min(most + 1, max_runs):
        bits += 1
    step, count = max(1, fan_in.bit_length() - 1), 1 << bits
    # the row that stays: largest (or smallest) id, then the first run and row
    rank = F.struct(F.col("id").isNotNull().alias("a"), (F.col("id") if keep == "max" else -F.col("id")).alias("b"), (-F.col("run")).alias("c"), (-F.col("seq")).alias("d"))
    level = runs.select("digest", "n", F.col("checksum").alias("lo"), F.col("checksum").alias("hi"), rank.alias("best"), (F.col("run") % count).alias("at"), F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").alias("shard"))
    level = level.withColumn("shard", (F.col("shard") % count).cast("int")).withColumn("at", F.col("at").cast("int"))
    for low in range(0, max(bits, 1), step):
        mask = ((1 << min(step, max(bits, 1) - low)) - 1) << low
        to = F.col("at").bitwiseAND(F.lit(~mask & 0x7FFFFFFF)).bitwiseOR(F.col("shard").bitwiseAND(F.lit(mask)))
        level = level.withColumn("at", to).repartitionById(count, F.col("at"))
        level = level.groupBy("at", "digest").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("best").alias("best"), F.first("shard").alias("shard"))
    ok = F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("long"))
    merged = level.select("digest", ok.alias("group_size"), F.when(F.col("best.a"), F.col("best.b") if keep == "max" else -F.col("best.b")).alias("keep_id"), (-F.col("best.c")).alias("keep_run"), (-F.col("best.d")).alias("keep_seq"))
    # down again: first to the runs (a digest is there once a run), then to the rows of each run
    down = runs.select("run", "digest").join(merged, "digest")
    return rows.join(down, ["run", "digest"]).select("id", "keep_id", "group_size", ((F.col("run") == F.col("keep_run")) & (F.col("seq") == F.col("keep_seq"))).alias("kept"), F.col("digest").alias("sha256"), "run", "seq")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) without exact copies: one row of each group of equal texts.

    Null text counts as empty, so of null and empty texts one row stays.  Rows with the same id and equal text count as one
    document, of which one row stays.  Rows with a null id stay only where no other row has their text.  Empty input gives
    no rows.
    """
    groups = materialize(exact_groups(docs, id_col, text_col, keep, fan_in), "copies")
    kept = groups.where("kept").select("id", "sha256")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    repeated = groups.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("k")).where("n > 1 and k = 1").limit(1).count()
    if not repeated:  # an id that stays names one row
        return rows.join(kept.select("id"), rows.id.eqNullSafe(kept.id), "left_semi").select("row.*")
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER.decode(), _UPPER.lower().decode())
    keyed = rows.withColumn("sha256", F.unhex(F.sha2(lower, 256)))
    joined = keyed.join(kept, keyed.id.eqNullSafe(kept.id) & (keyed.sha256 == kept.sha256), "left_semi")
    return joined.dropDuplicates(["id", "sha256"]).select("row.*")
