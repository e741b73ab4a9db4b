"""Project files that decide what names resolve to: manifests, lock files and configurations that refer to others.

Cached definitions and type checks hold as long as these files do, so their digest is part of every such key.
"""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import fingerprint
from ..operators.graph import held_back, rounds
from ..storage import materialize

PLAIN = frozenset({"package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb"})
SKIPPED = frozenset({".git", ".faultline", "node_modules", "target", "dist", "build", ".next", "coverage", ".turbo"})
REFERENCES = "path string, kind string, reference string, candidates array<string>, marker string"


def is_config(name: str) -> bool:
    """A configuration that may refer to others."""
    return name in ("tsconfig.json", "jsconfig.json") or (name.startswith(("tsconfig.", "jsconfig.")) and name.lower().endswith(".json"))


def decides(name: str) -> bool:
    return name in PLAIN or is_config(name)


def _upwards(folder: str) -> Iterable[str]:
    while True:
        yield folder
        up = posixpath.dirname(folder)
        if up == folder:
            return
        folder = up


def _extended(path: str, reference: str) -> tuple[list[str], str]:
    """(files that ``extends`` may mean, in order; marker if there is none)."""
    folder = posixpath.dirname(path)
    has_ext = bool(posixpath.splitext(reference)[1])
    if reference.startswith(("/", "./", "../")):
        at = posixpath.normpath(posixpath.join(folder, reference))
        return [at if has_ext else at + ".json"], "<missing>"
    names = [reference] if has_ext else [reference + ".json", reference + "/tsconfig.json"]
    return [posixpath.join(up, "node_modules", n) for up in _upwards(folder) for n in names], "<package-ref>"


def _refers(path: str, content: str | None) -> list[dict]:
    try:
        value = json.loads(content or "")
    except ValueError:
        return []
    if not isinstance(value, dict):
        return []
    row = lambda kind, reference, candidates, marker: {"path": path, "kind": kind, "reference": reference, "candidates": candidates, "marker": marker}
    out, extends = [], value.get("extends")
    if isinstance(extends, str):
        out.append(row("extends", extends, *_extended(path, extends)))
    elif isinstance(extends, list):
        out += [row("extends", x, *_extended(path, x)) if isinstance(x, str) else row("extends", f"<non-string:{k}>", [], "<invalid>") for k, x in enumerate(extends)]
    elif "extends" in value:
        out.append(row("extends", "<non-string>", [], "<invalid>"))
    for k, x in enumerate(value["references"] if isinstance(value.get("references"), list) else []):
        target = x.get("path") if isinstance(x, dict) else None
        if isinstance(target, str):
            at = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
            out.append(row("references", target, [at + "/tsconfig.json", at], "<missing>"))
        else:
            there = isinstance(x, dict) and "path" in x
            out.append(row("references", f"<{'non-string' if there else 'missing'}:{k}>", [], "<invalid>"))
    return out


def references(files: DataFrame) -> DataFrame:
    """(path, kind, reference, target, marker) of each reference in ``files`` (path, content): ``target`` is the first file of
    the table that it may mean, else ``marker`` says what is wrong.  Files that aren't JSON objects refer to nothing."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("path", pa.string()), ("kind", pa.string()), ("reference", pa.string()), ("candidates", pa.list_(pa.string())), ("marker", pa.string())])
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p is not None and is_config(posixpath.basename(p)) for r in _refers(p, c)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    found = files.select("path", "content").mapInArrow(run, REFERENCES)
    key = ["path", "kind", "reference"]
    tried = found.select(*key, F.posexplode("candidates").alias("no", "target"))
    first = tried.join(files.select(F.col("path").alias("target")).distinct().hint("merge"), "target", "left_semi").groupBy(*key).agg(F.min(F.struct("no", "target")).alias("t"))
    out = found.select(*key, "marker").distinct().join(first.hint("merge"), key, "left")
    return out.select(*key, F.col("t.target").alias("target"), F.when(F.col("t").isNull(), F.col("marker")).alias("marker"))


def closure(refs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, path): every file that a configuration leads to; ``roots``: column ``root``, default all of ``refs``."""
    e = materialize(refs.where("target is not null").select(F.col("path").alias("a"), "target").distinct(), "references")
    to = held_back(e)
    first = e.select(F.col("a").alias("root"), F.col("target").alias("path"))
    if roots is not None:
        first = first.join(roots.select("root"), "root", "left_semi")
    return rounds(first, lambda new: new.join(to, F.col("path") == F.col("a")).select("root", F.col("target").alias("path")), ["root", "path"])


def entries(files: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, value): files with their content's digest, and what is wrong with references."""
    wrong = refs.where("marker is not null").select(F.concat_ws("#", "path", "kind", "reference").alias("name"), F.col("marker").alias("value"))
    return files.select(F.col("path").alias("name"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("value")).unionByName(wrong)


def resolution_fingerprint(files: DataFrame, refs: DataFrame) -> DataFrame:
    """One row, ``fingerprint``, of all entries; no rows without files."""
    return fingerprint(entries(files, refs).withColumn("k", F.lit(0)), ["k"], F.concat_ws("=", "name", "value")).select("fingerprint")


def read_configs(spark: SparkSession, root: str, sources: Sequence[str]) -> DataFrame:
    """(path, content) of the files that decide: those below ``root`` but for SKIPPED folders, those in folders above each
    source up to ``root``, and what they refer to, wherever it lies."""
    found: dict[str, str] = {}

    def add(path: str) -> None:
        path = os.path.realpath(path)
        if path in found or not os.path.isfile(path):
            return
        with open(path, "rb") as f:
            found[path] = f.read().decode("utf-8", "replace")
        if is_config(os.path.basename(path)) or path.endswith(".json") and os.path.basename(path) not in PLAIN:
            for r in _refers(path, found[path]):
                if (hit := next((c for c in r["candidates"] if os.path.isfile(c)), None)) is not None:
                    add(hit)

    for folder, down, names in os.walk(root):
        down[:] = [x for x in down if x not in SKIPPED]
        for name in names:
            if decides(name):
                add(os.path.join(folder, name))
    for folder in {os.path.dirname(s) for s in sources}:
        for up in _upwards(folder):
            for name in os.listdir(up) if os.path.isdir(up) else ():
                if decides(name):
                    add(os.path.join(up, name))
            if up == root:
                break
    return spark.createDataFrame(sorted(found.items()), "path string, content string")
