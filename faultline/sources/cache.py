"""Incremental cache: extractions, definitions, diagnostics and type checks as Parquet tables of one store.

Lookups are joins.  A store has a version: each save writes a new folder and then replaces the pointer file, so readers see
the old or the new state whole.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
TABLES = ("files", "definitions", "diagnostics", "type_checks")


def hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    """``files`` (path, content_hash, ..) whose extraction is cached for just this content."""
    return files.join(cached.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_semi")


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    """``files`` that must be parsed: new, or changed since."""
    return files.join(cached.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")


def valid_diagnostics(cached: DataFrame, wanted: DataFrame, deps: DataFrame, current: DataFrame) -> DataFrame:
    """``cached`` (key, fingerprint, ..) that ``wanted`` (key, fingerprint) asks for and none of whose ``deps`` (key, path,
    content_hash) has another hash in ``current`` (path, content_hash), or is gone there."""
    stale = deps.join(current, ["path", "content_hash"], "left_anti").select("key").distinct()
    return cached.join(wanted.select("key", "fingerprint"), ["key", "fingerprint"], "left_semi").join(stale, "key", "left_anti")


def definition_hits(calls: DataFrame, cached: DataFrame, current: DataFrame, resolution: str) -> DataFrame:
    """``cached`` definitions (file, content_hash, start, end, callee_name, def_file, def_line) of ``calls`` where the caller's
    file, the definition's file and the resolution fingerprint are all as they were: each of them once, however often its call
    comes in ``calls``."""
    key = ["file", "content_hash", "start", "end", "callee_name"]
    c = cached.where(F.col("resolution") == resolution).join(current.select(F.col("path").alias("def_file"), F.col("content_hash").alias("def_hash")), ["def_file", "def_hash"], "left_semi")
    return c.join(calls.select(*key), key, "left_semi").select(*key, "def_file", "def_line")


def type_check_hits(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """``pairs`` (file, content_hash, scope, thrown, declared) with the cached ``fits``."""
    key = ["file", "content_hash", "scope", "thrown", "declared"]
    return pairs.join(cached.select(*key, "fits"), key)


def read_through(pairs: DataFrame, cached: DataFrame, decide) -> DataFrame:
    """``pairs`` with ``fits`` and ``cached``: by the cache where it knows them, else by ``decide(rows) -> rows with fits``.
    All rows are what a result that used them depends on; those that aren't ``cached`` are the cache's news."""
    key = ["file", "content_hash", "scope", "thrown", "declared"]
    known = type_check_hits(pairs, cached).select(*key, "fits", F.lit(True).alias("cached"))
    news = decide(pairs.join(cached.select(*key), key, "left_anti")).select(*key, "fits", F.lit(False).alias("cached"))
    return known.unionByName(news)


class Store:
    """The tables in a folder.  ``load`` gives an empty store for a missing, broken or other version's folder; another tool
    version or workspace keeps the extractions and drops the rest."""

    def __init__(self, spark: SparkSession, folder: str, tool: str, workspace: str):
        self.spark, self.folder, self.tool, self.workspace = spark, folder, tool, workspace
        self.tables: dict[str, DataFrame] = {}
        self.version: str | None = None
        self.dirty = False

    @classmethod
    def load(cls, spark: SparkSession, folder: str, tool: str, workspace: str) -> Store:
        s = cls(spark, folder, tool, workspace)
        try:
            with open(os.path.join(folder, "current.json"), encoding="utf-8") as f:
                meta = json.load(f)
            if meta["schema_version"] != SCHEMA_VERSION:
                return s
            s.version = meta["version"]
            same = meta["tool"] == tool and meta["workspace"] == workspace
            for t in meta["tables"]:
                if t in TABLES and (same or t == "files"):
                    path = os.path.join(folder, meta["version"], t)
                    if not os.path.isdir(path):
                        raise OSError(path)
                    s.tables[t] = spark.read.parquet(path)
            s.dirty = not same
        except (OSError, ValueError, KeyError, TypeError):
            s.tables, s.dirty = {}, True
        return s

    def get(self, table: str) -> DataFrame | None:
        return self.tables.get(table)

    def update(self, table: str, rows: DataFrame, key: list[str]) -> None:
        """Rows by key: new ones win."""
        if table not in TABLES:
            raise KeyError(table)
        old = self.tables.get(table)
        self.tables[table] = rows if old is None else rows.unionByName(old.join(rows.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
        self.dirty = True

    def set_workspace(self, workspace: str) -> None:
        """Another workspace empties all but the extractions."""
        if workspace != self.workspace:
            self.workspace, self.dirty = workspace, True
            self.tables = {t: d for t, d in self.tables.items() if t == "files"}

    def save(self) -> bool:
        """Write if anything changed; the pointer is replaced last.  Returns whether it was written."""
        if not self.dirty:
            return False
        version = f"v-{uuid.uuid4().hex}"
        for t, d in self.tables.items():
            d.write.parquet(os.path.join(self.folder, version, t))
        os.makedirs(self.folder, exist_ok=True)
        pointer = os.path.join(self.folder, "current.json")
        with open(f"{pointer}.{version}", "w", encoding="utf-8") as f:
            json.dump({"schema_version": SCHEMA_VERSION, "tool": self.tool, "workspace": self.workspace, "version": version, "tables": sorted(self.tables)}, f)
        os.replace(f"{pointer}.{version}", pointer)
        # the version before stays for runs that have loaded it; older ones go
        old = [v for v in os.listdir(self.folder) if v.startswith("v-") and v not in (version, self.version)]
        for v in old:
            shutil.rmtree(os.path.join(self.folder, v), ignore_errors=True)
        self.version = version
        self.tables = {t: self.spark.read.parquet(os.path.join(self.folder, version, t)) for t in self.tables}
        self.dirty = False
        return True
