"""File scan: which sources a run reads.  Listing is on the driver; contents are read by executors."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".ts", ".tsx", ".mts", ".cts")
SCHEMA = "path string, content string, content_hash string, is_entry boolean"


class ScanError(ValueError):
    """A path that isn't there, or a pattern that isn't valid."""


def is_source(path: Column) -> Column:
    """Case-sensitive test of the extension."""
    return F.rlike(path, F.lit(r"\.(ts|tsx|mts|cts)$"))


def glob_to_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` too (a bare star matches any text), ``[..]`` and ``{a,b}`` as usual."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = pattern.find("]", i + 2)
            if j < 0:
                raise ScanError(f"not a valid pattern: {pattern}")
            out.append("[" + pattern[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ScanError(f"not a valid pattern: {pattern}")
    return "^" + "".join(out) + "$"


def not_excluded(path: Column, patterns: Sequence[str]) -> Column:
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~F.rlike(path, F.lit(glob_to_regex(p)))
    return keep


def _ignored(rules: list[tuple[str, list[str]]], path: str, is_dir: bool) -> bool:
    """Rules of the ignore files above ``path``; a later rule wins."""
    verdict = False
    for root, lines in rules:
        rel = os.path.relpath(path, root)
        for line in lines:
            neg = line.startswith("!")
            rule = line[1:] if neg else line
            only_dir = rule.endswith("/")
            rule = rule.rstrip("/")
            if only_dir and not is_dir:
                continue
            anchored = "/" in rule
            rule = rule.lstrip("/")
            hit = re.match(glob_to_regex(rule), rel) if anchored else fnmatch.fnmatchcase(os.path.basename(path), rule)
            if hit:
                verdict = not neg
    return verdict


def _rules_in(folder: str) -> list[str]:
    out = []
    for name in (".gitignore", ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out += [x for x in (line.strip() for line in f) if x and not x.startswith("#")]
        except OSError:
            pass
    return out


def list_sources(paths: Sequence[str], exclude: Sequence[str] = (), max_files: int | None = None) -> list[str]:
    """Source files under ``paths``, canonical and distinct, in order.  Hidden entries and those that ignore files name are
    skipped below folders; a path that doesn't exist raises.  ``max_files`` stops the listing, as a limit of the run."""
    regexes = [re.compile(glob_to_regex(p)) for p in exclude]
    keep = lambda p: p.endswith(EXTENSIONS) and not any(r.match(p) for r in regexes)
    out: dict[str, None] = {}
    for path in paths:
        if os.path.isfile(path):
            if keep(path):
                out[os.path.realpath(path)] = None
        elif os.path.isdir(path):
            stack = [(path, [(path, _rules_in(path))])]
            while stack:
                folder, rules = stack.pop()
                with os.scandir(folder) as entries:
                    found = sorted(entries, key=lambda e: e.name)
                down = []
                for e in found:
                    if e.name.startswith(".") or _ignored(rules, e.path, e.is_dir(follow_symlinks=False)):
                        continue
                    if e.is_dir(follow_symlinks=False):
                        own = _rules_in(e.path)
                        down.append((e.path, rules + [(e.path, own)] if own else rules))
                    elif e.is_file() and keep(e.path):
                        out[os.path.realpath(e.path)] = None
                stack += reversed(down)
        else:
            raise ScanError(f"path does not exist: {path}")
    files = sorted(out)
    return files if max_files is None else files[:max_files]


def read_sources(spark: SparkSession, files: Sequence[str], entry: bool = True) -> DataFrame:
    """SCHEMA rows of the files.  Each task reads its own share of the list; empty files have rows too, and files that can't
    be read or aren't UTF-8 have null content."""
    import hashlib

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                    text = data.decode("utf-8")
                except (OSError, UnicodeDecodeError):  # a row without content: extraction reports it
                    data, text = b"", None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([hashlib.sha256(data).hexdigest()]), pa.array([entry])], names=["path", "content", "content_hash", "is_entry"])

    rows = spark.createDataFrame([(f,) for f in files], "path string")
    return rows.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, SCHEMA)
