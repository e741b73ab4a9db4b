"""One analysis of a source tree: scan, extract, resolve, propagate, check; reports and fixes of its findings."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.text import line_of
from .operators import catching, declarations, propagation, resolution
from .operators.fingerprint import fingerprint
from .operators.typing import ExactResolver, Resolver, StructuralResolver
from .session import ship
from .sources import cache, config, extraction, scan
from .storage import materialize

TOOL = "faultline-1"


class AnalysisError(ValueError):
    """A source that can't be analysed."""


@dataclass
class Options:
    """``types``: 'exact' (equal names) or 'structural' (hierarchy, aliases, annotations).  ``cross_file``: follow relative
    imports into other files, ``max_depth`` rounds.  ``receivers``: bind member calls by the receiver's annotated class.
    ``parity``: a try without catch catches everything.  ``max_files``: files analysed at most; None, all."""

    types: str = "structural"
    cross_file: bool = True
    receivers: bool = True
    parity: bool = False
    max_depth: int = 10
    max_files: int | None = None
    cache_dir: str | None = None


def _candidates(file: str, source: str) -> list[str]:
    base = os.path.normpath(os.path.join(os.path.dirname(file), source))
    stem = base[:-3] if base.endswith((".js", ".ts")) else base
    return [base, *(stem + e for e in scan.EXTENSIONS), *(os.path.join(base, "index" + e) for e in scan.EXTENSIONS)]


class Analysis:
    def __init__(self, spark: SparkSession, paths: Sequence[str], exclude: Sequence[str] = (), options: Options | None = None):
        self.spark, self.options, self.reused = spark, options or Options(), False
        if self.options.types not in ("exact", "structural"):
            raise ValueError("types is 'exact' or 'structural'")
        ship(spark)
        self.listed = scan.list_sources(paths, exclude)
        self.files = self.listed[: self.options.max_files]
        self.left_out = len(self.listed) - len(self.files)
        self.root = os.path.realpath(os.path.commonpath([os.path.abspath(p if os.path.isdir(p) else os.path.dirname(p) or ".") for p in paths])) if paths else os.getcwd()

    @cached_property
    def store(self) -> cache.Store | None:
        """The cache; another workspace (options, or files that decide what names mean) keeps its extractions alone."""
        o = self.options
        if not o.cache_dir:
            return None
        files = config.read_configs(self.spark, self.root, self.files)
        found = config.resolution_fingerprint(files, config.references(files)).first()
        shape = replace(o, cache_dir=None)
        workspace = hashlib.sha256(f"{shape}:{found.fingerprint if found else ''}".encode()).hexdigest()
        return cache.Store.load(self.spark, o.cache_dir, TOOL, workspace)

    @cached_property
    def _loaded(self) -> tuple[DataFrame, extraction.Program, DataFrame]:
        """(sources, program, imports with their files): entry files and what their imports lead to."""
        o = self.options
        known, fresh, rows, sources = set(self.files), list(self.files), None, None
        store = self.store
        for depth in range(o.max_depth + 1):
            read = materialize(scan.read_sources(self.spark, fresh, entry=depth == 0), "sources")
            old = store.get("files") if store else None
            if old is None:
                part = materialize(extraction.extractions(read), "extractions")
            else:
                hit = old.join(cache.hits(read, old).select("path", "content_hash"), ["path", "content_hash"], "left_semi").select(*extraction_columns())
                part = materialize(hit.unionByName(extraction.extractions(cache.misses(read, old))), "extractions")
            if depth == 0 and (bad := part.where("error is not null").select("path", "error").orderBy("path").first()):
                raise AnalysisError(f"{bad.path}: {bad.error}")
            rows = part if rows is None else rows.unionByName(part)
            sources = read if sources is None else sources.unionByName(read)
            if not o.cross_file:
                break
            # a listing of paths, as the scan's own: which imported files exist
            wanted = part.select(F.explode("imports").alias("i")).where("i.source like '.%'").select("i.file", "i.source").distinct().collect()
            fresh = sorted({os.path.realpath(c) for r in wanted for c in [next((c for c in _candidates(r.file, r.source) if os.path.isfile(c)), None)] if c and c.endswith(scan.EXTENSIONS) and "/node_modules/" not in c} - known)
            if o.max_files is not None:
                fresh = fresh[: max(0, o.max_files - len(known))]
            if not fresh:
                break
            known |= set(fresh)
        if store is not None:
            store.update("files", rows, ["path", "content_hash"])
            store.save()
        p = extraction.program(rows)
        links = [(r.file, r.source, os.path.realpath(c)) for r in p.imports.where("source like '.%'").select("file", "source").distinct().collect() for c in [next((c for c in _candidates(r.file, r.source) if os.path.isfile(c)), None)] if c]
        links = self.spark.createDataFrame(links, "file string, source string, target string")
        return sources, p, p.imports.join(links, ["file", "source"])

    @property
    def program(self) -> extraction.Program:
        return self._loaded[1]

    @property
    def sources(self) -> DataFrame:
        return self._loaded[0]

    @cached_property
    def calls(self) -> DataFrame:
        """(caller, callee, start, end): calls bound by the receiver's class, an import, or the name in the file."""
        _, p, links = self._loaded
        f = p.functions
        c = p.calls.join(f.select("fn", "file", "class_name", "params"), "fn")
        by_name = resolution.by_name(c.select("fn", "file", "callee_name", "callee_start"), f).select("fn", "callee_start", F.col("callee").alias("by_name"))
        target = f.select(F.col("file").alias("target"), F.col("name").alias("imported"), F.struct("has_body", -F.col("start"), "fn").alias("k"))
        imported = links.join(target, ["target", "imported"]).groupBy("file", "local").agg(F.max("k").alias("k")).select("file", F.col("local").alias("callee_name"), F.col("k.fn").alias("by_import"))
        # a name that the file itself defines hides the import
        c = c.join(by_name, ["fn", "callee_start"], "left")
        c = c.join(imported, (c.file == imported.file) & (c.callee_name == imported.callee_name) & c.receiver.isNull(), "left").drop(imported.file).drop(imported.callee_name)
        callee = F.coalesce("by_name", "by_import")
        if self.options.receivers:
            of = F.filter("params", lambda x: x["name"] == F.col("receiver"))
            cls = F.when(F.col("receiver") == "this", F.col("class_name")).otherwise(F.get(F.get(of, F.lit(0))["types"], F.lit(0)))
            methods = f.where("class_name is not null").groupBy(F.col("class_name").alias("m_class"), F.col("name").alias("m_name")).agg(F.max(F.struct("has_body", -F.col("start"), "fn")).alias("m"))
            known = f.where("class_name is not null").select(F.col("class_name").alias("k_class")).distinct()
            c = c.withColumn("cls", cls).join(methods, (F.col("cls") == F.col("m_class")) & (F.col("callee_name") == F.col("m_name")), "left").join(known, F.col("cls") == F.col("k_class"), "left")
            # the method of a class that is known here, else as without its type
            callee = F.when(F.col("k_class").isNotNull(), F.coalesce("m.fn", F.when(F.col("receiver") == "this", callee))).otherwise(callee)
        out = c.withColumn("callee", callee).where("callee is not null").select(F.col("fn").alias("caller"), "callee", "start", "end")
        return materialize(out, "calls")

    @cached_property
    def propagated(self) -> DataFrame:
        """(fn, kind, name, origin_fn, origin_start, origin_end, depth)."""
        p = self.program
        catch = materialize(catching.catchers(p.tries, p.throws, self.options.parity), "catchers")
        direct = catching.uncaught(p.throws.select("fn", "start", "end", "kind", "name"), p.tries, catch=catch)
        direct = direct.select("fn", "kind", "name", F.col("fn").alias("origin_fn"), F.col("start").alias("origin_start"), F.col("end").alias("origin_end"))
        blocked = catching.blocked_edges(self.calls, catch)
        return propagation.propagate(direct, self.calls, blocked)

    @cached_property
    def resolver(self) -> Resolver:
        p = self.program
        if self.options.types == "exact":
            return ExactResolver()
        thrown = p.throws.where("kind = 'unknown' and hint is not null").select("fn", "start", F.col("hint").alias("type"))
        made = p.calls.alias("c").join(p.throws.where("kind = 'unknown'").select("fn", F.col("start").alias("t_start"), F.col("end").alias("t_end")).alias("t"), "fn").where("c.start > t_start and c.end <= t_end and c.start <= t_start + 12")
        result = p.functions.select(F.col("fn").alias("callee"), F.get("result", F.lit(0)).alias("type")).where("type is not null")
        bound = self.calls.select(F.col("caller").alias("fn"), "start", "callee")
        by_call = made.select("fn", "start", "t_start").join(bound, ["fn", "start"]).join(result, "callee").select("fn", F.col("t_start").alias("start"), "type")
        return StructuralResolver(p.relations, p.aliases.select("alias", "member"), thrown.unionByName(by_call))

    @cached_property
    def missing(self) -> DataFrame:
        """Undeclared errors of functions of entry files, with where they come from.  With a cache they are taken from it if
        no source of the run has changed; a file that has none is cached as such."""
        if self.store is None:
            return self._missing
        now = self.sources.select("path", "content_hash")
        whole = fingerprint(now.withColumn("k", F.lit(0)), ["k"], F.concat_ws("=", "path", "content_hash")).select("fingerprint")
        wanted = self.sources.where("is_entry").select(F.col("path").alias("key")).withColumn("fingerprint", F.lit(whole.first().fingerprint))
        old = self.store.get("diagnostics")
        if old is not None:
            deps = old.select("key", F.inline("deps")).distinct()
            valid = cache.valid_diagnostics(old, wanted, deps, now)
            if not wanted.join(valid.select("key"), "key", "left_anti").limit(1).count():
                self.reused = True
                return valid.select(F.inline("rows"))
        rows = self._missing
        found = rows.groupBy(F.col("file").alias("key")).agg(F.collect_list(F.struct(*[F.col(c) for c in rows.columns])).alias("rows"))
        kind = found.schema["rows"].dataType.simpleString()
        deps = F.array(F.struct(F.col("key").alias("path"), F.col("content_hash")))
        own = wanted.join(now.withColumnRenamed("path", "key"), "key").join(found, "key", "left").select("key", "fingerprint", deps.alias("deps"), F.coalesce("rows", F.array().cast(kind)).alias("rows"))
        self.store.update("diagnostics", own, ["key"])
        self.store.save()
        return rows

    @cached_property
    def _missing(self) -> DataFrame:
        p = self.program
        m = declarations.missing_declarations(self.propagated, p.declared, self.resolver)
        f = p.functions.select("fn", "file", F.col("name").alias("function"), "start", "end")
        o = p.functions.select(F.col("fn").alias("origin_fn"), F.col("file").alias("origin_file"), F.col("name").alias("origin_name"))
        entry = self.sources.where("is_entry").select(F.col("path").alias("file"))
        return materialize(m.join(f, "fn").join(o, "origin_fn").join(entry, "file", "left_semi"), "missing")

    @cached_property
    def violations(self) -> DataFrame:
        """(file, function, start, parent_type, method_name, kind, name) of methods in entry files."""
        p = self.program
        methods = p.functions.select("fn", "class_name", F.col("name").alias("method_name"))
        v = declarations.substitution_violations(methods, self.propagated, p.relations.select("child", "parent"), p.signatures.select("type_name", "method_name", "declared", "ordinal"), self.resolver)
        f = p.functions.select("fn", "file", F.col("name").alias("function"), "start")
        return v.join(f, "fn").join(self.sources.where("is_entry").select(F.col("path").alias("file")), "file", "left_semi")

    def findings(self) -> tuple[list[dict], list[dict]]:
        """The report's rows, on the driver: a report is as long as its findings."""
        lines = self.sources.select(F.col("path").alias("origin_file"), "content")
        rows = self.missing.join(lines, "origin_file").withColumn("origin_line", line_of(F.col("content"), F.col("origin_start")))
        by: dict[tuple, dict] = {}
        for r in rows.orderBy("file", "function", "start", "end", "depth", "origin_file", "origin_start", "name").drop("content").toLocalIterator():
            d = by.setdefault((r.file, r.function, r.start, r.end), {"file": r.file, "function": r.function, "missing": []})
            d["missing"].append({"kind": r.kind, "name": r.name, "start": r.origin_start, "end": r.origin_end, "origin_file": r.origin_file, "origin_line": r.origin_line})
        sig = {(r.type_name, r.method_name): list(r.declared) for r in declarations.last_signature(self.program.signatures.select("type_name", "method_name", "declared", "ordinal")).toLocalIterator()}
        bad: dict[tuple, dict] = {}
        for r in self.violations.orderBy("file", "function", "start", "parent_type", "kind", "name").toLocalIterator():
            v = bad.setdefault((r.file, r.function, r.start, r.parent_type), {"file": r.file, "method": r.function, "parent_type": r.parent_type, "parent_method": r.method_name, "parent_declared": sig.get((r.parent_type, r.method_name), []), "errors": []})
            v["errors"].append(r.name if r.kind == "named" else None)
        return list(by.values()), list(bad.values())

    def report(self, kind: str = "text") -> tuple[str, bool]:
        """(report, whether there are findings)."""
        render = {"text": sinks.text_report, "json": sinks.json_report}.get(kind.lower())
        if render is None:
            raise ValueError(f"Invalid format: {kind}")
        d, v = self.findings()
        return render(d, v, len(self.files)), bool(d or v)

    def fixed(self) -> DataFrame:
        """(path, content) of the entry files that declarations were added to."""
        m = self.missing.select("fn", "kind", "name", "origin_file", "origin_name", F.struct("depth", "origin_file", "origin_start").alias("ordinal"))
        edits = sinks.fixes(self.sources, self.program.functions, m)
        changed = self.sources.where("is_entry").select("path", "content").join(edits.select("path").distinct(), "path", "left_semi")
        return sinks.insert_lines(changed, edits)

    def fix(self) -> int:
        """Rewrite the files in place; returns how many changed."""
        n = 0
        for r in self.fixed().toLocalIterator():
            with open(r.path, "w", encoding="utf-8", newline="") as f:
                f.write(r.content)
            n += 1
        return n


def extraction_columns() -> list[str]:
    return ["path", "content_hash", "error", *extraction.TABLES]
