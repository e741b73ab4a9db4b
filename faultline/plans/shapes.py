"""Queries over whole source files of many shapes: one file a part, and source trees on disk."""

from __future__ import annotations

import contextlib
import io
import os

from pyspark.sql import functions as F

from ..operators import catching
from .facts import table
from .queries import query


def _files(spark, d):
    """Classes with documented methods, nested functions, annotated variables, catches that end in a switch, interfaces."""
    k = F.col("p_partkey").cast("string")
    last = F.when(F.col("p_size") % 2 == 0, F.lit("default: return;")).otherwise(F.lit("case 2: return;"))
    body = F.concat(
        F.lit("interface Shape"), k, F.lit(" {\n  /** @throws {Low"), k, F.lit("} */\n  draw(x: string): void;\n}\nclass Box"), k, F.lit(" extends Base implements Shape"), k, F.lit(" {\n  draw(x: string): void {\n    function inner() { throw new In"), k,
        F.lit("(); }\n    inner();\n  }\n  async save() { throw new Out"), k, F.lit("(); }\n}\nfunction told(err: Told"), k, F.lit(") { throw err; }\nfunction sw(x: number) {\n  try { told(null); } catch (e) {\n    switch (x) { case 1: return; "), last, F.lit(" }\n    throw e;\n  }\n}\n"
        "function scoped(e: Error) {\n  try { told(null); } catch (e) { if (e instanceof Low) return; throw e; }\n  throw e;\n}\n"),
    )
    return table(spark, d, "part").select(F.format_string("/src/s%d.ts", "p_partkey").alias("path"), body.alias("content")).withColumn("content_hash", F.sha2("content", 256))


def _program(spark, d):
    from ..sources.extraction import extractions, program

    return program(extractions(_files(spark, d)))


def _named(p, rows):
    return rows.join(p.functions.select("fn", "file", F.col("name").alias("fn_name")), "fn")


@query("SELECT '/src/s' || p_partkey || '.ts' AS file, f.name, CASE WHEN f.method THEN 'Box' || p_partkey END AS class_name, f.is_async FROM part, (VALUES ('draw', true, false), ('inner', true, false), ('save', true, true), ('told', false, false), ('sw', false, false), ('scoped', false, false)) f(name, method, is_async)")
def extract_methods(spark, d):
    """Methods with their classes, and functions within methods, which are of the class too."""
    return _program(spark, d).functions.where("has_body").select("file", "name", "class_name", "is_async")


@query("SELECT '/src/s' || p_partkey || '.ts' AS file, t.fn_name, t.kind, CASE t.kind WHEN 'named' THEN t.name || p_partkey ELSE t.name END AS name, CASE WHEN t.fn_name = 'told' THEN 'Told' || p_partkey WHEN t.hint THEN 'Error' END AS hint FROM part, (VALUES ('inner', 'named', 'In', false), ('save', 'named', 'Out', false), ('told', 'unknown', NULL, false), ('sw', 'rethrow', 'e', false), ('scoped', 'rethrow', 'e', false), ('scoped', 'unknown', NULL, true)) t(fn_name, kind, name, hint)")
def extract_scopes(spark, d):
    """Throws by the innermost function, thrown variables with their annotated types, catch parameters in their clause only."""
    p = _program(spark, d)
    return _named(p, p.throws).select("file", "fn_name", "kind", "name", "hint")


@query("SELECT '/src/s' || p_partkey || '.ts' AS file, t.fn_name, CASE t.fn_name WHEN 'scoped' THEN 'Low' END AS caught FROM part, (VALUES ('sw'), ('scoped')) t(fn_name)")
def extract_switches(spark, d):
    """Caught types where a switch ends the catch on every way or on some."""
    p = _program(spark, d)
    return _named(p, p.tries).select("file", "fn_name", F.nullif(F.array_join("caught_types", ","), F.lit("")).alias("caught"))


@query("SELECT 'Box' || p_partkey AS child, r.parent || CASE WHEN r.own THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS parent, r.kind FROM part, (VALUES ('Base', false, 'extends'), ('Shape', true, 'implements')) r(parent, own, kind)")
def extract_relations(spark, d):
    """Classes and what they extend and implement."""
    return _program(spark, d).relations.select("child", "parent", "kind")


@query("SELECT 'Shape' || p_partkey AS type_name, 'draw' AS method_name, 'Low' || p_partkey AS declared FROM part")
def extract_interfaces(spark, d):
    """Methods of interfaces with what they document."""
    return _program(spark, d).signatures.where("type_name like 'Shape%'").select("type_name", "method_name", F.array_join("declared", ",").alias("declared"))


@query("SELECT '/src/s' || p_partkey || '.ts' AS file, t.fn_name, t.kind, CASE t.kind WHEN 'named' THEN t.name || p_partkey ELSE t.name END AS name FROM part, (VALUES ('inner', 'named', 'In', true), ('save', 'named', 'Out', true), ('told', 'unknown', NULL, true), ('scoped', 'unknown', NULL, true)) t(fn_name, kind, name, always)")
def scopes_uncaught(spark, d):
    """What leaves these functions by itself: rethrows within catches count with what was caught."""
    p = _program(spark, d)
    out = catching.uncaught(p.throws.select("fn", "start", "end", "kind", "name"), p.tries)
    return _named(p, out).select("file", "fn_name", "kind", "name")


# source trees on disk


def _tree(spark, d):
    """A folder a region, a file a nation: every third one throws undocumented, every fifth isn't source; besides an ignored
    folder, hidden files, a link to a file, and declarations without bodies."""
    from ..storage import new_path

    root = new_path(spark, "tree").removeprefix("file://")
    regions = [r.r_regionkey for r in table(spark, d, "region").select("r_regionkey").collect()]  # two tables of fixed size
    nations = [(r.n_nationkey, r.n_regionkey) for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()]
    for r in regions:
        os.makedirs(f"{root}/r{r}/skipped")
    for n, r in nations:
        text = f"export function f{n}() {{ throw new E{n}(); }}\n" if n % 3 == 0 else f"export function f{n}() {{ return {n}; }}\n"
        for path in (f"r{r}/n{n}.{'txt' if n % 5 == 0 else 'ts'}", f"r{r}/skipped/n{n}.ts", f"r{r}/.n{n}.ts"):
            with open(f"{root}/{path}", "w", encoding="utf-8") as f:
                f.write(text)
    with open(f"{root}/.gitignore", "w", encoding="utf-8") as f:
        f.write("skipped/\n")
    return root


_SHOWN = "SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.ts' AS path FROM nation WHERE n_nationkey % 5 <> 0"
_BAD = "n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0"


def _listed(spark, root, files):
    return spark.createDataFrame([(os.path.relpath(p, os.path.realpath(root)),) for p in files], "path string")


@query(_SHOWN)
def scan_listing(spark, d):
    """Sources below a folder: no hidden, ignored or other files; paths that are named twice come once."""
    from ..sources.scan import list_sources

    root = _tree(spark, d)
    return _listed(spark, root, list_sources([root, f"{root}/.", f"{root}/r0/../"]))


@query("SELECT path FROM (" + _SHOWN + ") WHERE path NOT LIKE 'r1/%' ORDER BY path LIMIT 7")
def scan_limit(spark, d):
    """The first files by path where a run is limited, with an excluded folder."""
    from ..sources.scan import list_sources

    root = _tree(spark, d)
    return _listed(spark, root, list_sources([root], ["**/r1/**"], max_files=7))


@query("SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.ts' AS path, sha256(CASE WHEN n_nationkey % 3 = 0 THEN 'export function f' || n_nationkey || '() { throw new E' || n_nationkey || '(); }' ELSE 'export function f' || n_nationkey || '() { return ' || n_nationkey || '; }' END || chr(10)) AS content_hash, n_nationkey % 7 <> 1 AS readable FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 1 UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.ts', sha256(from_hex('FFFE')), false FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 = 1")
def scan_contents(spark, d):
    """Contents of files by tasks; files that aren't UTF-8 are rows without content."""
    from ..sources.scan import list_sources, read_sources

    root = _tree(spark, d)
    files = list_sources([root])
    for p in files:
        if int(os.path.basename(p)[1:-3]) % 7 == 1:
            with open(p, "wb") as f:
                f.write(b"\xff\xfe")
    rows = read_sources(spark, files)
    return rows.select(F.substring_index("path", "/", -2).alias("path"), F.when(F.col("content").isNull(), F.sha2(F.unhex(F.lit("FFFE")), 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.col("content").isNotNull().alias("readable"))


@query(f"SELECT 'fixed' AS what, CAST(count(*) AS VARCHAR) AS value FROM nation WHERE {_BAD} UNION ALL SELECT 'missing ' || 'f' || n_nationkey, 'E' || n_nationkey FROM nation WHERE {_BAD} UNION ALL SELECT s.what, s.value FROM (VALUES ('check', '1'), ('check again', '0'), ('format', '2'), ('unreadable', '2'), ('empty', '0'), ('reused', 'true')) s(what, value)")
def whole_runs(spark, d):
    """Runs over a tree on disk: findings in order, files fixed, exit statuses, a second run from the cache."""
    from ..api import Analysis, Options
    from ..cli import main

    root = _tree(spark, d)

    def status(*args: str) -> str:
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            return str(main(list(args), spark))

    options = Options(types="exact", cross_file=False, cache_dir=f"{root}/.cache")
    found = Analysis(spark, [root], options=options)
    out = [(f"missing {r.function}", r.name) for r in found.missing.select("function", "name").collect()]
    again = Analysis(spark, [root], options=options)
    n = again.missing.count()
    out += [("reused", str(again.reused and n == len(out)).lower()), ("check", status("check", root, "--types", "exact")), ("format", status("check", root, "-f", "xml")), ("empty", status("check", root, "-e", "**"))]
    out += [("fixed", str(Analysis(spark, [root], options=Options(types="exact", cross_file=False)).fix())), ("check again", status("check", root, "--types", "exact"))]
    with open(f"{root}/r0/bad.ts", "wb") as f:
        f.write(b"\xff")
    out.append(("unreadable", status("check", root)))
    return spark.createDataFrame(out, "what string, value string")
