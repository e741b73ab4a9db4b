"""Sinks: text and JSON reports, and rewritten sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.docs import trim
from .functions.text import base_name, before


def entry_text(kind: Column, name: Column, origin_path: Column, origin_func: Column) -> Column:
    """``@throws {T} from file:function``; an unknown error is ``unknown``."""
    shown = F.when(kind == "unknown", F.lit("unknown")).otherwise(F.coalesce(name, F.lit("unknown")))
    return F.format_string("@throws {%s} from %s:%s", shown, base_name(origin_path), origin_func)


def insert_lines(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``files`` (path, content) with ``edits`` (path, line, ordinal, text[, replaces]): lines put before the given line,
    numbered from 0, which itself goes if any of its edits ``replaces`` it.

    Byte-order mark, line ends (CRLF if the file has any) and a missing last newline stay as they are.  Files without
    edits come back unchanged; lines beyond the end are put last.
    """
    if "replaces" not in edits.columns:
        edits = edits.withColumn("replaces", F.lit(False))
    bom = F.lit(chr(0xFEFF))
    has_bom = F.startswith("content", bom)
    body = F.when(has_bom, F.substring("content", F.lit(2), F.length("content"))).otherwise(F.col("content"))
    per = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "ordinal", "text", "replaces"))).alias("ins"))
    rows = files.join(per, "path", "left")
    crlf = F.contains(F.col("body"), F.lit("\r\n"))
    lines = F.split(F.when(F.col("crlf"), F.replace("body", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("body")), "\n", -1)
    rows = rows.withColumn("body", body).withColumn("bom", has_bom).withColumn("crlf", crlf).withColumn("lines", lines)
    n = F.size("lines")
    own = lambda i: F.filter("ins", lambda y: y["line"] == i)
    kept = lambda x, i: F.when(F.exists(own(i), lambda y: y["replaces"]), F.array().cast("array<string>")).otherwise(F.array(x))
    put = F.transform("lines", lambda x, i: F.concat(F.transform(own(i), lambda y: y["text"]), kept(x, i)))
    rest = F.transform(F.filter("ins", lambda y: y["line"] >= n), lambda y: y["text"])
    text = F.concat(F.flatten(put), rest)
    joined = F.when(F.col("crlf"), F.array_join(text, "\r\n")).otherwise(F.array_join(text, "\n"))
    out = F.when(F.col("ins").isNull(), F.col("content")).otherwise(F.concat(F.when(F.col("bom"), bom).otherwise(F.lit("")), joined))
    return rows.select(*[out.alias("content") if c == "content" else F.col(c) for c in files.columns])


def fixes(files: DataFrame, functions: DataFrame, missing: DataFrame) -> DataFrame:
    """Edits that declare ``missing`` (fn, kind, name, origin_file, origin_name, ordinal) above ``functions`` (fn, file,
    start), one entry for each row.

    A function with a doc comment right above (blank lines between are skipped) gets its entries at the comment's end:
    the last line is replaced by what stands before its terminator, the entries, and a terminator.  Another gets a new
    comment with the function line's indentation.
    """
    w = Window.partitionBy("fn").orderBy("ordinal", "name", "origin_file", "origin_name")
    e = missing.withColumn("entry", entry_text(F.col("kind"), F.col("name"), F.col("origin_file"), F.col("origin_name"))).withColumn("k", F.row_number().over(w))
    per = e.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("k", "entry"))).alias("entries"))
    f = functions.select("fn", "file", "start").join(per, "fn").join(files.select(F.col("path").alias("file"), "content"), "file")
    head = before(F.col("content"), F.col("start"))
    text = F.replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), F.lit(chr(0xFEFF)), F.lit(""))
    f = f.withColumn("lines", F.split(text, "\n", -1)).withColumn("at", F.regexp_count(head, F.lit("\n")).cast("int"))
    index = lambda arr, cond: F.array_max(F.filter(F.transform(arr, lambda x, i: F.when(cond(x), i)), lambda i: i.isNotNull()))
    f = f.withColumn("last", index(F.slice("lines", 1, F.col("at")), lambda x: trim(x) != "")).withColumn("last_line", F.when(F.col("last").isNotNull(), F.get("lines", F.col("last"))))
    f = f.withColumn("open", index(F.slice("lines", 1, F.coalesce(F.col("last"), F.lit(-1)) + 1), lambda x: F.startswith(trim(x), F.lit("/*"))))
    is_doc = F.endswith(trim(F.col("last_line")), F.lit("*/")) & F.col("open").isNotNull() & F.startswith(trim(F.get("lines", F.col("open"))), F.lit("/**"))
    f = f.withColumn("doc", F.coalesce(is_doc, F.lit(False)))
    pad = lambda x: F.regexp_extract(x, r"(?U)^(\s*)", 1)
    body = lambda p: F.transform("entries", lambda x: F.concat(p, F.lit(" * "), x["entry"]))
    indent, end = pad(F.get("lines", F.col("at"))), pad(F.col("last_line"))
    new = F.concat(F.array(F.concat(indent, F.lit("/**"))), body(indent), F.array(F.concat(indent, F.lit(" */"))))
    stays = F.regexp_replace(F.regexp_extract(F.col("last_line"), r"(?s)^(.*)\*/", 1), r"(?U)\s+$", "")
    keep = F.when((stays == "") | (stays == "*"), F.array().cast("array<string>")).otherwise(F.array(stays))
    longer = F.concat(keep, body(end), F.array(F.concat(end, F.lit(" */"))))
    f = f.withColumn("put", F.when(F.col("doc"), longer).otherwise(new)).withColumn("line", F.when(F.col("doc"), F.col("last")).otherwise(F.col("at")))
    return f.select(F.col("file").alias("path"), "line", "doc", "start", F.posexplode("put").alias("pos", "text")).select("path", "line", (F.col("start").cast("long") * 100000 + F.col("pos")).alias("ordinal"), "text", F.col("doc").alias("replaces"))


def help_list(labels: list[str]) -> str:
    """Labels with runs of equal neighbours as one."""
    return ", ".join(x for k, x in enumerate(labels) if k == 0 or labels[k - 1] != x)


def text_report(diagnostics: list[dict], violations: list[dict], files_checked: int) -> str:
    """``diagnostics``: file, function, missing [kind, name, start, end]; ``violations``: file, method, errors, parent_type,
    parent_method, parent_declared."""
    if not diagnostics and not violations:
        return f"No issues found in {files_checked} files\n"
    bar, out = "   |", []
    for d in diagnostics:
        out += ["error: missing @throws declaration", f"  --> {d['file']}:{d['function']}", bar]
        out += [f"{bar} {m['name'] or 'Unknown'} propagates from Span {{ start: {m['start']}, end: {m['end']} }}" for m in _shown(d["missing"])]
        out += [bar, f"   = help: add @throws {{{help_list([m['name'] or 'unknown' for m in _shown(d['missing'])])}}} to function {d['function']}", ""]
    for v in violations:
        out += ["error: LSP violation - throws not declared in parent", f"  --> {v['file']}:{v['method']}", bar]
        out += [f"{bar} {x or 'Unknown'} is not declared in {v['parent_type']}.{v['parent_method']}" for x in v["errors"]]
        parent = "@throws {" + ", ".join(v["parent_declared"]) + "}" if v["parent_declared"] else "(no throws allowed)"
        out += [bar, f"   = parent declares: {parent}", "   = help: catch it in the implementation, or declare it in the parent", ""]
    errors = sum(len(d["missing"]) for d in diagnostics)
    return "\n".join([*out, f"Found {errors} errors, {len(violations)} LSP violations in {files_checked} files"]) + "\n"


def _shown(missing: list[dict]) -> list[dict]:
    """Only named errors show a name."""
    return [{**m, "name": m["name"] if m["kind"] == "named" else None} for m in missing]


def json_report(diagnostics: list[dict], violations: list[dict], files_checked: int) -> str:
    """The same findings as JSON.  ``origin_line`` is the byte offset of the throw and ``origin_file`` is empty, as readers
    of this format expect; ``true_file`` and ``true_line`` say where it is."""
    shown = [
        {"file": d["file"], "function": d["function"], "missing_throws": [{"error_type": m["name"] or "Unknown", "origin_file": "", "origin_line": m["start"], "true_file": m.get("origin_file"), "true_line": m.get("origin_line")} for m in _shown(d["missing"])]}
        for d in diagnostics
    ]
    bad = [{"file": v["file"], "class": "", "method": v["method"], "illegal_throws": [x or "Unknown" for x in v["errors"]], "parent_type": v["parent_type"], "parent_declared_throws": v["parent_declared"]} for v in violations]
    errors = sum(len(d["missing"]) for d in diagnostics)
    return json.dumps({"diagnostics": shown, "lsp_violations": bad, "summary": {"errors": errors, "lsp_violations": len(violations), "files_checked": files_checked}}, indent=2) + "\n"
