"""Positions and texts of source files: spans are byte offsets of the UTF-8 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets."""
    return F.decode(F.substring(F.encode(content, "UTF-8"), start + 1, F.greatest(end - start, F.lit(0))), "UTF-8")


def before(content: Column, offset: Column) -> Column:
    return byte_slice(content, F.lit(0), offset)


def line_of(content: Column, offset: Column) -> Column:
    """Line of a byte offset, from 1."""
    return (F.regexp_count(before(content, offset), F.lit("\n")) + 1).cast("int")


def column_of(content: Column, offset: Column) -> Column:
    """Column of a byte offset, from 1, in characters."""
    return (F.length(F.element_at(F.split(before(content, offset), "\n"), -1)) + 1).cast("int")


def preceding_doc(content: Column, offset: Column) -> Column:
    """The doc comment right before a byte offset (from its last ``/**``), or null."""
    text = F.regexp_replace(before(content, offset), r"(?U)\s+$", "")
    found = F.endswith(text, F.lit("*/")) & F.contains(text, F.lit("/**"))
    return F.when(found, F.regexp_extract(text, r"(?s)^.*(/\*\*.*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def thrown_text(snippet: Column, catch_params: Column) -> Column:
    """STRUCT<kind, name> of the text of a throw statement, without a parser: ``new T(..)`` and calls of ``..Error`` are
    named, a catch parameter is a rethrow, all else is unknown."""
    e = F.regexp_replace(F.regexp_extract(snippet, r"(?s)^\s*throw\s+(.*)$", 1), r"\s*;?\s*$", "")
    made = F.regexp_extract(e, rf"(?s)^new\s+({_IDENT})\s*(?:$|\(|<)", 1)
    called = F.regexp_extract(e, rf"(?s)^({_IDENT})\s*\(.*\)$", 1)
    name = F.when(made != "", made).when(F.endswith(called, F.lit("Error")), called)
    is_param = F.array_contains(catch_params, e)
    return F.struct(F.when(name.isNotNull(), F.lit("named")).when(is_param, F.lit("rethrow")).otherwise(F.lit("unknown")).alias("kind"), F.when(name.isNotNull(), name).when(is_param, e).alias("name"))
