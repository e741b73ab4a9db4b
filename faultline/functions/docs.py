"""``@throws`` declarations of doc comments, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM = r"(?U)^(.*?)from \s*(\S+):([^:\s]+)(?:\s|$)"


def trim(x: Column) -> Column:
    """Without white space (of any script) at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def without_end(x: Column) -> Column:
    """Without comment terminators, then stars, then white space at the end."""
    return trim(F.regexp_replace(F.regexp_replace(x, r"(\*/)+$", ""), r"\*+$", ""))


def tag_line(line: Column) -> Column:
    """What follows ``@throws`` on a comment line; null if the line doesn't begin with it."""
    bare = trim(F.regexp_replace(F.regexp_replace(trim(line), r"^/+", ""), r"^\*+", ""))
    return F.when(F.startswith(bare, F.lit("@throws")), trim(F.substring(bare, F.lit(8), F.length(bare))))


def origin(text: Column) -> Column:
    """STRUCT<description, from_file, from_func> of the text after the type: the first ``from <file>:<function>`` ends the
    description."""
    found = F.regexp_extract(text, _FROM, 2) != ""
    before = trim(F.regexp_extract(text, _FROM, 1))
    return F.struct(
        F.when(found, F.nullif(before, F.lit(""))).otherwise(F.nullif(text, F.lit(""))).alias("description"),
        F.when(found, F.regexp_extract(text, _FROM, 2)).alias("from_file"),
        F.when(found, F.regexp_extract(text, _FROM, 3)).alias("from_func"),
    )


def union_members(content: Column) -> Column:
    """Names of a union type ``A | B``, without empty ones."""
    return F.filter(F.transform(F.split(content, r"\|"), trim), lambda x: x != "")


def declarations(comment: Column) -> Column:
    """ARRAY<STRUCT<type_name, description, from_file, from_func>> in order of the lines; null comment: null.

    ``{A | B}`` declares each member; a brace that isn't closed on its line declares nothing; without braces the first word
    is the type.
    """
    rest = F.filter(F.transform(F.split(comment, r"\r?\n"), tag_line), lambda r: r.isNotNull())

    def of(r: Column) -> Column:
        braced = F.startswith(r, F.lit("{"))
        close = F.instr(r, "}")
        types = F.when(braced, F.when(close > 0, union_members(F.substring(r, F.lit(2), close - 2))).otherwise(F.array().cast("array<string>"))).otherwise(F.filter(F.array(F.regexp_extract(r, r"(?U)^(\S*)", 1)), lambda x: x != ""))
        after = without_end(trim(F.when(braced, F.substring(r, close + 1, F.length(r))).otherwise(F.regexp_extract(r, r"(?U)^\S*\s(.*)$", 1))))
        o = origin(after)
        return F.transform(types, lambda t: F.struct(t.alias("type_name"), o["description"].alias("description"), o["from_file"].alias("from_file"), o["from_func"].alias("from_func")))

    return F.flatten(F.transform(rest, of))
