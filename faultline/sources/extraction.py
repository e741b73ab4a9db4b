"""The parser as a Spark stage: one Python pass over the files, then fact tables by exploding its nested rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.docs import declarations
from ..storage import materialize

_SPAN = "struct<start: int, end: int>"
SCHEMA = f"""path string, content_hash string, error string,
functions array<struct<fn: string, file: string, name: string, start: int, end: int, name_start: int, name_end: int, name_line: int, is_async: boolean, class_name: string, has_body: boolean, comment: string, result: array<string>, params: array<struct<name: string, types: array<string>>>>>,
throws array<struct<fn: string, start: int, end: int, kind: string, name: string, hint: string>>,
calls array<struct<fn: string, callee_name: string, callee_start: int, callee_end: int, start: int, end: int, receiver: string>>,
tries array<struct<fn: string, try_start: int, try_end: int, catch_start: int, catch_end: int, caught_types: array<string>>>,
relations array<struct<child_file: string, child: string, child_span: {_SPAN}, parent: string, parent_span: {_SPAN}, kind: string>>,
signatures array<struct<type_file: string, type_name: string, type_span: {_SPAN}, method_name: string, method_span: {_SPAN}, comment: string, is_abstract: boolean>>,
aliases array<struct<file: string, alias: string, member: string, ordinal: int>>,
imports array<struct<file: string, local: string, imported: string, source: string>>"""
TABLES = ("functions", "throws", "calls", "tries", "relations", "signatures", "aliases", "imports")
#: Files and characters of sources whose rows go on together, and tasks a core: files differ in size.
FILES, CHARACTERS, TASKS = 256, 1 << 20, 4


def spread(files: DataFrame) -> DataFrame:
    """``files`` over all cores by path: the folder or table they come from may be a single task's."""
    spark = files.sparkSession
    return files.repartition(max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")


def extractions(files: DataFrame) -> DataFrame:
    """One row of SCHEMA a file of (path, content, content_hash)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        import pyarrow as pa

        from ..parse.extract import extract

        rows, size = [], 0
        for batch in batches:
            for path, content, digest in zip(*(batch.column(k).to_pylist() for k in range(3))):
                f = extract(path, content or "")
                rows.append({"path": path, "content_hash": digest, "error": "can't be read as UTF-8" if content is None else f.error, **{t: getattr(f, t) for t in TABLES}})
                size += len(content or "")
                if len(rows) >= FILES or size >= CHARACTERS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread(files.select("path", "content", "content_hash")).mapInArrow(run, SCHEMA)


@dataclass
class Program:
    """Fact tables of all files."""

    functions: DataFrame
    declared: DataFrame  # fn, error_type, description, ordinal
    throws: DataFrame
    calls: DataFrame
    tries: DataFrame
    relations: DataFrame
    signatures: DataFrame  # type_name, method_name, declared, ordinal, ..
    aliases: DataFrame
    imports: DataFrame
    errors: DataFrame  # path, error


def program(rows: DataFrame) -> Program:
    """Tables from extraction rows; the parser's output is written once and read by all of them."""
    rows = materialize(rows, "extractions")
    part = lambda t: rows.select(F.inline(t))
    functions = part("functions").withColumn("declared", declarations(F.col("comment")))
    declared = functions.select("fn", F.posexplode("declared").alias("ordinal", "d")).select("fn", F.col("d.type_name").alias("error_type"), F.col("d.description").alias("description"), "ordinal")
    tries = rows.select(F.posexplode("tries").alias("block_no", "t")).select("t.fn", "block_no", "t.try_start", "t.try_end", "t.catch_start", "t.catch_end", "t.caught_types")
    relations = part("relations")
    names = F.transform(declarations(F.col("comment")), lambda d: d["type_name"])
    signatures = part("signatures").withColumn("declared", F.coalesce(names, F.array().cast("array<string>"))).withColumn("ordinal", F.struct("type_file", F.col("method_span.start").alias("start")))
    return Program(functions.drop("declared"), declared, part("throws"), part("calls"), tries, relations, signatures, part("aliases"), part("imports"), rows.where("error is not null").select("path", "error"))
