"""Rows that go through Python with a text: all their columns travel as one struct, so that no name can clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_outputs(docs: DataFrame, column: str, keep: list[str], outputs: dict[str, str], run: Callable[[Iterator[pa.Array]], Iterator[list[pa.Array]]]) -> DataFrame:
    """``keep`` columns of docs and ``outputs`` (name: type).  ``run`` gives, for each array of the column, the outputs'."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{column}`").alias("text"))
    kinds = T.StructType.fromDDL(", ".join(f"o{k} {kind}" for k, kind in enumerate(outputs.values())))
    schema = T.StructType([source.schema["row"], *kinds.fields])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def columns() -> Iterator[pa.Array]:
            for batch in given:
                held.append(batch)
                yield batch.column(1)

        for out in run(columns()):
            yield pa.RecordBatch.from_arrays([held.pop().column(0), *out], names=schema.names)

    named = [F.col(f"o{k}").alias(name) for k, name in enumerate(outputs)]
    return source.mapInArrow(batches, schema).select(*[F.col("row").getField(c).alias(c) for c in keep], *named)
