"""Conversation rows as the operators on conversations read them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(convs: DataFrame, blank: str = "") -> DataFrame:
    """``conv_id, turn, role, text``; a null role or text reads as ``blank``. Ids and turns are whole numbers."""
    return convs.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(blank)).alias("role"),
        F.coalesce("text", F.lit(blank)).alias("text"),
    )


def decimal(column: str, missing: str = "") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def streamed(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple]:
    """The rows of a sorted partition one by one, as tuples of ``columns``."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``most`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
