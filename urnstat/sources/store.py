"""Stored tables: load, write, append."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urnstat.functions import balls as B
from urnstat.games import G5, GameSpec
from urnstat.sources.raw import DRAWS


def load_draws(spark: SparkSession, path: str, schema: T.StructType | None = DRAWS, fmt: str = "parquet") -> DataFrame:
    """A stored clean or calculated table, with a given schema instead of a guess.

    Pass ``schema=None`` for parquet that describes itself.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return reader.format(fmt).load(path)


def _flat(df: DataFrame, spec: GameSpec) -> DataFrame:
    """CSV has no arrays: the slots become columns b1, b2, …"""
    cols = []
    for name in df.columns:
        cols += B.wide(F.col(name), spec) if name == "balls" else [F.col(name)]
    return df.select(*cols)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", spec: GameSpec = G5, mode: str = "overwrite") -> None:
    """Clean draws with typed columns; CSV gets a header and one column per slot."""
    if fmt == "csv":
        _flat(df, spec).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).partitionBy("series").format(fmt).save(path)


def write_calculated(df: DataFrame, path: str, fmt: str = "parquet", spec: GameSpec = G5, mode: str = "overwrite") -> None:
    """Draws with their feature columns, in the same layouts."""
    write_clean(df, path, fmt, spec, mode)


def write_frequency(df: DataFrame, path: str, order: str = "number") -> None:
    """One CSV with header, by number or from high to low.

    At most one row per number of a game, so a single file is right.
    """
    keys = {"number": [F.col("number")], "high_low": [F.desc("frequency"), F.col("number")]}[order]
    df.coalesce(1).sortWithinPartitions(*keys).select(
        F.col("number").alias("Number"), F.col("frequency").alias("Frequency")
    ).write.mode("overwrite").option("header", True).csv(path)


def write_prediction(prediction: DataFrame, likelihood: DataFrame, run_date: dt.date, path: str) -> None:
    """Chosen numbers and the likelihood table, each partitioned by run date.

    Writing a date again replaces that date only.
    """
    stamp = F.lit(run_date.isoformat())
    # One likelihood row per number at most; predictions keep their partitions.
    for name, part in (("prediction", prediction), ("likelihood", likelihood.coalesce(1))):
        (
            part.withColumn("run_date", stamp)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_date")
            .parquet(f"{path}/{name}")
        )


def append_draws(history_path: str, new: DataFrame, batch: str | None = None) -> None:
    """Add draws to a stored history; newest-first is an order of reading.

    Every append owns one ``batch=`` directory. Running a named batch again
    replaces it, so a retried load leaves no doubles.
    """
    write_batch(new, history_path, batch or uuid.uuid4().hex, "series")


def load_history(spark: SparkSession, history_path: str, batch: str | None = None) -> DataFrame:
    """All batches of a stored history, or one of them."""
    path = history_path if batch is None else f"{history_path}/batch={batch}"
    return load_draws(spark, path).select(*DRAWS.names)


def write_batch(df: DataFrame, path: str, batch: str, *partitions: str) -> None:
    """One batch of a table kept in ``batch=`` directories; replaces itself."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partitions)
    writer.parquet(f"{path}/batch={batch}")


def union_draws(history: DataFrame, new: DataFrame) -> DataFrame:
    """History and new draws as one table, without storing it."""
    return history.unionByName(new.select(*history.columns))
