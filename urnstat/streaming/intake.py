"""Streaming intake: files of typed-in draws land, checked draws join the history."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from urnstat.games import G5, GameSpec
from urnstat.operators import frequency as freq
from urnstat.operators import quality
from urnstat.plans.pipeline import Paths, extend, typed
from urnstat.sources import store

NEW_DRAWS = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("draw_id", T.LongType()),
        T.StructField("draw_date_raw", T.StringType()),
        T.StructField("balls", T.ArrayType(T.IntegerType())),
        T.StructField("bonus", T.IntegerType()),
        T.StructField("jackpot", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)


def read_landing(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(NEW_DRAWS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


# Without another trigger a stream takes what has landed and ends.
ONCE = {"availableNow": True}


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint, the same after every restart."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_intake(
    stream: DataFrame, paths: Paths, checkpoint: str, spec: GameSpec = G5, trigger: dict = ONCE
) -> StreamingQuery:
    """Append checked draws to the history and the others to the rejects, and bring
    the calculated and frequency tables up to date.

    Each batch of each stream owns one directory per table and overwrites it, so a
    batch that runs again after a failure leaves no doubles, and another stream, or
    the same one with a new checkpoint, replaces nothing.
    """
    checked = quality.validate_draws(stream, spec)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"stream-{query_id(spark, checkpoint)}-{batch_id}"
        batch.persist()
        try:
            store.append_draws(paths.history, typed(batch), batch=name)
            store.write_batch(quality.rejected(batch), paths.rejects, name)
        finally:
            batch.unpersist()
        extend(spark, paths, spec, changed=name)

    return (
        checked.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def running_frequency(stream: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Frequency of all accepted numbers so far: one state row per number."""
    return freq.frequency(quality.accepted(quality.validate_draws(stream, spec)), spec)


def start_frequency(
    stream: DataFrame, path: str, checkpoint: str, spec: GameSpec = G5, trigger: dict = ONCE
) -> StreamingQuery:
    """Keep the running frequency tables at ``path``, one version per stream and batch."""

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        name = f"{path}/query={query_id(batch.sparkSession, checkpoint)}/batch={batch_id}"
        batch.coalesce(1).withColumn("written", F.current_timestamp()).write.mode("overwrite").parquet(name)

    return (
        running_frequency(stream, spec)
        .writeStream.outputMode("complete")
        .foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def latest_frequency(spark: SparkSession, path: str) -> DataFrame:
    """The version written last by any ``start_frequency`` at this path."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max(F.struct("written", "query", "batch"))).scalar()
    return versions.where(F.struct("written", "query", "batch") == newest).drop("written", "query", "batch")
