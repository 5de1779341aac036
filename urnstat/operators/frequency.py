"""Number frequencies, grids and distributions.

Counts combine on the map side, so a shuffle carries at most one row per
number and task, however the draws are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urnstat.games import G5, GameSpec
from urnstat.operators.features import explode_slots

GRID_COLUMNS = 10


def frequency(df: DataFrame, spec: GameSpec = G5, slots: Sequence[int] | None = None) -> DataFrame:
    """Draws per number over the given slots (1-based, bonus = k + 1); all by default."""
    cells = explode_slots(df, spec, keys=())
    if slots is not None:
        cells = cells.where(F.col("slot").isin(list(slots)))
    return cells.groupBy("number").agg(F.count("*").alias("frequency"))


def main_frequency(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    return frequency(df, spec, slots=range(1, spec.slots + 1))


def bonus_frequency(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    return frequency(df, spec, slots=[spec.bonus_slot])


def fill_domain(counts: DataFrame, high: int, value: str = "frequency", missing=0) -> DataFrame:
    """One row per number 1..high; numbers without a row get ``missing``."""
    spark = counts.sparkSession
    domain = spark.range(1, high + 1).select(F.col("id").cast("int").alias("number"))
    known = F.broadcast(counts.where(F.col("number").between(1, high)))
    return domain.join(known, "number", "left").select("number", F.coalesce(value, F.lit(missing)).alias(value))


def _grid(counts: DataFrame, high: int) -> DataFrame:
    place = F.col("number") - 1
    return (
        fill_domain(counts, high)
        .select(
            F.floor(place / GRID_COLUMNS).cast("int").alias("row"),
            F.concat(F.lit("c"), (place % GRID_COLUMNS).cast("string")).alias("col"),
            "frequency",
        )
        .groupBy("row")
        .pivot("col", [f"c{i}" for i in range(GRID_COLUMNS)])
        .agg(F.sum("frequency"))
    )


def main_grid(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Main numbers on rows of ten: number = row * 10 + column + 1."""
    return _grid(main_frequency(df, spec), spec.high)


def bonus_grid(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    return _grid(bonus_frequency(df, spec), spec.bonus_high)


def order_by_number(counts: DataFrame) -> DataFrame:
    return counts.orderBy("number")


def rank_frequency(counts: DataFrame) -> DataFrame:
    """From high to low, the lower number first on ties. At most one row per
    number of the game reaches the window."""
    ranked = Window.orderBy(F.desc("frequency"), "number")
    return counts.withColumn("rank", F.row_number().over(ranked)).orderBy("rank")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency")).orderBy("value")


def share(df: DataFrame, column: str, places: int = 1) -> DataFrame:
    """Rows and percent per value of ``column``; the total is taken over the groups."""
    counts = df.groupBy(column).agg(F.count("*").alias("frequency"))
    total = counts.agg(F.sum("frequency")).scalar()
    return counts.withColumn("percent", F.round(F.col("frequency") * 100.0 / total, places))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the least to the greatest value, the last one closed.

    Bins without rows are kept with 0. When all values are equal the range is
    widened by one half on both sides.
    """
    value = F.col(column)
    edges = df.agg(
        F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    ).scalar()
    flat = F.col("_edges.lo") == F.col("_edges.hi")
    ranged = {
        "_lo": F.when(flat, F.col("_edges.lo") - 0.5).otherwise(F.col("_edges.lo")),
        "_hi": F.when(flat, F.col("_edges.hi") + 0.5).otherwise(F.col("_edges.hi")),
    }
    width = (F.col("_hi") - F.col("_lo")) / bins
    counts = (
        df.where(value.isNotNull())
        .select(value.alias("_x"))
        .withColumn("_edges", edges)
        .withColumns(ranged)
        .groupBy(F.least(F.floor((F.col("_x") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("frequency"))
    )
    slots = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        slots.join(F.broadcast(counts), "bin", "left")
        .withColumn("_edges", edges)
        .withColumns(ranged)
        .select(
            "bin",
            (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
            (F.col("_lo") + (F.col("bin") + 1) * width).alias("right_edge"),
            F.coalesce("frequency", F.lit(0)).alias("frequency"),
        )
    )


def history_profile(df: DataFrame) -> DataFrame:
    """Column summary of a calculated history, one row."""
    return df.agg(
        F.avg("mean").alias("mean"),
        F.avg("median").alias("median"),
        F.avg("std").alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.max("range").alias("range"),
    )
