"""Per-draw features: no neighbours needed, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnstat.functions import balls as B
from urnstat.functions import text
from urnstat.games import G5, GameSpec

# The model inputs, in the order the feature sets name them.
BASE_FEATURES = [
    "mean",
    "median",
    "std",
    "min",
    "max",
    "range",
    "sum_without_bonus",
    "even_count",
    "odd_count",
    "low_range_count",
    "high_range_count",
    "prev_common_count",
]
FEATURE_SETS = {
    12: BASE_FEATURES,
    13: [*BASE_FEATURES, "has_consecutive"],
    14: [*BASE_FEATURES, "hit_rate_last_5", "avg_gap_between_numbers"],
}


def feature_columns(kind: int = 14) -> list[str]:
    return list(FEATURE_SETS[kind])


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("_ordered", F.sort_array("balls"))


def row_stats(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Mean, median, population std, extremes, range and sums of the mains."""
    balls, ordered = F.col("balls"), F.col("_ordered")
    low, high = B.slot(ordered, 0), B.slot(ordered, spec.slots - 1)
    return (
        _ordered(df)
        .withColumns(
            {
                "mean": B.mean(balls, spec),
                "median": B.median(ordered, spec),
                "std": B.population_std(balls, spec),
                "min": low,
                "max": high,
                "range": high - low,
                "sum_without_bonus": B.ball_sum(balls, spec),
                "sum_with_bonus": B.ball_sum(balls, spec) + F.col("bonus"),
            }
        )
        .drop("_ordered")
    )


def parity_counts(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    even = B.even_count(F.col("balls"), spec)
    return df.withColumns({"even_count": even, "odd_count": F.lit(spec.slots) - even})


def range_counts(df: DataFrame, spec: GameSpec = G5, cut: int | None = None) -> DataFrame:
    low = B.low_count(F.col("balls"), spec, cut)
    return df.withColumns({"low_range_count": low, "high_range_count": F.lit(spec.slots) - low})


def has_consecutive(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    return _ordered(df).withColumn("has_consecutive", B.has_consecutive(F.col("_ordered"), spec)).drop("_ordered")


def avg_gap(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    gap = B.average_gap(F.col("_ordered"), spec)
    return _ordered(df).withColumn("avg_gap_between_numbers", gap).drop("_ordered")


def row_features(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """All features that need only the draw itself."""
    for step in (row_stats, parity_counts, range_counts, has_consecutive, avg_gap):
        df = step(df, spec)
    return df


def indicator(number: int):
    """Is ``number`` among the mains or the bonus, as 0/1."""
    return (F.array_contains("balls", number) | (F.col("bonus") == number)).cast("int")


def indicators(df: DataFrame, numbers: Sequence[int]) -> DataFrame:
    return df.withColumns({f"number_{n}": indicator(n) for n in numbers})


def pattern_table(df: DataFrame, spec: GameSpec = G5, keys: Sequence[str] = ("series", "draw_id")) -> DataFrame:
    """Counts, sum and the consecutive flag as an integer, one row per draw."""
    df = has_consecutive(range_counts(parity_counts(df, spec), spec), spec)
    return df.select(
        *keys,
        "even_count",
        "odd_count",
        "low_range_count",
        "high_range_count",
        B.ball_sum(F.col("balls"), spec).alias("sum_without_bonus"),
        F.col("has_consecutive").cast("int").alias("has_consecutive"),
    )


def explode_slots(df: DataFrame, spec: GameSpec = G5, keys: Sequence[str] = ("series", "draw_id"), bonus: bool = True) -> DataFrame:
    """One row per slot: mains are slots 1..k in ball order, the bonus is k + 1."""
    cells = F.concat(F.slice("balls", 1, spec.slots), F.array("bonus")) if bonus else F.slice("balls", 1, spec.slots)
    return df.select(*keys, F.posexplode(cells).alias("_pos", "number")).select(
        *keys, (F.col("_pos") + 1).alias("slot"), "number"
    )


def format_prediction(df: DataFrame, spec: GameSpec = G5, keys: Sequence[str] = ("cand_id",)) -> DataFrame:
    """Numbers as text, the consecutive flag as Yes/No."""
    df = has_consecutive(df, spec)
    return df.select(
        *keys,
        F.array_join(F.transform("balls", lambda b: b.cast("string")), ", ").alias("main_numbers"),
        F.col("bonus").cast("string").alias("bonus_number"),
        text.yes_no(F.col("has_consecutive")).alias("has_consecutive"),
    )


def feature_matrix(df: DataFrame, kind: int = 14, spec: GameSpec = G5, keys: Sequence[str] = ("series", "draw_id")) -> DataFrame:
    """Model inputs and one target per slot, before they become vectors."""
    names = feature_columns(kind)
    require_columns(df, names)
    inputs = [F.col(n).cast("int").alias(n) if n == "has_consecutive" else F.col(n) for n in names]
    return df.select(*keys, *inputs, *B.wide(F.col("balls"), spec), F.col("bonus"))
