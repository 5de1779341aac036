"""Validation of typed-in draws: every failed rule is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urnstat.functions import balls as B
from urnstat.games import G5, GameSpec


# The messages of the rules.
DATE_MISSING = "Draw date is required"
MAIN_RANGE = "Main number {slot} must be between 1 and {high}"
MAIN_REPEATED = "Main numbers must be unique"
BONUS_RANGE = "Bonus number must be between 1 and {high}"
JACKPOT_MISSING = "Jackpot amount is required"
OUTCOME_MISSING = "Outcome is required"


def _blank(name: str) -> Column:
    return F.coalesce(F.length(F.trim(F.regexp_replace(F.col(name), r"\s", " "))), F.lit(0)) == 0


def _outside(value: Column, high: int) -> Column:
    return ~F.coalesce(value.between(1, high), F.lit(False))


def rules(spec: GameSpec = G5) -> list[tuple[Column, str]]:
    """(fails, message) pairs in the order they are reported."""
    balls = F.col("balls")
    distinct = F.coalesce(F.array_size(F.array_distinct(balls)), F.lit(0))
    mains = [
        (_outside(ball, spec.high), MAIN_RANGE.format(slot=i, high=spec.high))
        for i, ball in enumerate(B.slots(balls, spec), 1)
    ]
    return [
        (_blank("draw_date_raw"), DATE_MISSING),
        *mains,
        (distinct != spec.slots, MAIN_REPEATED),
        (_outside(F.col("bonus"), spec.bonus_high), BONUS_RANGE.format(high=spec.bonus_high)),
        (_blank("jackpot"), JACKPOT_MISSING),
        (_blank("outcome"), OUTCOME_MISSING),
    ]


def validate_draws(df: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Add ``errors`` (array of messages) and ``valid``. Works on streams too."""
    messages = F.array(*[F.when(fails, F.lit(message)) for fails, message in rules(spec)])
    checked = df.withColumn("errors", F.array_compact(messages))
    return checked.withColumn("valid", F.size("errors") == 0)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("valid").drop("valid", "errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("valid"))


def reject_counts(checked: DataFrame) -> DataFrame:
    """Rejected draws per message."""
    return (
        rejected(checked)
        .select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count("*").alias("draws"))
    )
