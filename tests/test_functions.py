import math

import pytest
from pyspark.sql import functions as F

from urnstat.functions import balls as B
from urnstat.functions import chance, text
from urnstat.games import G5, G6, GameSpec
from urnstat.operators import features


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Friday 25 April 2025", "2025-04-25"),
        ("Friday\n25 April 2025", "2025-04-25"),
        ("Tuesday 5 August 2025", "2025-08-05"),
        ("friday 05 august 2025", "2025-08-05"),
        ("soon", None),
        ("25 April 2025", None),
        ("Monday 31 February 1997", None),
        ("Friday 25 Apryl 2025", None),
        ("", None),
        (None, None),
    ],
)
def test_draw_date(spark, raw, want):
    got = one(spark, text.parse_draw_date(F.lit(raw).cast("string")))
    assert (got.isoformat() if got else None) == want


@pytest.mark.parametrize("token,want", [(' "12" ', 12), ("7", 7), ('" 9 "', 9), ("x", None), ("1.5", None), ("", None), ("\t3\n", 3)])
def test_to_number(spark, token, want):
    assert one(spark, text.to_number(F.lit(token))) == want


def test_day_and_year(spark):
    for day in ("25 April", "Friday 25 April", "25 Apr", "April 25"):
        assert one(spark, text.parse_day_and_year(F.lit(day), F.lit("2025"))).isoformat() == "2025-04-25"
    assert one(spark, text.parse_day_and_year(F.lit("Date"), F.lit("Year"))) is None


def test_statistics_of_a_hand_row(draws_of):
    df = features.row_features(draws_of([("s", 1, "2025-04-25", [46, 5, 47, 9, 13], 11)]))
    row = df.first()
    assert (row["mean"], row["median"]) == (24.0, 13.0)
    assert math.isclose(row["std"], math.sqrt(1720 / 5), rel_tol=1e-12)
    assert (row["min"], row["max"], row["range"]) == (5, 47, 42)
    assert (row["sum_without_bonus"], row["sum_with_bonus"]) == (120, 131)
    assert (row["even_count"], row["odd_count"]) == (1, 4)
    assert (row["low_range_count"], row["high_range_count"]) == (3, 2)
    assert row["has_consecutive"] is True
    assert row["avg_gap_between_numbers"] == 10.5


def test_median_of_six(draws_of):
    df = features.row_stats(draws_of([("s", 1, None, [52, 1, 30, 2, 20, 10], 3)]), G6)
    assert df.first()["median"] == 15.0


def test_indicator_counts_the_bonus(draws_of):
    df = draws_of([("s", 1, None, [1, 2, 3, 4, 5], 9)])
    assert features.indicators(df, [1, 9, 10]).select("number_1", "number_9", "number_10").first() == (1, 1, 0)


def test_set_key_ignores_order_and_rejects_strangers(spark):
    def key(balls):
        return one(spark, B.set_key(F.lit(balls), G5))

    assert key([5, 4, 3, 2, 1]) == key([1, 2, 3, 4, 5]) == 0b111110
    assert key([1, 2, 3, 4, 6]) != key([1, 2, 3, 4, 5])
    assert key([1, 2, 3, 4, 63]) is None and key([0, 1, 2, 3, 4]) is None
    assert key([1, 2, 3, 4]) is None and key([1, 2, 3, 4, 5, 6]) is None
    assert key([62, 61, 60, 59, 58]) > 0


def test_uniform_is_stable_and_even(spark):
    df = spark.range(4000).select(chance.uniform(7, F.col("id")).alias("u"))
    again = spark.range(4000).repartition(5).select(chance.uniform(7, F.col("id")).alias("u"))
    assert sorted(r.u for r in df.collect()) == sorted(r.u for r in again.collect())
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < low < high < 1 and abs(mean - 0.5) < 0.02


def test_shuffled_domain_is_a_permutation(spark):
    numbers = one(spark, chance.shuffled_domain(50, 1, F.lit(3)))
    assert sorted(numbers) == list(range(1, 51)) and numbers != sorted(numbers)


def test_required_columns(draws_of):
    df = draws_of([("s", 1, None, [1, 2, 3, 4, 5], 9)])
    with pytest.raises(ValueError, match="nothing"):
        features.require_columns(df, ["balls", "nothing"])


def test_spec_bounds():
    with pytest.raises(ValueError):
        GameSpec("wide", 5, 90, 10)
