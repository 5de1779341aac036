import math

import pytest
from pyspark.sql import functions as F

from tests import brute
from urnstat.games import G5
from urnstat.operators import features, filters, order
from urnstat.plans import pipeline

NUMBERS = [1, 15, 30, 45]


@pytest.fixture(scope="module")
def rows():
    return brute.make_rows(400)


def as_map(df, *names):
    return {(r.series, r.seq): tuple(r[n] for n in names) for r in df.collect()}


def test_with_seq_counts_every_series_from_zero(draws_of, rows):
    got = {r.draw_id: r.seq for r in order.with_seq(draws_of(rows)).collect()}
    want = {row[1]: i for ordered in brute.by_series(rows).values() for i, row in enumerate(ordered)}
    assert got == want


@pytest.mark.parametrize("partitions", [1, 8, 31])
def test_with_seq_does_not_depend_on_layout(spark, draws_of, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.draw_id: r.seq for r in order.with_seq(draws_of(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    want = {row[1]: i for ordered in brute.by_series(rows).values() for i, row in enumerate(ordered)}
    assert got == want


def test_with_seq_keeps_draws_without_series(draws_of):
    df = draws_of([(None, i, None, [1, 2, 3, 4, 5], 6) for i in range(5)] + [("a", 9, None, [1, 2, 3, 4, 5], 6)])
    got = sorted((r.series or "", r.seq) for r in order.with_seq(df).collect())
    assert got == [("", 0), ("", 1), ("", 2), ("", 3), ("", 4), ("a", 0)]


@pytest.mark.parametrize("direction", ["past", "file"])
@pytest.mark.parametrize("block_rows", [9, 16, 64, 1024])
def test_look_back_against_plain_python(draws_of, rows, direction, block_rows):
    layout = {"direction": direction, "block_rows": block_rows}
    df = order.with_seq(draws_of(rows))
    df = order.trend_table(order.hit_rate(order.prev_common(df, **layout), **layout), NUMBERS, **layout)
    names = ["prev_common_count", "hit_rate_last_5", *[f"frequency_{n}" for n in NUMBERS]]
    got, want = as_map(df, *names), brute.look_back(rows, NUMBERS, direction)
    assert got.keys() == want.keys()
    for key in want:
        for a, b in zip(got[key], want[key]):
            assert a == b or math.isclose(a, b)


def test_first_rows(draws_of):
    rows = [("s", i, f"2020-01-{i + 1:02d}", [1, 2, 3, 4, 5 + i], 9) for i in range(10)]
    df = order.trend_table(order.history_features(order.with_seq(draws_of(rows))), [1, 9, 50])
    got = as_map(df, "prev_common_count", "hit_rate_last_5", "frequency_1", "frequency_9", "frequency_50")
    assert got["s", 0] == (0, 0.0, None, None, None)
    assert got["s", 1] == (4, 0.8, None, None, None)
    assert got["s", 8][2:] == (None, None, None)
    assert got["s", 9][2:] == (10.0, 10.0, 0.0)


def test_first_row_without_ansi(spark, draws_of, rows):
    df = order.with_seq(draws_of(rows))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        first = order.history_features(df).where("seq = 0").collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert {(r.prev_common_count, r.hit_rate_last_5) for r in first} == {(0, 0.0)}


def test_rolling_is_the_long_form_of_the_trend(draws_of, rows):
    df = order.with_seq(draws_of(rows))
    long = {(r.series, r.seq, r.number): r.frequency for r in order.rolling_frequency(df, NUMBERS).collect()}
    wide = as_map(order.trend_table(df, NUMBERS), *[f"frequency_{n}" for n in NUMBERS])
    assert long == {(*key, n): v for key, values in wide.items() for n, v in zip(NUMBERS, values)}


def test_blocks_must_reach(draws_of, rows):
    with pytest.raises(ValueError):
        order.hit_rate(order.with_seq(draws_of(rows)), block_rows=4)


def test_recent_calculated_needs_only_the_tail(draws_of, rows):
    dated = [r for r in rows if r[2]]
    names = ["prev_common_count", "hit_rate_last_5", "mean", "std", "avg_gap_between_numbers"]
    tail = {r.draw_id: tuple(r[n] for n in names) for r in filters.recent_calculated(draws_of(dated), 40).collect()}
    full = filters.recent(pipeline.calculate(draws_of(dated)), 40)
    assert tail == {r.draw_id: tuple(r[n] for n in names) for r in full.collect()}


def test_scoring_row_and_join(draws_of, rows):
    df = pipeline.calculate(draws_of(rows))
    latest = {r.series: r.seq for r in order.scoring_row(df).collect()}
    oldest = {r.series: r.seq for r in order.scoring_row(df, "oldest").collect()}
    assert latest == {s: len(o) - 1 for s, o in brute.by_series(rows).items()}
    assert set(oldest.values()) == {0}
    left, right = df.select("series", "seq", "draw_id"), df.select("series", "seq", "mean")
    assert order.join_by_seq(left, right).count() == len(rows)


@pytest.mark.parametrize("kind,size", [(12, 12), (13, 13), (14, 14)])
def test_feature_matrix(draws_of, rows, kind, size):
    df = pipeline.calculate(draws_of(rows))
    matrix = features.feature_matrix(df, kind)
    assert len(matrix.columns) == 2 + size + 6 and matrix.count() == len(rows)
    assert dict(matrix.dtypes).get("has_consecutive", "int") == "int"


def test_row_invariants(draws_of, rows):
    df = pipeline.calculate(draws_of(rows))
    wrong = df.where(
        (F.col("even_count") + F.col("odd_count") != G5.slots)
        | (F.col("low_range_count") + F.col("high_range_count") != G5.slots)
        | (F.col("max") - F.col("min") != F.col("range"))
    )
    assert wrong.isEmpty()


def test_date_filter(draws_of, rows):
    df = draws_of(rows)
    got = sorted(r.draw_id for r in filters.filter_dates(df, "2020-03-01", "2020-03-15").collect())
    assert got == sorted(r[1] for r in rows if r[2] and "2020-03-01" <= r[2] <= "2020-03-15")
    with pytest.raises(ValueError, match="YYYY-MM-DD"):
        filters.filter_dates(df, "March", "2020-03-15")
    with pytest.raises(ValueError, match="no draws"):
        filters.filter_dates(df, "1990-01-01", "1990-01-02", require=True)


def test_recent_filter(draws_of, rows):
    df = draws_of(rows)
    with pytest.raises(ValueError):
        filters.filter_recent(df, 0)
    assert filters.filter_recent(df, 10**6).count() == len(rows)
    got = {}
    for r in filters.filter_recent(df, 7).collect():
        got.setdefault(r.series, set()).add(r.draw_id)
    assert got == {s: {r[1] for r in ordered[-7:]} for s, ordered in brute.by_series(rows).items()}


def test_small_series_are_refused(draws_of):
    rows = [("big", i, None, [1, 2, 3, 4, 5], 6) for i in range(10)]
    rows += [("small", 100 + i, None, [1, 2, 3, 4, 5], 6) for i in range(9)]
    assert {r.series for r in filters.require_rows(draws_of(rows)).collect()} == {"big"}
    with pytest.raises(ValueError, match="at least 10"):
        pipeline.train_on_slice(draws_of(rows[10:]))


def test_date_range_counts_undated_rows(draws_of):
    df = draws_of([("s", 1, None, [1, 2, 3, 4, 5], 6), ("s", 2, "2020-01-02", [1, 2, 3, 4, 5], 6)])
    row = filters.date_range_info(df).first()
    assert (row.earliest.isoformat(), row.latest.isoformat(), row.total_draws) == ("2020-01-02", "2020-01-02", 2)
    assert filters.drop_undated(df).count() == 1
