"""Frequencies, quality rules and matching on small fixtures."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import brute
from urnstat.functions import ranks
from urnstat.games import G5, G6, GameSpec
from urnstat.operators import features, matching, quality
from urnstat.operators import frequency as freq


@pytest.fixture(scope="module")
def rows():
    return brute.make_rows(300, seed=5)


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_frequency(draws_of, rows):
    df = draws_of(rows)
    want = Counter(n for r in rows for n in [*r[3], r[4]])
    assert pairs(freq.frequency(df)) == want
    want = Counter(n for r in rows for n in [*r[3][1:], r[4]])
    assert pairs(freq.frequency(df, slots=[2, 3, 4, 5, 6])) == want


def test_grid_adds_up(draws_of, rows):
    grid = [list(r)[1:] for r in freq.main_grid(draws_of(rows)).orderBy("row").collect()]
    want = Counter(n for r in rows for n in r[3])
    assert grid == [[want[i * 10 + j + 1] for j in range(10)] for i in range(5)]
    assert sum(map(sum, grid)) == len(rows) * 5
    assert sum(sum(list(r)[1:]) for r in freq.bonus_grid(draws_of(rows)).collect()) == len(rows)


def test_ties_rank_the_lower_number_first(spark):
    counts = spark.createDataFrame([(7, 3), (2, 3), (9, 5)], "number int, frequency long")
    assert [r.number for r in freq.rank_frequency(counts).collect()] == [9, 2, 7]


def test_domain_is_filled_and_bounded(spark):
    counts = spark.createDataFrame([(2, 3), (99, 5)], "number int, frequency long")
    assert pairs(freq.fill_domain(counts, 4)) == {1: 0, 2: 3, 3: 0, 4: 0}


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(41)] + [(None,)], "x double")
    bins = freq.histogram(df, "x").orderBy("bin").collect()
    assert [b.frequency for b in bins] == [2] * 19 + [3]
    assert (bins[0].left_edge, bins[-1].right_edge) == (0.0, 40.0)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(7,)] * 5, "x int")
    bins = freq.histogram(df, "x").where("frequency > 0").collect()
    assert [(b.bin, b.frequency) for b in bins] == [(10, 5)]


def test_share(spark):
    df = spark.createDataFrame([(True,)] * 2 + [(False,)], "flag boolean")
    assert {r.flag: (r.frequency, r.percent) for r in freq.share(df, "flag").collect()} == {True: (2, 66.7), False: (1, 33.3)}


def test_distribution_is_ordered(draws_of, rows):
    df = freq.distribution(features.pattern_table(draws_of(rows)), "even_count")
    want = Counter(sum(n % 2 == 0 for n in r[3]) for r in rows)
    assert [tuple(r) for r in df.collect()] == sorted(want.items())


GOOD = ("s", 1, "Friday 25 April 2025", [1, 2, 3, 4, 5], 6, "R1", "Roll")
TYPED = "series string, draw_id long, draw_date_raw string, balls array<int>, bonus int, jackpot string, outcome string"


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, []),
        ({2: " \n"}, ["Draw date is required"]),
        ({2: None}, ["Draw date is required"]),
        ({3: [0, 2, 3, 4, 51]}, ["Main number 1 must be between 1 and 50", "Main number 5 must be between 1 and 50"]),
        ({3: [1, None, 3, 4, 5]}, ["Main number 2 must be between 1 and 50"]),
        ({3: [1, 1, 3, 4, 5]}, ["Main numbers must be unique"]),
        ({4: 21}, ["Bonus number must be between 1 and 20"]),
        ({4: None}, ["Bonus number must be between 1 and 20"]),
        ({5: ""}, ["Jackpot amount is required"]),
        ({6: None}, ["Outcome is required"]),
        ({2: "", 4: 0, 5: " ", 6: ""}, ["Draw date is required", "Bonus number must be between 1 and 20", "Jackpot amount is required", "Outcome is required"]),
    ],
)
def test_every_failed_rule_is_reported(spark, change, want):
    row = tuple(change.get(i, v) for i, v in enumerate(GOOD))
    checked = quality.validate_draws(spark.createDataFrame([row], TYPED)).first()
    assert checked.errors == want and checked.valid == (not want)


def test_matching(spark, draws_of, rows):
    history = draws_of(rows)
    sets = {frozenset(r[3]) for r in rows}
    cands = [(i, r[3][::-1] if i % 2 else [(n % 50) + 1 for n in r[3]], r[4]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(cands, "cand_id long, balls array<int>, bonus int")
    want = {i: frozenset(b) in sets for i, b, _ in cands}
    assert pairs(matching.already_drawn(df, history).select("cand_id", "drawn")) == want
    kept = {r.cand_id for r in matching.exclude_drawn(df, history).collect()}
    assert kept == {i for i, hit in want.items() if not hit}


def test_avoid_drawn(spark, draws_of, rows):
    history = draws_of(rows)
    sets = {frozenset(r[3]) for r in rows}
    preds = spark.createDataFrame([(1, rows[0][3], 3), (2, [1, 2, 3, 4, 5], 3)], "pred_id long, balls array<int>, bonus int")
    out = {r.pred_id: r for r in matching.avoid_drawn(preds, history).collect()}
    assert out[1].replaced and frozenset(out[1].balls) not in sets
    assert out[1].balls == sorted(set(out[1].balls)) and len(out[1].balls) == 5
    assert not out[2].replaced and out[2].balls == [1, 2, 3, 4, 5]


SIX = GameSpec("six", slots=3, high=6, bonus_high=2)


@pytest.mark.parametrize("spec", [SIX, GameSpec("pairs", slots=2, high=40, bonus_high=2), G6])
def test_places_of_sets(spark, spec):
    legal = ranks.legal_sets(spec)
    places = range(legal) if legal < 1000 else [0, 1, 32767, 32768, legal // 2, legal - 1]
    df = spark.createDataFrame([(p,) for p in places], "p bigint")
    rows = df.withColumn("balls", ranks.set_at(F.col("p"), spec)).withColumn("again", ranks.set_rank(F.reverse("balls"), spec)).collect()
    assert all(r.again == r.p and r.balls == sorted(set(r.balls)) and len(r.balls) == spec.slots for r in rows)
    assert len({tuple(r.balls) for r in rows}) == len(rows) and all(1 <= n <= spec.high for r in rows for n in r.balls)


def test_places_of_odd_sets(spark):
    sets = [list(s) for s in itertools.product(range(1, 7), repeat=3)] + [[1, 2], [1, 2, 7], [0, 1, 2], None, [1, 2, 3, 4]]
    df = spark.createDataFrame([(s,) for s in sets], "balls array<int>")
    places = {tuple(r.balls or ()): r.p for r in df.withColumn("p", ranks.set_rank(F.col("balls"), SIX)).collect()}
    assert all((places[tuple(s)] is None) == (len(s) != 3 or not set(s) <= set(range(1, 7))) for s in sets if s)
    known = {frozenset(s): places[tuple(s)] for s in sets[:216]}
    assert len(set(known.values())) == len(known) == 6 + 15 + 20 and places[()] is None
    assert all((places[tuple(s)] < ranks.legal_sets(SIX)) == (len(set(s)) == 3) for s in sets[:216])


@pytest.mark.parametrize("left", [0, 1, 3, 20])
def test_every_prediction_gets_a_free_set(spark, left):
    """Of the twenty sets of the game ``left`` are free, and all predictions were drawn."""
    sets = list(itertools.combinations(range(1, 7), 3))
    random.Random(left).shuffle(sets)
    drawn, free = sets[left:], set(sets[:left])
    history = spark.createDataFrame([(list(s),) for s in drawn] + [([1, 1, 2],)], "balls array<int>")
    preds = spark.createDataFrame([(i, list(s)[::-1], "x") for i, s in enumerate(drawn * 5)] + [(-1, [2, 1, 1], "y")], "pred_id long, balls array<int>, replaced string")
    out = matching.avoid_drawn(preds, history, SIX).collect()
    assert len(out) == len(drawn) * 5 + 1
    for r in out:
        assert (r.replaced, r.exhausted) == (left > 0, left == 0)
        assert (tuple(r.balls) in free) if left else r.balls is None


def test_matching_needs_no_shuffle_of_candidates(spark, draws_of, rows):
    history = draws_of(rows)
    preds = spark.createDataFrame([(1, rows[0][3], 3)], "pred_id long, balls array<int>, bonus int")
    for df in (matching.already_drawn(preds, history), matching.exclude_drawn(preds, history), matching.avoid_drawn(preds, history)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Join" not in text
    text = matching.dedupe_combos(preds.withColumnRenamed("pred_id", "cand_id"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_dedupe_keeps_the_lowest_id(spark):
    combos = [(4, [1, 2, 3, 4, 5], 6), (2, [5, 4, 3, 2, 1], 6), (3, [1, 2, 3, 4, 5], 7), (9, [70, 2, 3, 4, 5], 7), (8, [70, 2, 3, 4, 6], 7)]
    df = spark.createDataFrame(combos, "cand_id long, balls array<int>, bonus int")
    got = sorted((r.cand_id, r.balls) for r in matching.dedupe_combos(df).collect())
    assert got == [(2, [5, 4, 3, 2, 1]), (3, [1, 2, 3, 4, 5]), (8, [70, 2, 3, 4, 6]), (9, [70, 2, 3, 4, 5])]


def test_predictions_become_legal(spark):
    preds = [(1, [7, 7, 7, 3, 3], 40), (2, [5, 4, 3, 2, 1], 20), (3, [9, 9, 1, 2, 3], 0)]
    df = spark.createDataFrame(preds, "pred_id long, balls array<int>, bonus int")
    out = {r.pred_id: r for r in matching.complete_prediction(df).collect()}
    for pred_id, balls, bonus in preds:
        row = out[pred_id]
        assert row.balls == sorted(set(row.balls)) and len(row.balls) == 5
        assert set(balls) <= set(row.balls) and all(1 <= n <= G5.high for n in row.balls)
        assert 1 <= row.bonus <= 20 and (row.bonus == bonus or not 1 <= bonus <= 20)


def test_free_places_are_found_without_a_list_of_places(spark):
    held = [0, 1, 7, 8, 9, 300, 32766]
    df = spark.createDataFrame([(p + 1,) for p in held], "p bigint").agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    free = [p for p in range(1 << 15) if p not in held]
    asked = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 290, 293, 294, len(free) - 1)], "n bigint")
    found = asked.crossJoin(df).select("n", ranks.free_place(F.col("bits"), F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in found} == {n: free[n] for n in (0, 1, 4, 5, 290, 293, 294, len(free) - 1)}
    none = asked.select("n", ranks.free_place(F.lit(None).cast("binary"), F.col("n")).alias("p")).collect()
    assert all(r.n == r.p for r in none)


def test_tries_are_made_one_after_another(spark, draws_of):
    """A later try waits for the one before, and no row lists the places of a part."""
    history = draws_of([("a", i, "2020-01-01", [1, 2, 3, 4, i], 1) for i in range(5, 9)])
    text = matching.avoid_drawn(history.withColumnRenamed("draw_id", "pred_id"), history)._jdf.queryExecution().optimizedPlan().toString()
    assert "_try7" in text and "sequence(0, (_size" not in text
    lists = [line for line in text.splitlines() if "filter(sequence(0, (least(32768" in line]
    assert not lists
