import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import brute
from urnstat.games import G5, GameSpec
from urnstat.operators import combos, features
from urnstat.operators import likelihood as L

TINY = GameSpec("tiny", slots=3, high=9, bonus_high=4)


@pytest.fixture(scope="module")
def rows():
    return brute.make_rows(200, seed=9)


@pytest.fixture(scope="module")
def tiny_rows():
    return brute.make_rows(60, seed=3, high=9, slots=3, bonus_high=4)


def table(rows, slots):
    n = len(rows)
    return {
        k: c / n
        for k, c in Counter((i + 1, v) for r in rows for i, v in enumerate([*r[3][:slots], r[4]])).items()
    }


def test_empirical_probs(draws_of, rows):
    got = {(r.slot, r.number): r.p for r in L.empirical_probs(draws_of(rows)).collect()}
    want = table(rows, 5)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_likelihoods_sum_to_hundred(draws_of, rows):
    probs = L.empirical_probs(draws_of(rows))
    main, bonus = L.number_likelihood(probs).collect(), L.bonus_likelihood(probs).collect()
    assert len(main) == 50 and abs(sum(r.likelihood for r in main) - 100) < 0.5
    assert len(bonus) == 20 and abs(sum(r.likelihood for r in bonus) - 100) < 0.2
    ranked = [(r.likelihood, -r.number) for r in L.rank_likelihood(L.number_likelihood(probs)).collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_unseen_numbers(spark):
    probs = spark.createDataFrame([(1, 3, 0.5), (6, 2, 1.0), (9, 9, 1.0), (1, 77, 0.5)], "slot int, number int, p double")
    assert {r.number: r.likelihood for r in L.number_likelihood(probs).collect() if r.likelihood} == {3: 10.0}
    cands = spark.createDataFrame([(1, [3, 4, 5, 6, 7], 2), (2, [99, 4, 5, 6, 7], 25)], "cand_id long, balls array<int>, bonus int")
    got = {r.cand_id: r.score for r in L.score_combos(cands, probs).collect()}
    assert got == {1: round((0.5 + 0.04 + 1) / 6 * 100, 2), 2: 1.0}
    looked = L.lookup_probs(cands, probs).collect()
    assert len(looked) == 12 and {r.p for r in looked if r.cand_id == 2} == {0.01}


def test_scores_need_no_shuffle_of_candidates(spark, draws_of, rows):
    cands = spark.range(1000).selectExpr("id as cand_id", "array(1, 2, 3, 4, 5) as balls", "1 as bonus")
    plan = L.score_combos(cands, L.empirical_probs(draws_of(rows)))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquer")[0]
    assert "Exchange" not in main and "Join" not in main


def test_greedy_takes_the_best_unused_number(spark):
    probs = spark.createDataFrame(
        [(1, 5, 0.6), (1, 2, 0.4), (2, 5, 0.9), (2, 1, 0.1), (3, 5, 0.5), (3, 1, 0.3), (3, 7, 0.2), (4, 2, 0.5), (4, 1, 0.5)],
        "slot int, number int, p double",
    )
    row = L.greedy_combo(probs, TINY).first()
    assert (row.balls, row.bonus) == ([1, 5, 7], 1)
    assert row.score == round((0.6 + 0.1 + 0.2 + 0.5) / 4 * 100, 2)


def test_greedy_without_enough_numbers_has_no_score(spark):
    probs = spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0), (3, 1, 1.0), (4, 2, 1.0)], "slot int, number int, p double")
    assert L.greedy_combo(probs, TINY).first().score is None


def test_best_and_worst(spark):
    scored = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.0), (4, 2.0)], "cand_id long, score double")
    assert {r.kind: r.cand_id for r in L.best_worst(scored).collect()} == {"best": 2, "worst": 4}


def test_compare_scores(spark):
    scored = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 4.0)], "cand_id long, score double")
    reference = spark.createDataFrame([(4.0,)], "score double")
    got = {r.cand_id: r.verdict for r in L.compare_scores(scored, reference).collect()}
    assert got == {1: "lower", 2: "higher", 3: "same"}


def test_exact_extremes_against_all_combinations(draws_of, tiny_rows):
    probs = L.empirical_probs(draws_of(tiny_rows), TINY)
    unit = combos.SCORE_UNIT
    seen = table(tiny_rows, 3)
    grid = {(s, n): round(seen.get((s, n), 0.01) * unit) for s in (1, 2, 3) for n in range(1, 10)}
    bonus = {n: round(seen.get((4, n), 0.01) * unit) for n in range(1, 5)}
    got = {r.kind: (tuple(r.balls), r.bonus) for r in combos.exact_extremes(probs, TINY).collect()}
    best, worst = brute.extremes(grid, bonus, 3)
    assert got == {"best": best, "worst": worst}


def test_sampled_extremes_lie_within_the_exact_ones(draws_of, tiny_rows):
    probs = L.empirical_probs(draws_of(tiny_rows), TINY)
    exact = {r.kind: r.score for r in combos.exact_extremes(probs, TINY).collect()}
    sampled = {r.kind: r.score for r in combos.sampled_extremes(probs, TINY, n=50).collect()}
    assert exact["worst"] <= sampled["worst"] <= sampled["best"] <= exact["best"]


def test_weighted_combos(draws_of, rows):
    probs = L.empirical_probs(draws_of(rows))
    drawn = combos.weighted_combos(probs, n=40).collect()
    assert len({(tuple(r.balls), r.bonus) for r in drawn}) == 40
    known = {(r.slot, r.number) for r in probs.collect()}
    for r in drawn:
        assert r.balls == sorted(set(r.balls)) and len(r.balls) == 5 and (6, r.bonus) in known
    assert [r.score for r in drawn] == sorted((r.score for r in drawn), reverse=True)
    again = combos.weighted_combos(probs.repartition(7), n=40).collect()
    assert sorted(drawn) == sorted(again)


def test_weighted_picks_follow_the_probabilities(spark):
    probs = spark.createDataFrame(
        [(1, 1, 0.8), (1, 2, 0.2), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 0.5), (4, 2, 0.5)], "slot int, number int, p double"
    )
    cands = spark.range(4000).withColumnRenamed("id", "cand_id")
    drawn = combos._weighted(cands, probs, TINY, 1)
    share = drawn.where("array_contains(balls, 1)").count() / 4000
    assert abs(share - 0.8) < 0.03


def test_weighted_stops_when_nothing_new_can_come(spark):
    probs = spark.createDataFrame([(1, 1, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 0.5), (4, 2, 0.5)], "slot int, number int, p double")
    assert combos.weighted_combos(probs, TINY, n=5).count() == 2


def peaked(spark, rare=1e-9):
    """A table of the tiny game in which almost every try gives the same combination."""
    rows = [(s, n, 1 - 3 * rare if n == s else rare) for s in (1, 2, 3) for n in (1, 2, 3, 4)] + [(4, 1, 1 - rare), (4, 2, rare)]
    return spark.createDataFrame(rows, "slot int, number int, p double")


def test_peaked_tables_give_all_that_is_asked_for(spark):
    probs = peaked(spark)
    some = combos.weighted_combos(probs, TINY, n=6).collect()
    assert len({(tuple(r.balls), r.bonus) for r in some}) == 6
    assert some[0].balls == [1, 2, 3] and some[0].bonus == 1 and some[0].cand_id == 0
    # Four sets with two bonus numbers are all there are.
    assert len(combos.weighted_combos(probs, TINY, n=50).collect()) == 8


def test_narrow_beams_keep_the_earliest_picks(spark):
    probs = spark.createDataFrame(
        [(s, n, (n + s) / 30) for s in (1, 2, 3) for n in range(1, 6)] + [(4, 1, 0.7), (4, 2, 0.3)], "slot int, number int, p double"
    )
    five = GameSpec("five", slots=3, high=5, bonus_high=2)
    wide, whole = combos._beam(probs, five, 3, 1000)
    order = [r.picks for r in wide.orderBy(F.desc("time")).collect()]
    assert whole and len(order) == 5 * 4 * 3 * 2
    for width in (1, 7, 40):
        narrow, whole = combos._beam(probs, five, 3, width)
        assert not whole and [r.picks for r in narrow.orderBy(F.desc("time")).collect()] == order[:width]


def test_beams_follow_the_probabilities(spark):
    rows = [(1, n, 1 / 40) for n in range(1, 41)] + [(2, 41, 0.8), (2, 42, 0.2), (3, 1, 1.0)]
    probs = spark.createDataFrame(rows, "slot int, number int, p double")
    picks, whole = combos._beam(probs, GameSpec("wide", slots=2, high=42, bonus_high=1), 11, 1000)
    order = [r.picks for r in picks.orderBy(F.desc("time")).collect()]
    assert whole and len(order) == 80
    # Below each first number the likelier second one comes first in four of five cases.
    earlier = sum(order.index([n, 41, 1]) < order.index([n, 42, 1]) for n in range(1, 41))
    assert 24 <= earlier <= 39
    assert sum(p[1] == 41 for p in order[:20]) >= 11


def test_weighted_skips_candidates_that_run_out_of_numbers(spark):
    probs = spark.createDataFrame(
        [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.5), (3, 3, 1.0), (4, 1, 1.0)], "slot int, number int, p double"
    )
    got = combos.weighted_combos(probs, TINY, n=5).collect()
    assert [r.balls for r in got] == [[1, 2, 3]]


def test_sample_grows_until_it_is_full(spark):
    narrow = GameSpec("narrow", slots=2, high=4, bonus_high=2)
    assert combos.sampled_combos(spark, narrow, n=12).count() == 12


def test_profile(spark, draws_of):
    history = draws_of([("s", 1, None, [5, 9, 13, 46, 47], 11)])
    cands = spark.createDataFrame([(1, [47, 46, 13, 9, 5], 11)], "cand_id long, balls array<int>, bonus int")
    got = {r.stat: r.value for r in combos.combo_profile(cands, history).collect()}
    assert got == {
        "Mean": "24.0",
        "Median": "13.0",
        "Range": "42",
        "Sum Without Bonus": "120",
        "Sum With Bonus": "131",
        "Even Count": "1",
        "Odd Count": "4",
        "Low Range Count": "3",
        "High Range Count": "2",
        "Has Consecutive Numbers": "Yes",
        "Already Drawn Before": "Yes",
    }


def test_formatting(spark):
    df = spark.createDataFrame([(1, [5, 9, 13, 46, 47], 11)], "cand_id long, balls array<int>, bonus int")
    assert features.format_prediction(df).first() == (1, "5, 9, 13, 46, 47", "11", "Yes")


def test_slots_come_in_ball_order(draws_of):
    df = draws_of([("s", 1, None, [9, 2, 7, 1, 5], 11)])
    got = sorted((r.slot, r.number) for r in features.explode_slots(df, G5).collect())
    assert got == [(1, 9), (2, 2), (3, 7), (4, 1), (5, 5), (6, 11)]
