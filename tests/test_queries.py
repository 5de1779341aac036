"""Every registered query against its oracle, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as contract
from tests import compare
from urnstat.operators import filters, forest, likelihood
from urnstat.plans import oracle, queries
from urnstat.sources.tables import stored_draws

SQL = oracle.oracle_sql()
# Trained values; for each there is a query of checked facts that has an oracle.
CHECKED = {
    "forest_probs": "forest_probs_check",
    "forest_likelihood": "forest_likelihood_check",
    "forest_predict": "forest_predict_check",
    "forest_scores": "forest_scores_check",
    "holdout_accuracy": "holdout_facts",
    "oob_accuracy": "oob_facts",
    "score_hypothetical": "score_hypothetical_check",
}
NO_ORACLE = set(CHECKED)


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.oracle(sf_dir)


def test_only_forests_lack_an_oracle():
    assert set(queries.QUERIES) - set(SQL) == NO_ORACLE
    assert set(SQL) <= set(queries.QUERIES) <= set(contract.queries())
    assert set(CHECKED.values()) <= set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_oracle(spark, sf_dir, con, name):
    # No series of the smallest tables is long enough to train on.
    want = "no rows" if name == "trainable_series" else ""
    assert compare.compare(contract.queries()[name](spark, sf_dir), con, SQL[name]) == want


@pytest.mark.parametrize("name", sorted(NO_ORACLE))
def test_forest_query_returns_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_registered_forests_grow_until_they_stop(spark, sf_dir):
    grown = forest.fit_summary(queries._models(spark, sf_dir)).collect()
    assert len(grown) == 6 and all(r["depth"] > 8 for r in grown)


def test_forest_scores_cover_every_series(spark, sf_dir):
    got = contract.queries()["forest_scores"](spark, sf_dir).groupBy("series").count().collect()
    want = stored_draws(spark, sf_dir).groupBy("series").count().collect()
    assert len(want) > 1 and dict(map(tuple, got)) == dict(map(tuple, want))


def test_each_series_is_scored_by_its_own_table(spark):
    probs = spark.createDataFrame([(k, s, n, p * s) for k, p in (("a", 0.1), ("b", 0.02)) for s in range(1, 7) for n in range(1, 7)], "series string, slot int, number int, p double")
    cands = spark.createDataFrame([(k, i, [1, 2, 3, 4, 5], 6) for i, k in enumerate("abc")], "series string, cand_id bigint, balls array<int>, bonus int")
    got = {r["series"]: r["score"] for r in likelihood.score_combos(cands, probs, keys=("series",)).collect()}
    assert got == {"a": 35.0, "b": 7.0, "c": 100 * likelihood.UNSEEN}
    one = likelihood.score_combos(cands, probs.where("series = 'b'"))
    assert {r["score"] for r in one.collect()} == {7.0}


def test_changed_inputs_are_read_again(spark, sf_dir, tmp_path):
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    count = lambda: (stored_draws(spark, str(tmp_path)).count(), queries._model_table(spark, str(tmp_path)).count())
    before = count()
    spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    after = count()
    assert before[0] == before[1] and after[0] == after[1] and 0 < after[0] < before[0]


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LOOK_BACK = ["prev_common_count", "hit_rate_last_5", "rolling_frequency", "trend_table", "calculated_draws", "feature_matrix"]


@pytest.mark.parametrize("name", LOOK_BACK)
def test_no_series_meets_in_one_task(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    assert "SinglePartition" not in text
    windows = [line for line in text.splitlines() if "Window [" in line and "_pos" in line]
    assert windows and all(re.search(r"windowspecdefinition\(series#\d+, _w0#", line) for line in windows)


@pytest.mark.parametrize("name", ["row_stats", "parity_counts", "range_counts", "has_consecutive", "avg_gap", "indicators", "pattern_table", "validate_draws"])
def test_row_operators_do_not_shuffle(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    assert "Exchange" not in text and "PythonUDF" not in text


def test_scans_are_pruned(spark, sf_dir):
    text = plan(contract.queries()["filter_dates"](spark, sf_dir))
    assert "GreaterThanOrEqual(draw_date" in text
    text = plan(contract.queries()["freq_all"](spark, sf_dir))
    assert "ReadSchema: struct<balls:array<int>,bonus:int>" in text


def test_no_cross_joins(spark, sf_dir):
    for name in ("score_combos", "compare_scores", "sum_histogram", "consecutive_share", "hypothetical_features", "lookup_probs"):
        text = plan(contract.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("n", [500, 2000, 100_000])
def test_recent_draws_have_one_plan_for_every_n(spark, sf_dir, n):
    df = filters.filter_recent(stored_draws(spark, sf_dir), n)
    text = plan(df)
    assert "Window" not in text and "SinglePartition" not in text
    shape = lambda t: re.sub(r"\S*urnstat\S*|\d+", "", t)  # noqa: E731  without folders and numbers
    assert shape(text) == shape(plan(filters.filter_recent(stored_draws(spark, sf_dir), 7)))


def test_distinct_combinations_need_no_sorted_aggregate(spark, sf_dir):
    for name in ("dedupe_combos", "weighted_combos"):
        assert "SortAggregate" not in plan(contract.queries()[name](spark, sf_dir))
