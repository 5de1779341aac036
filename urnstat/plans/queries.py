"""Registered queries: every operator over the given tables.

Dates leave as ISO text and slots as columns b1, b2, … so that results compare
across engines; real-valued results are rounded to six places.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnstat.functions import balls as B
from urnstat.functions import text
from urnstat.games import G5, G6, GameSpec
from urnstat.operators import combos, features, filters, forest, matching, order, quality
from urnstat.operators import frequency as freq
from urnstat.operators import likelihood as L
from urnstat.plans import pipeline
from urnstat.session import materialize, scratch_path
from urnstat.sources import raw, store
from urnstat.sources import tables as T
from urnstat.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TREND_NUMBERS = [1, 15, 30, 45]
SLICE_START, SLICE_END = "1996-01-01", "1997-12-31"
SPLIT_DAY = "2000-01-01"
PLACES = 6
WEIGHTED = 500
# Trees of every slot; they grow until their leaves are pure.
FOREST = {"num_trees": 100}
# A small game onto which numbers are folded, so that most of its sets are drawn.
DENSE = GameSpec("dense", slots=3, high=12, bonus_high=20)
NEW_ID_SHIFT = 1_000_000_000
LATE_SERIES = "1-URGENT"

KEYS = ("series", "draw_id")
STATS = ["mean", "median", "std", "min", "max", "range", "sum_without_bonus", "sum_with_bonus"]
REAL = {"mean", "median", "std", "avg_gap_between_numbers", "hit_rate_last_5"}


def query(name: str, **bound):
    def register(fn):
        QUERIES[name] = partial(fn, **bound) if bound else fn
        return fn

    return register


def r6(name: str):
    return F.round(name, PLACES).alias(name)


def show(names):
    return [r6(n) if n in REAL else F.col(n) for n in names]


def iso(name: str = "draw_date"):
    return text.iso(F.col(name)).alias(name)


def combo(df: DataFrame, *first: str, spec: GameSpec = G5, last: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*first, *B.wide(F.col("balls"), spec), "bonus", *last)


# ---- sources ---------------------------------------------------------------


@query("clean_g5")
def clean_g5(spark, sf_dir):
    clean = raw.clean_raw_g5(T.raw_g5(T.stored_draws(spark, sf_dir)))
    tokens = [F.get("tokens", F.lit(i)).alias(f"n{i + 1}") for i in range(6)]
    return clean.select(*KEYS, "draw_date_raw", *tokens, "jackpot", "outcome")


@query("clean_g6")
def clean_g6(spark, sf_dir):
    clean = raw.clean_raw_g6(T.raw_g6(T.stored_draws(spark, sf_dir, G6)))
    tokens = [F.get("tokens", F.lit(i)).alias(f"n{i + 1}") for i in range(7)]
    return clean.select("draw_id", "year", "date", *tokens)


@query("tolerant_parse")
def tolerant_parse(spark, sf_dir):
    clean = raw.clean_raw_g5(T.raw_g5(T.stored_draws(spark, sf_dir)))
    quoted = clean.withColumn("tokens", F.transform("tokens", lambda t: F.concat(F.lit(' "'), t, F.lit('" '))))
    return combo(raw.parse_balls(quoted), *KEYS)


@query("parse_dates")
def parse_dates(spark, sf_dir):
    dated = raw.with_draw_date(T.date_texts(T.stored_draws(spark, sf_dir)))
    return dated.select(*KEYS, "draw_date_raw", iso())


@query("day_name")
def day_name(spark, sf_dir):
    dated = raw.with_day(raw.clean_raw_g6(T.raw_g6(T.stored_draws(spark, sf_dir, G6))))
    return dated.select("draw_id", iso(), "day")


@query("append_draw")
def append_draw(spark, sf_dir):
    draws = T.stored_draws(spark, sf_dir)
    new = pipeline.typed(quality.validate_draws(_new_ids(T.new_draws(draws))))
    return store.union_draws(_money(draws), new).select(*KEYS, iso(), *B.wide(F.col("balls"), G5), "bonus", "jackpot", "outcome")


# ---- features of one draw --------------------------------------------------


@query("row_stats")
@query("row_stats_g6", spec=G6)
def row_stats(spark, sf_dir, spec=G5):
    return features.row_stats(T.stored_draws(spark, sf_dir, spec), spec).select(*KEYS, *show(STATS))


@query("parity_counts")
@query("parity_counts_g6", spec=G6)
def parity_counts(spark, sf_dir, spec=G5):
    return features.parity_counts(T.stored_draws(spark, sf_dir, spec), spec).select(*KEYS, "even_count", "odd_count")


@query("range_counts")
@query("range_counts_g6", spec=G6)
def range_counts(spark, sf_dir, spec=G5):
    return features.range_counts(T.stored_draws(spark, sf_dir, spec), spec).select(*KEYS, "low_range_count", "high_range_count")


@query("has_consecutive")
def has_consecutive(spark, sf_dir):
    return features.has_consecutive(T.stored_draws(spark, sf_dir)).select(*KEYS, "has_consecutive")


@query("avg_gap")
def avg_gap(spark, sf_dir):
    return features.avg_gap(T.stored_draws(spark, sf_dir)).select(*KEYS, r6("avg_gap_between_numbers"))


@query("indicators")
def indicators(spark, sf_dir):
    df = features.indicators(T.stored_draws(spark, sf_dir), TREND_NUMBERS)
    return df.select(*KEYS, *[f"number_{n}" for n in TREND_NUMBERS])


@query("pattern_table")
def pattern_table(spark, sf_dir):
    return features.pattern_table(T.stored_draws(spark, sf_dir))


@query("format_prediction")
def format_prediction(spark, sf_dir):
    return features.format_prediction(T.candidates(T.stored_draws(spark, sf_dir)))


@query("explode_slots")
def explode_slots(spark, sf_dir):
    return features.explode_slots(T.stored_draws(spark, sf_dir))


# ---- filters and quality ---------------------------------------------------


@query("filter_dates")
def filter_dates(spark, sf_dir):
    return filters.filter_dates(T.stored_draws(spark, sf_dir), SLICE_START, SLICE_END).select(*KEYS, iso())


@query("filter_recent", n=500)
@query("filter_recent_2000", n=2000)
def filter_recent(spark, sf_dir, n):
    return filters.filter_recent(T.stored_draws(spark, sf_dir), n).select(*KEYS, iso())


@query("trainable_series")
def trainable_series(spark, sf_dir):
    return filters.require_rows(T.stored_draws(spark, sf_dir), 1000).select(*KEYS)


@query("date_range_info")
def date_range_info(spark, sf_dir):
    dated = raw.with_draw_date(T.date_texts(T.stored_draws(spark, sf_dir)))
    return filters.date_range_info(dated).select(iso("earliest"), iso("latest"), "total_draws")


@query("drop_undated")
def drop_undated(spark, sf_dir):
    dated = raw.with_draw_date(T.date_texts(T.stored_draws(spark, sf_dir)))
    return filters.drop_undated(dated).select(*KEYS, iso())


@query("recent_10")
def recent_10(spark, sf_dir):
    return combo(filters.recent(T.stored_draws(spark, sf_dir), 10).withColumn("draw_date", iso()), *KEYS, "draw_date")


CALCULATED = [
    *STATS,
    "even_count",
    "odd_count",
    "low_range_count",
    "high_range_count",
    "prev_common_count",
    "has_consecutive",
    "hit_rate_last_5",
    "avg_gap_between_numbers",
]


@query("recent_100")
def recent_100(spark, sf_dir):
    return filters.recent_calculated(T.stored_draws(spark, sf_dir), 100).select(*KEYS, iso(), *show(CALCULATED))


@query("validate_draws")
def validate_draws(spark, sf_dir):
    checked = quality.validate_draws(T.new_draws(T.stored_draws(spark, sf_dir)))
    return checked.select(*KEYS, "valid", F.array_join("errors", "; ").alias("errors"))


@query("reject_counts")
def reject_counts(spark, sf_dir):
    return quality.reject_counts(quality.validate_draws(T.new_draws(T.stored_draws(spark, sf_dir))))


# ---- order and look-back ---------------------------------------------------


@query("with_seq")
def with_seq(spark, sf_dir):
    keys = T.stored_draws(spark, sf_dir).select("series", "draw_id", "draw_date")
    return order.with_seq(keys).select(*KEYS, "seq")


def placed(spark, sf_dir, spec=G5):
    return order.with_seq(T.stored_draws(spark, sf_dir, spec).drop("jackpot", "outcome"))


@query("prev_common_count")
@query("prev_common_count_file", direction="file")
def prev_common_count(spark, sf_dir, direction="past"):
    return order.prev_common(placed(spark, sf_dir), direction).select("series", "seq", "prev_common_count")


@query("hit_rate_last_5")
@query("hit_rate_last_5_file", direction="file")
def hit_rate_last_5(spark, sf_dir, direction="past"):
    return order.hit_rate(placed(spark, sf_dir), direction=direction).select("series", "seq", r6("hit_rate_last_5"))


@query("rolling_frequency")
@query("rolling_frequency_file", direction="file")
def rolling_frequency(spark, sf_dir, direction="past"):
    return order.rolling_frequency(placed(spark, sf_dir), TREND_NUMBERS, direction=direction)


@query("trend_table")
def trend_table(spark, sf_dir):
    wide = order.trend_table(placed(spark, sf_dir), TREND_NUMBERS)
    return wide.select("series", "seq", iso(), *[f"frequency_{n}" for n in TREND_NUMBERS])


@query("join_by_seq")
def join_by_seq(spark, sf_dir):
    df = placed(spark, sf_dir)
    engineered = features.avg_gap(order.hit_rate(df)).select("series", "seq", "hit_rate_last_5", "avg_gap_between_numbers")
    sums = features.row_stats(df).select("series", "seq", "draw_id", "sum_without_bonus")
    joined = order.join_by_seq(sums, engineered)
    return joined.select("series", "seq", "draw_id", "sum_without_bonus", *show(["hit_rate_last_5", "avg_gap_between_numbers"]))


@query("calculated_draws")
@query("calculated_draws_g6", spec=G6)
def calculated_draws(spark, sf_dir, spec=G5):
    df = pipeline.calculate(T.stored_draws(spark, sf_dir, spec), spec)
    return df.select(*KEYS, "seq", *B.wide(F.col("balls"), spec), "bonus", *show(CALCULATED))


@query("feature_matrix", kind=14)
@query("feature_matrix_13", kind=13)
@query("feature_matrix_12", kind=12)
def feature_matrix(spark, sf_dir, kind):
    calculated = pipeline.calculate(T.stored_draws(spark, sf_dir).drop("jackpot", "outcome"))
    names = features.feature_columns(kind)
    matrix = features.feature_matrix(calculated, kind)
    return matrix.select(*KEYS, *show(names), *[f"b{i + 1}" for i in range(5)], "bonus")


@query("lagged_matrix")
def lagged_matrix(spark, sf_dir):
    """Model inputs that are known before the draw: the features of the draw before."""
    names = features.feature_columns(14)
    lagged = order.lagged(_model_table(spark, sf_dir), names)
    real = [F.round(f"prev_{n}", PLACES).alias(f"prev_{n}") if n in REAL else F.col(f"prev_{n}") for n in names]
    return lagged.select(*KEYS, *real, *B.wide(F.col("balls"), G5), "bonus")


@query("scoring_row", which="latest")
@query("scoring_row_oldest", which="oldest")
def scoring_row(spark, sf_dir, which):
    calculated = _model_table(spark, sf_dir)
    names = features.feature_columns(14)
    return order.scoring_row(calculated, which, ["seq", "draw_id", *names]).select("series", "seq", "draw_id", *show(names))


@query("train_split")
def train_split(spark, sf_dir):
    return forest.train_split(T.stored_draws(spark, sf_dir)).select(*KEYS, "is_train")


# ---- frequencies and patterns ----------------------------------------------


@query("freq_all")
@query("freq_all_g6", spec=G6)
def freq_all(spark, sf_dir, spec=G5):
    return freq.order_by_number(freq.frequency(T.stored_draws(spark, sf_dir, spec), spec))


@query("freq_slots")
def freq_slots(spark, sf_dir):
    return freq.order_by_number(freq.frequency(T.stored_draws(spark, sf_dir), slots=[2, 3, 4, 5, 6]))


@query("freq_ranked")
def freq_ranked(spark, sf_dir):
    return freq.rank_frequency(freq.frequency(T.stored_draws(spark, sf_dir)))


@query("fill_domain")
def fill_domain(spark, sf_dir):
    return freq.fill_domain(freq.main_frequency(T.stored_draws(spark, sf_dir, G6), G6), G6.high)


@query("main_grid")
def main_grid(spark, sf_dir):
    return freq.main_grid(T.stored_draws(spark, sf_dir))


@query("bonus_grid")
def bonus_grid(spark, sf_dir):
    return freq.bonus_grid(T.stored_draws(spark, sf_dir))


def _distribution(spark, sf_dir, column):
    return freq.distribution(features.pattern_table(T.stored_draws(spark, sf_dir)), column)


for _name, _column in (
    ("dist_even", "even_count"),
    ("dist_odd", "odd_count"),
    ("dist_low", "low_range_count"),
    ("dist_high", "high_range_count"),
):
    QUERIES[_name] = partial(_distribution, column=_column)


@query("sum_histogram")
def sum_histogram(spark, sf_dir):
    sums = T.stored_draws(spark, sf_dir).select(B.ball_sum(F.col("balls"), G5).alias("sum_without_bonus"))
    return freq.histogram(sums, "sum_without_bonus").select("bin", r6("left_edge"), r6("right_edge"), "frequency")


@query("consecutive_share")
def consecutive_share(spark, sf_dir):
    return freq.share(features.has_consecutive(T.stored_draws(spark, sf_dir)), "has_consecutive")


@query("history_profile")
def history_profile(spark, sf_dir):
    return freq.history_profile(features.row_stats(T.stored_draws(spark, sf_dir))).select(*show(STATS[:6]))


# ---- combinations against the history --------------------------------------


@query("already_drawn")
@query("already_drawn_g6", spec=G6)
def already_drawn(spark, sf_dir, spec=G5):
    history = T.stored_draws(spark, sf_dir, spec)
    return matching.already_drawn(T.candidates(history, spec), history, spec).select("cand_id", "drawn")


@query("exclude_drawn")
def exclude_drawn(spark, sf_dir):
    history = T.stored_draws(spark, sf_dir)
    return combo(matching.exclude_drawn(T.candidates(history), history), "cand_id")


@query("dedupe_combos")
def dedupe_combos(spark, sf_dir):
    history = T.stored_draws(spark, sf_dir)
    drawn = history.select((F.col("draw_id") * 2 + 1).alias("cand_id"), "balls", "bonus")
    cands = T.candidates(history).withColumn("cand_id", F.col("cand_id") * 2)
    return combo(matching.dedupe_combos(cands.unionByName(drawn)), "cand_id")


@query("complete_prediction")
def complete_prediction(spark, sf_dir):
    return combo(matching.complete_prediction(T.rough_predictions(T.stored_draws(spark, sf_dir))), "pred_id")


def _avoided(preds: DataFrame, history: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """What a prediction that avoids the history must be, as checked facts."""
    out = matching.avoid_drawn(preds, history, spec)
    given = preds.select("pred_id", F.col("balls").alias("_given"))
    again = matching.already_drawn(out, history, spec).join(given, "pred_id")
    numbers = F.array_distinct("balls")
    legal = (F.size(numbers) == spec.slots) & (F.array_min(numbers) >= 1) & (F.array_max(numbers) <= spec.high)
    return again.select(
        "pred_id",
        "replaced",
        "exhausted",
        F.coalesce(legal, F.lit(False)).alias("legal"),
        F.coalesce(F.col("balls") == F.col("_given"), F.lit(False)).alias("kept"),
        "drawn",
    )


@query("avoid_drawn")
def avoid_drawn(spark, sf_dir):
    history = T.stored_draws(spark, sf_dir)
    return _avoided(T.candidates(history).withColumnRenamed("cand_id", "pred_id"), history)


@query("avoid_drawn_dense")
def avoid_drawn_dense(spark, sf_dir):
    """Every draw as a prediction, in a game of which most sets were drawn."""
    numbers = F.sort_array(F.array_distinct(F.transform("balls", lambda b: b % DENSE.high + 1)))
    folded = T.stored_draws(spark, sf_dir).select(
        F.col("draw_id").alias("pred_id"), F.slice(numbers, 1, DENSE.slots).alias("balls"), "bonus"
    )
    folded = folded.where(F.size("balls") == DENSE.slots)
    return _avoided(folded, folded, DENSE)


@query("combo_profile")
def combo_profile(spark, sf_dir):
    history = T.stored_draws(spark, sf_dir)
    return combos.combo_profile(T.candidates(history), history)


@query("hypothetical_features")
def hypothetical_features(spark, sf_dir):
    history = T.stored_draws(spark, sf_dir)
    out = combos.hypothetical_features(T.candidates(history), features.row_stats(history))
    return out.select("cand_id", *show(features.feature_columns(13)))


# ---- probabilities and scores ----------------------------------------------


def probs_of(spark, sf_dir, spec=G5):
    return L.empirical_probs(T.stored_draws(spark, sf_dir, spec), spec)


@query("number_likelihood")
@query("number_likelihood_g6", spec=G6)
def number_likelihood(spark, sf_dir, spec=G5):
    return L.number_likelihood(probs_of(spark, sf_dir, spec), spec, PLACES)


@query("bonus_likelihood")
def bonus_likelihood(spark, sf_dir):
    return L.bonus_likelihood(probs_of(spark, sf_dir), places=PLACES)


@query("likelihood_ranked")
def likelihood_ranked(spark, sf_dir):
    return L.rank_likelihood(L.number_likelihood(probs_of(spark, sf_dir), places=PLACES))


@query("rank_slots")
def rank_slots(spark, sf_dir):
    return L.rank_slots(probs_of(spark, sf_dir)).select("slot", "number", r6("p"), "rank")


@query("predict_slots")
def predict_slots(spark, sf_dir):
    return L.predict_slots(probs_of(spark, sf_dir))


@query("lookup_probs")
def lookup_probs(spark, sf_dir):
    cands = T.candidates(T.stored_draws(spark, sf_dir))
    return L.lookup_probs(cands, probs_of(spark, sf_dir)).select("cand_id", "slot", "number", r6("p"))


def scored(spark, sf_dir):
    return L.score_combos(T.candidates(T.stored_draws(spark, sf_dir)), probs_of(spark, sf_dir), places=PLACES)


@query("score_combos")
def score_combos(spark, sf_dir):
    return scored(spark, sf_dir).select("cand_id", "score")


@query("compare_scores")
def compare_scores(spark, sf_dir):
    reference = L.greedy_combo(probs_of(spark, sf_dir), places=PLACES)
    return L.compare_scores(scored(spark, sf_dir), reference).select("cand_id", "score", "reference_score", "verdict")


@query("best_worst")
def best_worst(spark, sf_dir):
    return L.best_worst(scored(spark, sf_dir))


@query("greedy_combo")
@query("greedy_combo_g6", spec=G6)
def greedy_combo(spark, sf_dir, spec=G5):
    return combo(L.greedy_combo(probs_of(spark, sf_dir, spec), spec, PLACES), spec=spec, last=("score",))


@query("weighted_combos")
@query("weighted_combos_g6", spec=G6)
def weighted_combos(spark, sf_dir, spec=G5):
    drawn = combos.weighted_combos(probs_of(spark, sf_dir, spec), spec, WEIGHTED, places=PLACES)
    return combo(drawn, "cand_id", spec=spec, last=("score",))


@query("sampled_extremes")
@query("sampled_extremes_g6", spec=G6)
def sampled_extremes(spark, sf_dir, spec=G5):
    ends = combos.sampled_extremes(probs_of(spark, sf_dir, spec), spec, places=PLACES)
    return combo(ends, "kind", "cand_id", spec=spec, last=("score",))


@query("exact_extremes")
def exact_extremes(spark, sf_dir):
    return combo(combos.exact_extremes(probs_of(spark, sf_dir), places=PLACES), "kind", last=("score",))


@query("predict")
def predict(spark, sf_dir):
    """Best number per slot, made legal and kept clear of the history."""
    history = T.stored_draws(spark, sf_dir)
    return combo(pipeline.predict(L.empirical_probs(history), history), last=("replaced",))


# ---- forests ---------------------------------------------------------------


_KEPT: dict[tuple, object] = {}


def _once(spark, sf_dir, name: str, make):
    """Made once per session and state of the input files: forests serve several queries."""
    key = (spark.sparkContext.applicationId, sf_dir, T.input_state(spark, sf_dir), name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _model_table(spark, sf_dir, spec=G5):
    """Feature rows as a stored table, which scoring and forests read again."""
    history = T.stored_draws(spark, sf_dir, spec).drop("jackpot", "outcome")
    return _once(spark, sf_dir, f"rows-{spec.name}", lambda: materialize(pipeline.calculate(history, spec), "model-table"))


def _models(spark, sf_dir, spec=G5, kind=14):
    """Forests of all slots on the training rows."""
    rows = _model_table(spark, sf_dir, spec)
    return _once(spark, sf_dir, f"forests-{spec.name}-{kind}", lambda: forest.fit_slots(rows, spec, kind, **FOREST))


@query("forest_fit_summary")
@query("forest_fit_summary_g6", spec=G6, kind=13)
def forest_fit_summary(spark, sf_dir, spec=G5, kind=14):
    return forest.fit_summary(_models(spark, sf_dir, spec, kind)).select("slot", "classes", "features", "trees")


@query("forest_saved")
def forest_saved(spark, sf_dir):
    """Forests written and loaded again, as another session would."""
    path = scratch_path(spark, "forest")
    forest.save(_models(spark, sf_dir), path)
    return forest.fit_summary(forest.load(spark, path)).select("slot", "classes", "features", "trees")


def _forest_probs(spark, sf_dir):
    newest = order.scoring_row(_model_table(spark, sf_dir))
    return forest.forest_probs(_models(spark, sf_dir), newest, keys=("series",))


@query("forest_probs")
def forest_probs(spark, sf_dir):
    return _forest_probs(spark, sf_dir)


@query("forest_probs_check")
def forest_probs_check(spark, sf_dir):
    """Numbers and total probability of each series and slot."""
    sums = _forest_probs(spark, sf_dir).groupBy("series", "slot").agg(F.count("*").alias("numbers"), F.sum("p").alias("total"))
    return sums.withColumn("total", r6("total"))


@query("forest_likelihood")
def forest_likelihood(spark, sf_dir):
    return L.number_likelihood(_forest_probs(spark, sf_dir), places=PLACES, keys=("series",))


@query("forest_likelihood_check")
def forest_likelihood_check(spark, sf_dir):
    """Numbers of each series, and whether their likelihoods add to 100."""
    table = forest_likelihood(spark, sf_dir).groupBy("series").agg(F.count("*").alias("numbers"), F.sum("likelihood").alias("_sum"))
    return table.select("series", "numbers", (F.abs(F.col("_sum") - 100) < 0.01).alias("adds_to_100"))


def _forest_predict(spark, sf_dir):
    history = T.stored_draws(spark, sf_dir)
    return pipeline.predict(_forest_probs(spark, sf_dir), history, keys=("series",))


@query("forest_predict")
def forest_predict(spark, sf_dir):
    """For every series the forests' best numbers, made legal and kept clear of the history."""
    return combo(_forest_predict(spark, sf_dir), "series", last=("replaced",))


@query("forest_predict_check")
def forest_predict_check(spark, sf_dir):
    found = matching.already_drawn(_forest_predict(spark, sf_dir), T.stored_draws(spark, sf_dir))
    numbers = F.array_distinct("balls")
    legal = (F.size(numbers) == G5.slots) & (F.array_min(numbers) >= 1) & (F.array_max(numbers) <= G5.high)
    return found.select("series", (legal & F.col("bonus").between(1, G5.bonus_high)).alias("legal"), "drawn")


@query("forest_scores")
def forest_scores(spark, sf_dir):
    """Candidates of every series by its own probabilities."""
    cands = T.candidates(_model_table(spark, sf_dir), keys=("series",))
    scored = L.score_combos(cands, _forest_probs(spark, sf_dir), places=PLACES, keys=("series",))
    return combo(scored, "series", "cand_id", last=("score",))


@query("forest_scores_check")
def forest_scores_check(spark, sf_dir):
    return forest_scores(spark, sf_dir).select("series", "cand_id", F.col("score").between(0, 100).alias("in_range"))


@query("forest_full")
def forest_full(spark, sf_dir):
    rows = _model_table(spark, sf_dir)
    models, report = pipeline.train_on_slice(rows, None, ratio=None, **FOREST)
    return report.select("model", "draws", iso("first_date"), iso("last_date"), "features", "targets", "trees")


def _held_out(spark, sf_dir):
    return forest.train_split(_model_table(spark, sf_dir)).where(~F.col("is_train"))


@query("holdout_accuracy")
def holdout_accuracy(spark, sf_dir):
    return _once(spark, sf_dir, "holdout", lambda: materialize(forest.evaluate(_models(spark, sf_dir), _held_out(spark, sf_dir)), "holdout"))


@query("holdout_check")
def holdout_check(spark, sf_dir):
    found = holdout_accuracy(spark, sf_dir)
    return found.select("slot", "rows", F.col("accuracy").between(0, 1).alias("in_range"))


@query("holdout_facts")
def holdout_facts(spark, sf_dir):
    """Held-out draws with the commonest number of each main slot, and whether its forest is
    right more often. The bonus follows from no input, so its forest need not be."""
    cells = F.array(*B.slots(F.col("balls"), G5))
    counts = _held_out(spark, sf_dir).select(F.posexplode(cells).alias("_at", "number")).groupBy("_at", "number").count()
    most = counts.groupBy((F.col("_at") + 1).alias("slot")).agg(F.max("count").alias("commonest"))
    better = F.col("accuracy") * F.col("rows") > F.col("commonest")
    return holdout_accuracy(spark, sf_dir).join(most, "slot").select("slot", "rows", "commonest", better.alias("better"))


@query("untrained_facts")
def untrained_facts(spark, sf_dir):
    """Numbers below the greatest trained one that a slot never had, and their probability in all series."""
    rows = forest.train_split(_model_table(spark, sf_dir)).where("is_train")
    cells = F.array(*B.slots(F.col("balls"), G5), F.col("bonus"))
    trained = rows.select(F.posexplode(cells).alias("_at", "number")).select((F.col("_at") + 1).alias("slot"), "number").distinct()
    probs = _forest_probs(spark, sf_dir).groupBy("slot", "number").agg(F.max("p").alias("p"))
    rest = probs.join(trained, ["slot", "number"], "left_anti").groupBy("slot").agg(F.count("*").alias("numbers"), F.max("p").alias("p"))
    slots = trained.select("slot").distinct().join(rest, "slot", "left")
    return slots.select("slot", F.coalesce("numbers", F.lit(0)).alias("numbers"), F.coalesce("p", F.lit(0.0)).alias("p"))


@query("first_slot_facts")
def first_slot_facts(spark, sf_dir):
    """The first number is the input ``min``: whether most predictions of slot 1 are that number."""
    held = _held_out(spark, sf_dir)
    found = forest.scored(_models(spark, sf_dir), held, lambda slot, probs: forest.likeliest(probs), slots=[1])
    return found.agg(F.count("*").alias("rows"), (F.avg((F.col("_s1") == F.col("min")).cast("int")) > 0.5).alias("most_are_min"))


@query("oob_accuracy")
def oob_accuracy(spark, sf_dir):
    """Each training draw judged by the trees that never saw it."""
    rows = forest.train_split(_model_table(spark, sf_dir)).where("is_train")
    return _once(spark, sf_dir, "oob", lambda: materialize(forest.evaluate(_models(spark, sf_dir), rows, out_of_bag=True), "oob"))


@query("oob_facts")
def oob_facts(spark, sf_dir):
    """Draws, how many every tree saw, the mean number of judging trees, and whether the
    accuracy is that of held-out draws but for noise."""
    held = holdout_accuracy(spark, sf_dir).select("slot", F.col("rows").alias("_n"), F.col("accuracy").alias("_held"))
    near = F.abs(F.col("accuracy") - F.col("_held")) < 0.05 + 2 / F.sqrt("_n")
    return oob_accuracy(spark, sf_dir).join(held, "slot").select("slot", "rows", "unvoted", r6("voters"), near.alias("near_holdout"))


@query("score_hypothetical")
def score_hypothetical(spark, sf_dir):
    rows = _model_table(spark, sf_dir)
    inputs = combos.hypothetical_features(T.candidates(rows), rows)
    return combo(forest.score_hypothetical(_models(spark, sf_dir, kind=13), inputs), "cand_id", last=("score",))


@query("score_hypothetical_check")
def score_hypothetical_check(spark, sf_dir):
    return score_hypothetical(spark, sf_dir).select("cand_id", F.col("score").between(0, 100).alias("in_range"))


@query("training_report", part=pipeline.DateRange(SLICE_START, SLICE_END))
@query("training_report_recent", part=pipeline.Recent(500))
def training_report(spark, sf_dir, part):
    """Forests fitted on a slice; the report is taken from them."""
    report = _once(
        spark, sf_dir, f"slice-{part}", lambda: pipeline.train_on_slice(_model_table(spark, sf_dir), part, **FOREST)
    )[1]
    return report.select("model", "draws", iso("first_date"), iso("last_date"), "features", "targets", "trees")


# ---- stored tables and streams ---------------------------------------------


def _money(df: DataFrame) -> DataFrame:
    return df.withColumn("jackpot", F.concat(F.lit("R"), F.format_number("jackpot", 2)))


def _summary(calculated: DataFrame) -> DataFrame:
    return calculated.groupBy("series").agg(
        F.count("*").alias("draws"),
        F.max("seq").alias("last_seq"),
        F.sum("prev_common_count").alias("prev_common_total"),
        F.sum((F.col("hit_rate_last_5") * 5).cast("int")).alias("hit_total"),
        F.sum("sum_with_bonus").alias("ball_total"),
    )


def _new_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("draw_id", F.col("draw_id") + NEW_ID_SHIFT)


@query("ingest_result")
def ingest_result(spark, sf_dir):
    """History plus typed-in draws of the same days: the tables are rebuilt."""
    history = T.stored_draws(spark, sf_dir)
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    store.append_draws(paths.history, _money(history))
    pipeline.ingest(spark, _new_ids(T.new_draws(history)), paths)
    return _summary(pipeline.load_calculated(spark, paths))


def _grown(spark, sf_dir) -> pipeline.Paths:
    """Tables of the draws before a day, extended by typed-in draws from that day."""
    draws = T.stored_draws(spark, sf_dir)
    old = draws.where(F.col("draw_date") < F.lit(SPLIT_DAY).cast("date"))
    new = draws.where(F.col("draw_date") >= F.lit(SPLIT_DAY).cast("date"))
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    store.append_draws(paths.history, _money(old))
    pipeline.refresh(spark, paths)
    pipeline.ingest(spark, _new_ids(T.new_draws(new)), paths)
    return paths


@query("ingest_tail")
def ingest_tail(spark, sf_dir):
    return _summary(pipeline.load_calculated(spark, _grown(spark, sf_dir)))


@query("ingest_frequency")
def ingest_frequency(spark, sf_dir):
    return pipeline.load_frequency(spark, _grown(spark, sf_dir))


@query("stream_frequency")
def stream_frequency(spark, sf_dir):
    """Typed-in draws land as files; the stream keeps the frequency table."""
    root = scratch_path(spark, "stream")
    T.new_draws(T.stored_draws(spark, sf_dir)).write.json(f"{root}/landing")
    landing = intake.read_landing(spark, f"{root}/landing", files_per_trigger=4)
    intake.start_frequency(landing, f"{root}/frequency", f"{root}/checkpoint").awaitTermination()
    return intake.latest_frequency(spark, f"{root}/frequency").select("number", "frequency")


@query("stream_intake")
def stream_intake(spark, sf_dir):
    """Typed-in draws land as files; the stream appends the valid ones."""
    root = scratch_path(spark, "stream")
    T.new_draws(T.stored_draws(spark, sf_dir)).write.json(f"{root}/landing")
    paths = pipeline.Paths(root)
    landing = intake.read_landing(spark, f"{root}/landing", files_per_trigger=4)
    intake.start_intake(landing, paths, f"{root}/checkpoint").awaitTermination()
    return combo(store.load_history(spark, paths.history).withColumn("draw_date", iso()), *KEYS, "draw_date")


def _land(df: DataFrame, root: str) -> str:
    """Typed-in draws as landing files."""
    _new_ids(T.new_draws(df)).write.json(f"{root}/landing")
    return f"{root}/landing"


def _stream_in(spark, df: DataFrame, paths: pipeline.Paths) -> None:
    root = scratch_path(spark, "stream")
    landing = intake.read_landing(spark, _land(df, root))
    intake.start_intake(landing, paths, f"{root}/checkpoint").awaitTermination()


def _split_draws(spark, sf_dir):
    """Draws before a day, and two halves of the later ones."""
    draws = T.stored_draws(spark, sf_dir)
    late = F.col("draw_date") >= F.lit(SPLIT_DAY).cast("date")
    return draws.where(~late), draws.where(late & (F.col("draw_id") % 2 == 0)), draws.where(late & (F.col("draw_id") % 2 == 1))


@query("stream_calculated")
def stream_calculated(spark, sf_dir):
    """A stream alone keeps history, features and frequencies."""
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    _stream_in(spark, T.stored_draws(spark, sf_dir), paths)
    return _summary(pipeline.load_calculated(spark, paths))


@query("two_streams")
def two_streams(spark, sf_dir):
    """Two streams with checkpoints of their own on one history."""
    old, one, two = _split_draws(spark, sf_dir)
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    store.append_draws(paths.history, _money(old))
    _stream_in(spark, one, paths)
    _stream_in(spark, two, paths)
    return _summary(pipeline.load_calculated(spark, paths))


@query("stream_then_ingest")
def stream_then_ingest(spark, sf_dir):
    """A history, a stream, then a batch: the tables hold all three."""
    old, one, two = _split_draws(spark, sf_dir)
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    store.append_draws(paths.history, _money(old))
    pipeline.refresh(spark, paths)
    _stream_in(spark, one, paths)
    pipeline.ingest(spark, _new_ids(T.new_draws(two)), paths)
    return _summary(pipeline.load_calculated(spark, paths))


@query("ingest_late")
def ingest_late(spark, sf_dir):
    """Draws of one series dated among the stored ones: that series is written anew."""
    draws = T.stored_draws(spark, sf_dir)
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    store.append_draws(paths.history, _money(draws))
    pipeline.refresh(spark, paths)
    pipeline.ingest(spark, _new_ids(T.new_draws(draws.where(F.col("series") == LATE_SERIES))), paths)
    return _summary(pipeline.load_calculated(spark, paths))


@query("stored_range", part=pipeline.DateRange(SLICE_START, SLICE_END))
@query("stored_recent", part=pipeline.Recent(500))
def stored_slice(spark, sf_dir, part):
    """A slice of stored tables that hold the draws in two parts."""
    draws = T.stored_draws(spark, sf_dir)
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    late = F.col("draw_date") >= F.lit(SPLIT_DAY).cast("date")
    store.append_draws(paths.history, _money(draws.where(~late)))
    pipeline.refresh(spark, paths)
    store.append_draws(paths.history, _money(draws.where(late)))
    pipeline.extend(spark, paths)
    return pipeline.load_slice(spark, paths, part).select(*KEYS, iso())


@query("ingest_many")
def ingest_many(spark, sf_dir):
    """All draws in batches by date; small parts are merged on the way and dead ones removed."""
    draws = T.stored_draws(spark, sf_dir)
    paths = pipeline.Paths(scratch_path(spark, "ingest"))
    year = F.year("draw_date")
    store.append_draws(paths.history, _money(draws.where(year < 1997)))
    pipeline.refresh(spark, paths)
    for first, last in ((1997, 1997), (1998, 1999), (2000, 9999)):
        store.append_draws(paths.history, _money(draws.where(year.between(first, last))))
        pipeline.extend(spark, paths, retain=0)
        pipeline.merge_parts(spark, paths, most=2, retain=0)
    return _summary(pipeline.load_calculated(spark, paths))


# ---- files written and read back -------------------------------------------


@query("read_raw_g5")
def read_raw_g5(spark, sf_dir):
    """Text records as quoted CSV with line breaks, read, parsed and cleaned."""
    path = scratch_path(spark, "raw")
    typed = T.raw_g5(T.stored_draws(spark, sf_dir)).select("draw_date", "results", "jackpot", "outcome")
    typed.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    parsed = raw.parse_balls(raw.read_raw_g5(spark, path))
    stored = scratch_path(spark, "clean")
    store.append_draws(stored, raw.to_draws(parsed, "g5"), "raw")
    return store.load_history(spark, stored).groupBy(iso()).agg(F.count("*").alias("draws"), F.sum(F.col("balls")[0] + F.col("bonus")).alias("numbers"))


@query("read_raw_g6")
def read_raw_g6(spark, sf_dir):
    """The same for the 6+1 game, which has no header row."""
    path = scratch_path(spark, "raw")
    typed = T.raw_g6(T.stored_draws(spark, sf_dir, G6)).select("year", "date", "series", "bonus")
    typed.write.option("quoteAll", True).option("escape", '"').csv(path)
    first = F.get("tokens", F.lit(0)).cast("int")
    return raw.read_raw_g6(spark, path).groupBy("year").agg(F.count("*").alias("draws"), F.sum(first).alias("numbers"))


@query("clean_file")
def clean_file(spark, sf_dir):
    """Clean draws stored by series, and as CSV with a column per slot, both read back."""
    draws = T.stored_draws(spark, sf_dir)
    path = scratch_path(spark, "clean")
    store.write_clean(draws, f"{path}/parquet")
    store.write_clean(draws.withColumn("draw_date", iso()), f"{path}/csv", fmt="csv")
    wide = ", ".join(["series string, draw_id bigint, draw_date string", *[f"b{i} int" for i in range(1, 6)], "bonus int, jackpot double, outcome string"])
    flat = spark.read.option("header", True).schema(wide).csv(f"{path}/csv")
    stored = store.load_draws(spark, f"{path}/parquet", schema=None).select(*KEYS, iso(), *B.wide(F.col("balls"), G5), "bonus")
    return stored.join(flat.select(*KEYS, F.col("b1").alias("csv_b1"), F.col("bonus").alias("csv_bonus"), "outcome"), [*KEYS])


@query("calculated_file")
def calculated_file(spark, sf_dir):
    """Draws with their features stored by series and read back."""
    path = scratch_path(spark, "calculated")
    store.write_calculated(pipeline.calculate(T.stored_draws(spark, sf_dir)), path)
    back = store.load_draws(spark, path, schema=None)
    return back.select(*KEYS, "seq", *B.wide(F.col("balls"), G5), "bonus", *show(CALCULATED))


@query("required_columns")
def required_columns(spark, sf_dir):
    """Which inputs of each feature set the stored draws lack, and whether they are refused."""
    draws = T.stored_draws(spark, sf_dir)
    rows = []
    for kind in sorted(features.FEATURE_SETS):
        names = [*features.feature_columns(kind), *KEYS]
        try:
            features.require_columns(draws, names)
            refused = False
        except ValueError:
            refused = True
        rows.append((kind, len([n for n in names if n not in draws.columns]), refused))
    counts = draws.agg(F.count("*").alias("draws"))
    return counts.select("draws", F.inline(F.array(*[F.struct(F.lit(k).alias("features"), F.lit(m).alias("missing"), F.lit(r).alias("refused")) for k, m, r in rows])))


@query("frequency_file")
def frequency_file(spark, sf_dir):
    """The frequency table as one CSV, from high to low, read back."""
    path = scratch_path(spark, "frequency")
    store.write_frequency(freq.frequency(T.stored_draws(spark, sf_dir)), path, order="high_low")
    return spark.read.option("header", True).schema("Number int, Frequency bigint").csv(path)


@query("prediction_file")
def prediction_file(spark, sf_dir):
    """The likelihood table as stored with a prediction of one day, read back."""
    history = T.stored_draws(spark, sf_dir)
    probs = L.empirical_probs(history)
    path = scratch_path(spark, "prediction")
    day = dt.date(2025, 4, 26)
    store.write_prediction(pipeline.predict(probs, history), L.number_likelihood(probs, places=PLACES), day, path)
    back = spark.read.parquet(f"{path}/likelihood")
    return back.select("number", "likelihood", F.col("run_date").cast("string").alias("run_date"))
