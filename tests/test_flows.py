"""Forests, ingest and streams."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from urnstat.functions import chance
from urnstat.operators import combos, forest, order, quality, trees
from urnstat.operators import frequency as freq
from urnstat.operators import likelihood as L
from urnstat.plans import pipeline
from urnstat.session import materialize
from urnstat.sources import store
from urnstat.streaming import intake

SMALL = {"num_trees": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def calculated(spark):
    rows = brute.make_rows(300, seed=2, series=("s",), weights=(1,))
    df = spark.createDataFrame(rows, "series string, draw_id bigint, day string, balls array<int>, bonus int")
    df = df.selectExpr("series", "draw_id", "cast(day as date) as draw_date", "balls", "bonus")
    return materialize(pipeline.calculate(df), "test")


@pytest.fixture(scope="module")
def models(calculated):
    return forest.fit_slots(calculated, **SMALL)


def test_one_forest_per_slot(models):
    rows = forest.fit_summary(models).orderBy("slot").collect()
    assert [r.slot for r in rows] == [1, 2, 3, 4, 5, 6]
    assert {(r.features, r.trees) for r in rows} == {(14, 3)}
    assert all(r.classes <= 51 for r in rows) and rows[-1].classes <= 21


def test_probabilities_sum_to_one(models, calculated):
    probs = forest.forest_probs(models, order.scoring_row(calculated))
    sums = {r.slot: r.p for r in probs.groupBy("slot").agg(F.sum("p").alias("p")).collect()}
    assert len(sums) == 6 and all(math.isclose(p, 1, abs_tol=1e-9) for p in sums.values())
    assert probs.agg(F.min("number")).first()[0] >= 1


def test_forest_probs_feed_the_scoring_operators(models, calculated):
    probs = forest.forest_probs(models, order.scoring_row(calculated)).select("slot", "number", "p")
    assert abs(sum(r.likelihood for r in L.number_likelihood(probs).collect()) - 100) < 0.5
    row = pipeline.predict(probs, calculated).first()
    assert row.balls == sorted(set(row.balls)) and len(row.balls) == 5 and 1 <= row.bonus <= 20


def test_series_keep_their_own_probabilities(spark, models, calculated):
    two = calculated.unionByName(calculated.where("seq < 200").withColumn("series", F.lit("t")))
    probs = forest.forest_probs(models, order.scoring_row(two), keys=("series",))
    sums = L.number_likelihood(probs, places=6, keys=("series",)).groupBy("series").agg(F.count("*").alias("n"), F.sum("likelihood").alias("p"))
    assert sorted((r.series, r.n, round(r.p, 3)) for r in sums.collect()) == [("s", 50, 100.0), ("t", 50, 100.0)]
    rows = pipeline.predict(probs, calculated, keys=("series",)).collect()
    drawn = {tuple(r.balls) for r in calculated.collect()}
    assert sorted(r.series for r in rows) == ["s", "t"] and all(tuple(r.balls) not in drawn for r in rows)


def test_holdout_is_not_worse_than_the_commonest_class(models, calculated):
    held = forest.train_split(calculated).where("not is_train")
    rows = {r.slot: r for r in forest.evaluate(models, held).collect()}
    for slot in range(1, 6):
        most = held.groupBy(F.col("balls")[slot - 1]).count().agg(F.max("count")).first()[0]
        assert rows[slot].accuracy * rows[slot].rows >= most - 3 * math.sqrt(most) - 1


def test_same_seed_same_forest(models, calculated):
    again = forest.fit_slots(calculated, **SMALL)
    row = order.scoring_row(calculated)
    key = lambda m: sorted((r.slot, r.number, r.p) for r in forest.forest_probs(m, row).collect())
    assert key(models) == key(again)


def test_kept_forests_score_alike(spark, models, calculated, tmp_path):
    forest.save(models, str(tmp_path))
    row = order.scoring_row(calculated)
    key = lambda m: sorted((r.slot, r.number, r.p) for r in forest.forest_probs(m, row).collect())
    assert key(forest.load(spark, str(tmp_path))) == key(models)


def test_scoring_in_many_passes(models, calculated, monkeypatch):
    key = lambda: sorted((r.slot, r.number, round(r.p, 9)) for r in forest.forest_probs(models, order.scoring_row(calculated)).collect())
    whole = key()
    monkeypatch.setattr(forest, "PASS_BYTES", 1)  # a tree at a time
    assert key() == whole


def _weights(rows, trees=3, rate=1.0):
    """A row's weights in plain Python: the number of steps of the Poisson distribution below its draw."""
    steps = list(itertools.accumulate(math.exp(-rate) * rate**k / math.factorial(k) for k in range(forest.MOST_WEIGHT)))
    out = {}
    for i in rows:
        draws = "".join(hashlib.md5(f"42:{i}:{n}".encode()).hexdigest() for n in range((trees + 3) // 4))
        us = [(int(draws[8 * t : 8 * t + 8], 16) + 0.5) / 2**32 for t in range(trees)]
        out[i] = [sum(u >= s for s in steps) for u in us]
    return out


@pytest.mark.parametrize("trees, rate", [(3, 1.0), (9, 0.2)])
def test_bootstrap_weights(calculated, trees, rate):
    found = calculated.select("draw_id", forest.bootstrap_weights(trees, rate).alias("w")).collect()
    assert {r.draw_id: r.w for r in found} == _weights([r.draw_id for r in found], trees, rate)


def test_out_of_bag_votes_by_hand(models, calculated):
    train = forest.train_split(calculated).where("is_train")
    rows = train.collect()
    unseen = {i: [t for t, n in enumerate(w) if n == 0] for i, w in _weights([r.draw_id for r in rows]).items()}
    grown = {(r.slot, r.tree): trees.Tree.unpacked([r[p] for p in forest.PARTS]) for r in models.trees.collect()}
    right = 0
    for r in rows:
        total = np.zeros(models.classes[1])
        for t in unseen[r.draw_id]:
            tree, at = grown[1, t], 0
            while tree.feature[at] >= 0:
                at = tree.left[at] + (float(r[models.features[tree.feature[at]]]) > tree.threshold[at])
            for k in range(tree.left[at], tree.left[at] + tree.size[at]):
                total[tree.label[k]] += tree.share[k] / len(unseen[r.draw_id])
        right += bool(unseen[r.draw_id]) and int(total.argmax()) == r.balls[0]
    voted = sum(map(bool, unseen.values()))
    found = {r.slot: r for r in forest.evaluate(models, train, out_of_bag=True).collect()}
    assert found[1].rows == len(rows) and found[1].unvoted == len(rows) - voted > 0
    assert math.isclose(found[1].voters, sum(map(len, unseen.values())) / len(rows))
    assert abs(found[1].accuracy * voted - right) < 1e-6


def test_a_tree_is_right_about_all_it_saw():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (400, 4)).astype(float)
    y, w = rng.integers(1, 9, 400), rng.integers(1, 4, 400)
    x[:50], x[50:60] = x[100:150], x[0]  # rows that no input tells apart
    tree, depth = trees.grow(x, y, w, 9, 2, rng)
    found = trees.votes(trees.grove([tree, tree], 9), x) / 2
    for i in range(400):
        same = (x == x[i]).all(1)
        share = np.bincount(y[same], w[same], 9) / w[same].sum()
        assert np.allclose(found[i], share, atol=1e-6)
    assert trees.grow(x, y, w, 9, 2, rng, max_depth=2)[1] == 2 < depth


def test_best_cut_equals_trying_all():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        x, y, w = rng.integers(0, 6, (n, 1)).astype(float), rng.integers(0, 3, n), rng.integers(1, 4, n)
        tree, depth = trees.grow(x, y, w, 3, 1, rng, max_depth=1)
        value = lambda part: (np.bincount(y[part], w[part], 3) ** 2).sum() / w[part].sum()
        cuts = {c: value(x[:, 0] <= c) + value(x[:, 0] > c) for c in np.unique(x)[:-1]}
        if depth and cuts:
            below = max(c for c in cuts if c <= tree.threshold[0])
            assert math.isclose(cuts[below], max(cuts.values()))
        else:
            assert not cuts or len(np.unique(y)) == 1


def test_longer_histories_are_sampled(calculated):
    small = forest.fit_slots(calculated, num_trees=20, sample_rows=60)
    whole = forest.fit_slots(calculated, num_trees=20)
    nodes = lambda m: m.trees.where("slot = 1").agg(F.avg("nodes")).first()[0]
    assert small.rate < 0.3 and whole.rate == 1.0 and nodes(small) < 0.6 * nodes(whole)


def test_samples_are_as_large_as_a_long_history(spark):
    n = 210_000
    draw = lambda i, top: (F.pmod(F.xxhash64("draw_id", F.lit(i)), F.lit(top)) + 1).cast("int")
    rows = spark.range(n).withColumnRenamed("id", "draw_id")
    rows = rows.select("draw_id", F.array(*[draw(i, 50) for i in range(5)]).alias("balls"), draw(5, 20).alias("bonus"), draw(6, 300).alias("a"))
    models = forest.fit_slots(rows, num_trees=1, max_depth=2, ratio=None, features=["a"])
    seen = rows.select("a", "bonus", forest.bootstrap_weights(1)[0].alias("w")).where("w > 0").toArrow()
    x, y, w = (c.to_numpy() for c in seen.columns)
    tree, _ = trees.grow(x[:, None].astype(float), y, w, 21, 1, np.random.default_rng([42, 0, 6]), 2)
    row = models.trees.where("slot = 6").first()
    assert models.rate == 1.0 and 0.99 * n < w.sum() < 1.01 * n
    assert tree.packed() == tuple(bytes(row[p]) for p in forest.PARTS)


def test_samples_travel_as_codes():
    """Columns of few, of over 256 and of over 65,536 different values, in blocks that have different ones."""
    rng = np.random.default_rng(6)
    blocks, want = [], []
    for n, least in ((70_000, 0.0), (300, -5.5), (1, 9.0), (0, 0.0)):
        x = np.stack([rng.integers(0, 3, n) / 7 + least, rng.integers(0, 3000, n) / 8, np.arange(n) * 0.1 + least])
        y, w = rng.integers(1, 51, (2, n)), rng.integers(1, 9, n).astype("uint8")
        head, planes = forest._coded_block(np.concatenate([x, y]))
        blocks.append((head, w.tobytes() + planes.tobytes()))
        want.append((x, y, w))
    found, y, w = forest._uncoded(blocks, 3, 2)
    x, *rest = (np.concatenate(c, -1) for c in zip(*want))
    assert all((found.values[f][found.code[:, f]] == x[f]).all() for f in range(3))
    assert (y == rest[0]).all() and (w == rest[1]).all()


def test_split_is_stable_and_near_its_ratio(calculated):
    split = forest.train_split(calculated)
    ids = {r.draw_id for r in split.where("is_train").collect()}
    assert ids == {r.draw_id for r in forest.train_split(calculated.repartition(5)).where("is_train").collect()}
    assert 0.7 < len(ids) / calculated.count() < 0.9


def test_holdout(models, calculated):
    rows = forest.evaluate(models, forest.train_split(calculated).where("not is_train")).collect()
    assert [r.slot for r in rows] == [1, 2, 3, 4, 5, 6]
    assert all(0 <= r.accuracy <= 1 and 0 <= r.hits <= 5 for r in rows)


def test_hypothetical_scores(models, calculated):
    models13 = forest.fit_slots(calculated, kind=13, **SMALL)
    cands = calculated.select(F.col("draw_id").alias("cand_id"), "balls", "bonus")
    inputs = combos.hypothetical_features(cands, calculated)
    first = inputs.first()
    assert first["prev_common_count"] == 0 and first["max"] == calculated.agg(F.max("max")).first()[0]
    scored = forest.score_hypothetical(models13, inputs)
    assert scored.count() == calculated.count()
    assert scored.where("score < 0 or score > 100 or score is null").isEmpty()


def test_forests_on_the_draw_before(calculated):
    """Inputs of the draw before say next to nothing about a draw, so the first slot is no longer read off."""
    names = ["min", "max", "sum_with_bonus", "has_consecutive"]
    lagged = order.lagged(calculated, names)
    rows = {r.seq: r for r in lagged.collect()}
    assert rows[0].prev_min is None and all(rows[i].prev_min == rows[i - 1]["min"] for i in range(1, len(rows)))
    models = forest.fit_slots(lagged, num_trees=10, features=[f"prev_{n}" for n in names])
    held = forest.train_split(lagged).where("not is_train and seq > 0")
    found = {r.slot: r for r in forest.evaluate(models, held).collect()}
    assert found[1].rows == held.count() and found[1].accuracy < 0.4


def test_training_on_slices(calculated):
    models, report = pipeline.train_on_slice(calculated, pipeline.Recent(50), **SMALL)
    row = report.first()
    assert (row.model, row.draws, row.features, row.targets, row.trees) == ("Recent Draws", 50, 14, 6, 3)
    part = pipeline.DateRange("2020-02-01", "2020-06-30")
    row = pipeline.train_on_slice(calculated, part, **SMALL)[1].first()
    assert row.first_date.isoformat() >= "2020-02-01" and row.last_date.isoformat() <= "2020-06-30"
    with pytest.raises(ValueError, match="at least 10"):
        pipeline.train_on_slice(calculated, pipeline.Recent(9))


TYPED = "series string, draw_id long, draw_date_raw string, balls array<int>, bonus int, jackpot string, outcome string"
NEW = [
    ("s", 1, "Friday 25 April 2025", [5, 9, 13, 46, 47], 11, "R1", "Roll"),
    ("s", 2, "Tuesday 29 April 2025", [5, 9, 13, 46, 48], 11, "R1", "Roll"),
    ("s", 3, "Friday 2 May 2025", [5, 5, 13, 46, 48], 11, "R1", "Roll"),
    ("t", 4, "Friday 2 May 2025", [1, 2, 3, 4, 51], 21, "R1", "Won"),
    ("t", 5, "someday", [1, 2, 3, 4, 50], 20, "R1", "Won"),
]


def test_ingest(spark, tmp_path):
    paths = pipeline.Paths(str(tmp_path))
    pipeline.ingest(spark, spark.createDataFrame(NEW[:1], TYPED), paths)
    pipeline.ingest(spark, spark.createDataFrame(NEW[1:], TYPED), paths)
    table = pipeline.load_calculated(spark, paths).orderBy("draw_id").collect()
    assert [(r.draw_id, r.seq, r.prev_common_count) for r in table] == [(1, 0, 0), (2, 1, 4), (5, 0, 0)]
    assert table[2].draw_date is None
    counts = {r.number: r.frequency for r in pipeline.load_frequency(spark, paths).collect()}
    assert counts[5] == 2 and counts[11] == 2 and counts[50] == 1 and sum(counts.values()) == 18
    rejects = {r.draw_id: r.errors for r in spark.read.parquet(paths.rejects).collect()}
    assert rejects == {
        3: ["Main numbers must be unique"],
        4: ["Main number 5 must be between 1 and 50", "Bonus number must be between 1 and 20"],
    }


def test_stream_reaches_the_batch_state(spark, tmp_path):
    landing = f"{tmp_path}/landing"
    paths = pipeline.Paths(str(tmp_path))

    def run():
        intake.start_intake(intake.read_landing(spark, landing, files_per_trigger=1), paths, f"{tmp_path}/c1").awaitTermination()
        intake.start_frequency(intake.read_landing(spark, landing, files_per_trigger=1), f"{tmp_path}/f", f"{tmp_path}/c2").awaitTermination()

    for part in (NEW[:2], NEW[2:]):
        spark.createDataFrame(part, TYPED).coalesce(1).write.mode("append").json(landing)
        run()
    history = store.load_history(spark, paths.history)
    assert sorted(r.draw_id for r in history.collect()) == [1, 2, 5]
    want = freq.frequency(pipeline.typed(quality.validate_draws(spark.createDataFrame(NEW, TYPED))))
    got = intake.latest_frequency(spark, f"{tmp_path}/f").select("number", "frequency")
    assert sorted(got.collect()) == sorted(want.collect())
    assert spark.read.parquet(paths.rejects).count() == 2
    pipeline.refresh(spark, paths)
    assert pipeline.load_calculated(spark, paths).count() == 3


def typed_rows(spark, rows):
    df = spark.createDataFrame(rows, "series string, draw_id bigint, day string, balls array<int>, bonus int")
    return df.selectExpr(
        "series",
        "draw_id",
        "date_format(cast(day as date), 'EEEE d MMMM yyyy') as draw_date_raw",
        "balls",
        "bonus",
        "'R1' as jackpot",
        "'Roll' as outcome",
    )


def state(spark, paths):
    rows = sorted(pipeline.load_calculated(spark, paths).drop("batch").collect(), key=lambda r: r.draw_id)
    names = sorted(set(rows[0].asDict()))
    return [tuple(str(r[n]) for n in names) for r in rows], sorted(pipeline.load_frequency(spark, paths).collect())


def parts(spark, paths):
    """Part → the series whose live rows it holds."""
    rows = pipeline.load_calculated(spark, paths).select("batch", "series").distinct().collect()
    return {b: sorted(r.series for r in rows if r.batch == b) for b in {r.batch for r in rows}}


def same_as_at_once(spark, paths, rows, tmp_path, name):
    whole = pipeline.Paths(f"{tmp_path}/{name}")
    pipeline.ingest(spark, typed_rows(spark, rows), whole)
    assert state(spark, paths) == state(spark, whole)


def test_later_draws_extend_the_tables(spark, tmp_path):
    rows = sorted((r for r in brute.make_rows(120, seed=4) if r[2]), key=lambda r: (r[2], r[1]))
    days = sorted({r[2] for r in rows})
    cuts = [
        [r for r in rows if r[2] < days[60]],
        [r for r in rows if days[60] <= r[2] < days[63]],
        [r for r in rows if r[2] >= days[63]] + [("new", 9999, "2021-01-01", [1, 2, 3, 4, 5], 6)],
    ]
    grown = pipeline.Paths(f"{tmp_path}/grown")
    for i, part in enumerate(cuts):
        pipeline.ingest(spark, typed_rows(spark, part), grown, batch=f"b{i}")
    assert len(parts(spark, grown)) == 3
    same_as_at_once(spark, grown, sum(cuts, []), tmp_path, "whole")
    # The same batch again changes nothing.
    pipeline.ingest(spark, typed_rows(spark, cuts[2]), grown, batch="b2")
    same_as_at_once(spark, grown, sum(cuts, []), tmp_path, "twice")
    # An earlier draw moves the rows of its own series only.
    before = parts(spark, grown)
    early = [("a", 7777, "2019-01-01", [6, 7, 8, 9, 10], 1)]
    pipeline.ingest(spark, typed_rows(spark, early), grown)
    after = parts(spark, grown)
    assert [after[b] for b in before] == [[s for s in names if s != "a"] for names in before.values()]
    assert [names for b, names in after.items() if b not in before] == [["a"]]
    same_as_at_once(spark, grown, sum(cuts, early), tmp_path, "again")


def stream_in(spark, rows, paths, root):
    typed_rows(spark, rows).coalesce(1).write.mode("append").json(f"{root}/landing")
    intake.start_intake(intake.read_landing(spark, f"{root}/landing"), paths, f"{root}/checkpoint").awaitTermination()


def test_streams_batches_and_appends_mix(spark, tmp_path):
    rows = [r for r in brute.make_rows(40, seed=8) if r[2]]
    paths = pipeline.Paths(f"{tmp_path}/mixed")
    pipeline.ingest(spark, typed_rows(spark, rows[:10]), paths)
    stream_in(spark, rows[10:20], paths, f"{tmp_path}/one")
    stream_in(spark, rows[20:25], paths, f"{tmp_path}/two")
    # Appended by someone who does not care for the other tables.
    store.append_draws(paths.history, pipeline.typed(quality.validate_draws(typed_rows(spark, rows[25:30]))), "bare")
    pipeline.ingest(spark, typed_rows(spark, rows[30:]), paths)
    same_as_at_once(spark, paths, rows, tmp_path, "whole")


def test_a_crash_before_the_coverage_leaves_no_trace(spark, tmp_path, monkeypatch):
    rows = [r for r in brute.make_rows(30, seed=9) if r[2]]
    paths = pipeline.Paths(f"{tmp_path}/crash")
    pipeline.ingest(spark, typed_rows(spark, rows[:10]), paths)
    with monkeypatch.context() as patch:
        patch.setattr(pipeline, "_save_coverage", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipeline.ingest(spark, typed_rows(spark, rows[10:20]), paths)
    assert len(state(spark, paths)[0]) == len(rows[:10])
    pipeline.ingest(spark, typed_rows(spark, rows[20:]), paths)
    same_as_at_once(spark, paths, rows, tmp_path, "whole")


def _history(spark, start, stop):
    """Draws of two series by date; the ids follow the dates."""
    rows = [("ab"[i % 2], i, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", [1 + (i * k) % 46 + k for k in range(1, 5)] + [50], 1 + i % 20) for i in range(start, stop)]
    df = spark.createDataFrame(rows, "series string, draw_id bigint, day string, balls array<int>, bonus int")
    blank = F.lit(None).cast("string")
    df = df.select("series", "draw_id", F.col("day").cast("date").alias("draw_date"), F.sort_array("balls").alias("balls"), "bonus", blank.alias("jackpot"), blank.alias("outcome"))
    return df


def _folders(path):
    return sorted(f.name for f in path.iterdir() if f.name.startswith("batch="))


def _named(spark, paths, kind):
    covered = pipeline.load_coverage(spark, paths)[0]
    return sorted({f"batch={r['name']}" for r in covered.where(F.col("kind") == kind).collect()})


def test_of_two_writers_one_commits_and_the_other_goes_on(spark, tmp_path, monkeypatch):
    paths = pipeline.Paths(str(tmp_path))
    store.append_draws(paths.history, _history(spark, 0, 20), "a")
    pipeline.refresh(spark, paths)
    store.append_draws(paths.history, _history(spark, 20, 30), "b")
    save, calls = pipeline._save_coverage, []

    def meanwhile(rows, places, version):
        calls.append(version)
        if len(calls) == 1:
            store.append_draws(paths.history, _history(spark, 30, 40), "c")
            assert pipeline.extend(spark, paths)
        save(rows, places, version)

    monkeypatch.setattr(pipeline, "_save_coverage", meanwhile)
    assert pipeline.extend(spark, paths)
    # The loser found its batches done by the winner; what it had written is gone.
    assert calls == [1, 1] and pipeline.load_coverage(spark, paths)[1] == 1
    assert _folders(tmp_path / "calculated") == _named(spark, paths, pipeline.CALCULATED)
    assert _folders(tmp_path / "frequency") == _named(spark, paths, pipeline.FREQUENCY)
    grown = pipeline.load_calculated(spark, paths).drop("batch")
    whole = pipeline.calculate(_history(spark, 0, 40))
    assert sorted(map(str, grown.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_parts_are_merged_and_dead_ones_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "MOST_PARTS", 3)
    paths = pipeline.Paths(str(tmp_path))
    store.append_draws(paths.history, _history(spark, 0, 20), "a")
    pipeline.refresh(spark, paths)
    before = pipeline.load_calculated(spark, paths)
    for n in range(2, 9):
        store.append_draws(paths.history, _history(spark, 10 * n, 10 * n + 10), f"b{n}")
        if n == 4:
            reader = pipeline.load_calculated(spark, paths)
        pipeline.extend(spark, paths, retain=0 if n > 4 else 3600)
        if n == 4:
            assert before.count() == 20 and reader.count() == 40  # both began before the merge
    for table in ("calculated", "frequency"):
        assert len(_folders(tmp_path / table)) <= 2 * 3
    assert len(list((tmp_path / "coverage").glob("version=*"))) <= 2 + 3
    grown, whole = pipeline.load_calculated(spark, paths), pipeline.calculate(_history(spark, 0, 90))
    assert sorted(map(str, grown.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    counts = {r.number: r.frequency for r in pipeline.load_frequency(spark, paths).collect() if r.frequency}
    assert counts == {r.number: r.frequency for r in freq.frequency(_history(spark, 0, 90)).collect() if r.frequency}


def test_slices_read_only_the_parts_of_their_dates(spark, tmp_path):
    paths = pipeline.Paths(str(tmp_path))
    store.append_draws(paths.history, _history(spark, 0, 28), "a")
    pipeline.refresh(spark, paths)
    for n in (1, 2):
        store.append_draws(paths.history, _history(spark, 28 * n, 28 * n + 28), f"b{n}")
        pipeline.extend(spark, paths)
    whole = pipeline.load_calculated(spark, paths).drop("batch").cache()
    parts = [n.removeprefix("batch=") for n in _named(spark, paths, pipeline.CALCULATED)]
    plans = [pipeline.load_slice(spark, paths, p)._jdf.queryExecution().executedPlan().toString() for p in (pipeline.DateRange("2020-01-05", "2020-01-20"), pipeline.Recent(10))]
    first, last = [[n for n in parts if n in text] for text in plans]
    assert len(parts) == 3 and len(first) == len(last) == 1 and first != last
    assert all("PartitionFilters: [isnotnull(batch" in text for text in plans)
    for part in (pipeline.DateRange("2020-01-05", "2020-02-10"), pipeline.DateRange("2021-01-01", "2021-02-01"), pipeline.Recent(10), pipeline.Recent(20), pipeline.Recent(1000)):
        got = pipeline.load_slice(spark, paths, part).select(*whole.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, part.apply(whole).select(*whole.columns).collect()))


def test_dynamic_overwrite_changes_nothing(spark, tmp_path):
    rows = [r for r in brute.make_rows(20, seed=10) if r[2]]
    paths = pipeline.Paths(f"{tmp_path}/dynamic")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        pipeline.ingest(spark, typed_rows(spark, rows), paths, batch="b")
        pipeline.ingest(spark, typed_rows(spark, rows[:5]), paths, batch="b")
        pipeline.refresh(spark, paths)
        same_as_at_once(spark, paths, rows[:5], tmp_path, "whole")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_flows_leave_nothing_in_the_scratch_area(spark, tmp_path):
    from pathlib import Path

    from urnstat.session import scratch_path

    rows = [r for r in brute.make_rows(30, seed=11) if r[2]]
    paths = pipeline.Paths(f"{tmp_path}/scratch")
    area = Path(scratch_path(spark, "x")).parent
    count = lambda: len(list(area.iterdir())) if area.exists() else 0
    before = count()
    for part in (rows[:10], rows[10:20], rows[5:15], rows[20:]):
        pipeline.ingest(spark, typed_rows(spark, part), paths)
        assert count() == before


def test_trees_travel_thin(models):
    for row in models.trees.collect():
        tree = trees.Tree.unpacked([row[p] for p in forest.PARTS])
        sent = tree.thin()
        again = trees.Tree.thick(sent)
        assert all(np.array_equal(getattr(tree, p), getattr(again, p)) for p in forest.PARTS)
        if row.nodes > 100:
            assert len(sent) * 3 < sum(len(row[p]) for p in forest.PARTS)


def test_rows_with_the_same_inputs_are_walked_once(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (300, 3)).astype(float)
    y, w = rng.integers(1, 5, 300), np.ones(300, int)
    tree = trees.grow(x, y, w, 5, 2, rng)[0]
    walked, walker = [], trees._walker

    def counted(tree):
        walk = walker(tree)
        return lambda rows: walked.append(len(rows)) or walk(rows)

    monkeypatch.setattr(trees, "_walker", counted)
    mask = rng.random((300, 2)) < 0.5
    found = trees.votes(trees.grove([tree, tree], 5), x, mask)
    assert sum(walked) == 2 * len(np.unique(x, axis=0)) < 300
    one = trees.votes(trees.grove([tree], 5), x)
    assert np.allclose(found, one * mask.sum(1)[:, None])


def test_equal_rows_are_voted_on_once():
    rng = np.random.default_rng(4)
    different = rng.random((40, 3))
    same = rng.permutation(np.arange(200) % 40)
    tree = trees.grow(different, rng.integers(0, 5, 40), np.ones(40), 5, 2, rng)[0]
    want = trees.votes(trees.grove([tree, tree], 5), different, np.ones((40, 2), bool))
    asked, size = [], tree.size

    class Counted:
        def __getitem__(self, leaf):
            asked.append(len(leaf))
            return size[leaf]

    tree.size = Counted()
    assert (trees.votes(trees.grove([tree, tree], 5), different[same]) == want[same]).all()
    assert asked == [40, 40]
    assert trees.votes(trees.grove([tree], 5), np.empty((0, 3))).shape == (0, 5)


def test_made_up_combinations_are_scored_by_their_different_inputs(calculated, monkeypatch):
    models13 = forest.fit_slots(calculated, kind=13, **SMALL)
    cands = calculated.select(F.col("draw_id").alias("cand_id"), "balls", "bonus")
    inputs = combos.hypothetical_features(cands, calculated)
    whole = {r.cand_id: r.score for r in forest.score_hypothetical(models13, inputs).collect()}
    asked, scored = [], forest.scored
    monkeypatch.setattr(forest, "scored", lambda models, rows, *more, **named: asked.append(rows.count()) or scored(models, rows, *more, **named))
    twice = inputs.union(inputs.withColumn("cand_id", F.col("cand_id") + 10_000))
    found = {r.cand_id: r.score for r in forest.score_hypothetical(models13, twice).collect()}
    assert asked == [inputs.select(*models13.features).distinct().count()]
    assert len(found) == 2 * len(whole) and all(found[i] == found[i + 10_000] == whole[i] for i in whole)


def test_made_up_combinations_are_computed_once(calculated):
    """Inputs that come out otherwise when computed again, as sums in another order do, lose no row."""
    models13 = forest.fit_slots(calculated, kind=13, **SMALL)
    cands = calculated.select(F.col("draw_id").alias("cand_id"), "balls", "bonus")
    noise = F.udf(lambda v: v + random.random() / 1e6, "double").asNondeterministic()
    inputs = combos.hypothetical_features(cands, calculated)
    inputs = inputs.withColumn("std", noise("std"))
    assert forest.score_hypothetical(models13, inputs).count() == calculated.count()


def test_every_tree_is_grown_in_a_task_of_its_own(calculated):
    trees_ = forest.fit_slots(calculated, num_trees=20).trees
    found = trees_.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("tree").alias("n")).collect()
    assert [r.n for r in found] == [1] * 20


def test_trees_equal_those_of_all_rows_of_their_samples(calculated):
    """Rows leave in blocks, by their codes, those alike as one: nothing of it shows in a tree."""
    twice = calculated.unionByName(calculated.withColumn("draw_id", F.col("draw_id") + 100_000))
    models = forest.fit_slots(twice, num_trees=35, sample_rows=150)
    rows = forest.train_split(twice).where("is_train").withColumn("w", forest.bootstrap_weights(35, models.rate)).collect()
    assert models.rate < 1
    x = np.array([[float(r[c]) for c in models.features] for r in rows])
    grown = {(r.slot, r.tree): r for r in models.trees.collect()}
    assert len(grown) == 35 * 6
    for number in (0, 34):
        w = np.array([r.w[number] for r in rows])
        for slot in (1, 6):
            y = np.array([r.bonus if slot == 6 else r.balls[slot - 1] for r in rows])
            tree, depth = trees.grow(x[w > 0], y[w > 0], w[w > 0], models.classes[slot], 3, np.random.default_rng([42, number, slot]))
            row = grown[slot, number]
            assert depth == row.depth and tree.packed() == tuple(bytes(row[p]) for p in forest.PARTS)


def test_bootstrap_digests_are_compiled(spark, capsys):
    """They are plain columns without a lambda, and say what ``chance.digest`` says, also of null keys."""
    keys = spark.createDataFrame([(7,), (-3,), (None,), (10**12,)], "k bigint")
    found = keys.select(F.array(*forest._digests(9, 42, "k")).alias("d"), F.array(*[chance.digest(42, F.col("k"), F.lit(i)) for i in range(3)]).alias("want"))
    assert all(r.d == r.want and len(r.d) == 3 for r in found.collect())
    found.select("d").explain()
    assert "lambda" not in capsys.readouterr().out


def test_rows_alike_are_put_together():
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 3, (200, 3)) / 7, rng.integers(0, 4, 200), rng.integers(1, 5, 200)
    inputs, which = trees.Coded.of(x).different()
    few, label, weight = trees.together(inputs, which, y, w, 4)
    value = lambda c: tuple(c.values[f][p] for f, p in enumerate(c.code[i]))
    found = {}
    for i in range(len(label)):
        assert (value(few), label[i]) not in found
        found[value(few), label[i]] = weight[i]
    want = {}
    for row, c, n in zip(x, y, w):
        want[tuple(row), c] = want.get((tuple(row), c), 0) + n
    assert found == want and len(found) < 200
