"""Whole flows: calculate, train on a slice, predict, ingest, refresh."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urnstat.functions import text
from urnstat.games import G5, GameSpec
from urnstat.operators import filters, forest, matching, order
from urnstat.operators import frequency as freq
from urnstat.operators import likelihood as L
from urnstat.operators import quality
from urnstat.operators.features import row_features
from urnstat.session import materialize, scratch_scope
from urnstat.sources import store
from urnstat.sources.raw import DRAWS

#: The history with the name of the batch each row came in.
DRAWS_BY_BATCH = T.StructType([*DRAWS.fields, T.StructField("batch", T.StringType())])


def calculate(clean: DataFrame, spec: GameSpec = G5, direction: str = "past") -> DataFrame:
    """Clean draws → draws with ``seq`` and every feature.

    Two shuffles whatever the number of features: one to find positions, one
    for the look-back blocks.
    """
    return row_features(order.history_features(order.with_seq(clean), spec, direction), spec)


# ---- training slices -------------------------------------------------------


@dataclass(frozen=True)
class DateRange:
    start: str
    end: str

    def apply(self, df: DataFrame) -> DataFrame:
        return filters.filter_dates(df, self.start, self.end)

    @property
    def label(self) -> str:
        return "Custom Date Range"


@dataclass(frozen=True)
class Recent:
    n: int

    def apply(self, df: DataFrame) -> DataFrame:
        return filters.filter_recent(df, self.n)

    @property
    def label(self) -> str:
        return "Recent Draws"


def take_slice(df: DataFrame, part: DateRange | Recent | None) -> DataFrame:
    return df if part is None else part.apply(df)


def training_report(df: DataFrame, part: DateRange | Recent | None, models: forest.SlotModels) -> DataFrame:
    """Draws and date span of a training slice and what was fitted on it, one row."""
    label = "Full Dataset" if part is None else part.label
    return take_slice(df, part).agg(
        F.lit(label).alias("model"),
        F.count("*").alias("draws"),
        F.min("draw_date").alias("first_date"),
        F.max("draw_date").alias("last_date"),
        F.lit(len(models.features)).alias("features"),
        F.lit(len(models.slots)).alias("targets"),
        F.lit(models.num_trees).alias("trees"),
    )


def train_on_slice(
    calculated: DataFrame,
    part: DateRange | Recent | None = None,
    spec: GameSpec = G5,
    kind: int = 14,
    num_trees: int = 100,
    **fit,
) -> tuple[forest.SlotModels, DataFrame]:
    """Fit on a slice, or on everything, after checking its size.

    The report is built last, so a refused slice leaves no trace of itself.
    """
    rows = take_slice(calculated, part)
    found = rows.limit(filters.MIN_TRAIN_ROWS).count()
    if found < filters.MIN_TRAIN_ROWS:
        raise ValueError(f"need at least {filters.MIN_TRAIN_ROWS} draws for training, got {found}")
    models = forest.fit_slots(rows, spec, kind, num_trees=num_trees, **fit)
    return models, training_report(calculated, part, models)


def predict(
    probs: DataFrame, history: DataFrame, spec: GameSpec = G5, seed: int = 42, keys: Sequence[str] = ()
) -> DataFrame:
    """Best number per slot → a legal combination that was not drawn before, one for each of ``keys``."""
    slots = L.predict_slots(probs, keys)
    mains = F.collect_list(F.when(F.col("slot") <= spec.slots, F.struct("slot", "number")))
    bonus = F.max(F.when(F.col("slot") == spec.bonus_slot, F.col("number")))
    one = slots.groupBy(*keys).agg(F.sort_array(mains).alias("_m"), bonus.alias("bonus"))
    # A key of its own for each prediction, 0 where there is only one.
    number = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    pred = one.select(*keys, number.alias("pred_id"), F.col("_m.number").alias("balls"), "bonus")
    return matching.avoid_drawn(matching.complete_prediction(pred, spec, seed), history, spec, seed)


# ---- stored tables ---------------------------------------------------------


@dataclass(frozen=True)
class Paths:
    """Where the tables of one game live."""

    root: str

    @property
    def history(self) -> str:
        return f"{self.root}/history"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def calculated(self) -> str:
        return f"{self.root}/calculated"

    @property
    def frequency(self) -> str:
        return f"{self.root}/frequency"

    @property
    def dates(self) -> str:
        return f"{self.root}/dates"

    @property
    def coverage(self) -> str:
        return f"{self.root}/coverage"

    @property
    def derived(self) -> tuple[str, ...]:
        """Tables whose parts a coverage names."""
        return self.calculated, self.frequency, self.dates


def typed(checked: DataFrame) -> DataFrame:
    """Accepted typed-in draws as history rows."""
    return quality.accepted(checked).select(
        "series",
        "draw_id",
        text.parse_draw_date(F.col("draw_date_raw")).alias("draw_date"),
        "balls",
        "bonus",
        "jackpot",
        "outcome",
    )


# What the stored tables hold: history batches that are in them, the parts that hold
# the live rows of each series, the parts whose counts add up.
COVERAGE = "kind string, name string, series string"
HISTORY, CALCULATED, FREQUENCY = "history", "calculated", "frequency"
#: More history batches than this at once are taken by a rebuild.
MOST_FRESH = 1000


#: Parts of the calculated table from which they are merged into one.
MOST_PARTS = 64
#: Seconds for which readers of a former state find its parts.
RETAIN = 24 * 3600


class LostRace(Exception):
    """Another writer committed the same version first."""


def load_coverage(spark: SparkSession, paths: Paths) -> tuple[DataFrame, int] | None:
    """The newest coverage table and its version; None before the first one."""
    versions = [v for v, _ in _versions(spark, paths)]
    return (_coverage(spark, paths, versions[-1]), versions[-1]) if versions else None


def _coverage(spark: SparkSession, paths: Paths, version: int) -> DataFrame:
    return spark.read.schema(COVERAGE).parquet(f"{paths.coverage}/version={version}")


def _folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names and times of change, in seconds, of the folders in a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in files.listStatus(place) if f.isDirectory()]


def _versions(spark: SparkSession, paths: Paths) -> list[tuple[int, float]]:
    """Committed versions and their times, oldest first."""
    found = [(int(name.split("=")[1]), at) for name, at in _folders(spark, paths.coverage) if name.startswith("version=")]
    return sorted(found)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _save_coverage(rows: DataFrame, paths: Paths, version: int) -> None:
    """Commit a version: it is written aside and renamed, which only one writer can do.

    Needs a file system whose rename fails where the target exists, as HDFS and local
    ones do. Raises ``LostRace`` where another writer was first.
    """
    spark = rows.sparkSession
    aside = f"{paths.coverage}/_aside/{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(aside)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    qualified = path(aside).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified
    source, target = qualified(path(aside)), qualified(path(f"{paths.coverage}/version={version}"))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        files.rename(source, target, how)
    except Py4JJavaError as error:
        if not files.util().exists(target):
            raise
        _remove(spark, aside)
        raise LostRace(version) from error


def _committed(spark: SparkSession, paths: Paths, work) -> bool:
    """Run ``work(part)`` until its commit is the first of its version; what a lost run wrote is removed."""
    while True:
        part = uuid.uuid4().hex
        try:
            return work(part)
        except LostRace:
            for table in paths.derived:
                _remove(spark, f"{table}/batch={part}")


def _covered(state: DataFrame, kind: str) -> DataFrame:
    return state.where(F.col("kind") == kind)


def _of_kind(rows: DataFrame, kind: str, name, series=None) -> DataFrame:
    series = F.lit(None).cast("string") if series is None else series
    return rows.select(F.lit(kind).alias("kind"), name.alias("name"), series.alias("series"))


def _history(spark: SparkSession, paths: Paths) -> DataFrame:
    return store.load_draws(spark, paths.history, DRAWS_BY_BATCH)


def refresh(spark: SparkSession, paths: Paths, spec: GameSpec = G5) -> None:
    """Rebuild the calculated and frequency tables from the stored history.

    The new rows are parts of their own; readers go over to them with the coverage.
    """
    with scratch_scope(spark):
        _committed(spark, paths, lambda part: _refresh(spark, paths, spec, part))


def _write_part(rows: DataFrame, counts: DataFrame, paths: Paths, part: str) -> None:
    """One part of the tables: rows by series, frequencies, and draws of each series and date."""
    spark = rows.sparkSession
    store.write_batch(rows, paths.calculated, part, "series")
    store.write_batch(counts.coalesce(1), paths.frequency, part)
    path = f"{paths.calculated}/batch={part}"
    written = store.load_draws(spark, path, schema=None) if _folders(spark, path) else rows
    dates = written.groupBy(F.col("series").cast("string").alias("series"), "draw_date").agg(F.count("*").alias("rows"))
    store.write_batch(dates.coalesce(1), paths.dates, part)


def _refresh(spark: SparkSession, paths: Paths, spec: GameSpec, part: str) -> bool:
    state = load_coverage(spark, paths)
    # A batch that lands meanwhile is neither in the rows nor in the coverage.
    names = materialize(_history(spark, paths).select(F.col("batch").alias("_name")).distinct(), "batches")
    history = _history(spark, paths).join(names, F.col("batch") == F.col("_name"), "left_semi").drop("batch")
    _write_part(calculate(history, spec), freq.frequency(history, spec), paths, part)
    rows = _of_kind(names, HISTORY, F.col("_name"))
    rows = rows.union(_of_kind(history.select("series").distinct(), CALCULATED, F.lit(part), F.col("series")))
    rows = rows.union(_of_kind(spark.range(1), FREQUENCY, F.lit(part)))
    _save_coverage(rows, paths, state[1] + 1 if state else 0)
    return False


def _live(spark: SparkSession, paths: Paths, state: DataFrame) -> DataFrame:
    parts = _covered(state, CALCULATED).select("name", F.col("series").alias("_name"))
    table = store.load_draws(spark, paths.calculated, schema=None).withColumn("series", F.col("series").cast("string"))
    return table.join(parts, (F.col("batch") == F.col("name")) & _same_series(), "left_semi")


def load_calculated(spark: SparkSession, paths: Paths) -> DataFrame:
    """The live rows of every series; ``batch`` names the part that holds them."""
    state = load_coverage(spark, paths)
    return store.load_draws(spark, paths.calculated, schema=None) if state is None else _live(spark, paths, state[0])


def load_slice(spark: SparkSession, paths: Paths, part: DateRange | Recent) -> DataFrame:
    """A slice of the calculated draws, read from the parts that hold its dates.

    The table of dates, one row per part, series and date, names them before any draw is
    read; merging keeps the parts few.
    """
    state = load_coverage(spark, paths)
    if state is None:
        return part.apply(load_calculated(spark, paths))
    live = _covered(state[0], CALCULATED).select("name", F.col("series").alias("_name"))
    dates = spark.read.schema("series string, draw_date date, rows bigint, batch string").parquet(paths.dates)
    dates = dates.join(live, (F.col("batch") == F.col("name")) & _same_series(), "left_semi")
    if isinstance(part, DateRange):
        wanted = filters.filter_dates(dates, part.start, part.end)
    else:
        # Dates until the newer ones alone are enough; undated draws are the oldest.
        newest = Window.partitionBy("series").orderBy(F.col("draw_date").desc_nulls_last())
        days = dates.groupBy("series", "draw_date").agg(F.sum("rows").alias("rows"))
        newer = F.coalesce(F.sum("rows").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        days = days.withColumn("_newer", newer).where(F.col("_newer") < part.n)
        days = days.select(F.col("series").alias("_name"), F.col("draw_date").alias("_date"))
        wanted = dates.join(days, _same_series() & F.col("draw_date").eqNullSafe(F.col("_date")), "left_semi")
    names = sorted(r["batch"] for r in wanted.select("batch").distinct().collect())
    rows = _live(spark, paths, state[0]).where(F.col("batch").isin(names))
    return part.apply(rows.drop("batch"))


def load_frequency(spark: SparkSession, paths: Paths) -> DataFrame:
    """Frequencies over all live parts; every part holds one row per number."""
    counts = spark.read.parquet(paths.frequency)
    if state := load_coverage(spark, paths):
        counts = counts.join(_covered(state[0], FREQUENCY).select("name"), F.col("batch") == F.col("name"), "left_semi")
    return counts.groupBy("number").agg(F.sum("frequency").alias("frequency"))


def _same_series():
    return F.col("series").eqNullSafe(F.col("_name"))


def _late_series(tail: DataFrame, fresh: DataFrame) -> DataFrame:
    """``_name`` of the series with a new draw that is not later than all stored ones."""
    place = F.struct("draw_date", "draw_id")
    last = tail.groupBy(F.col("series").alias("_name")).agg(F.max(place).alias("_last"))
    first = fresh.groupBy("series").agg(F.min(place).alias("_first"))
    late = first.join(last, _same_series()).where(F.col("_first") <= F.col("_last"))
    return materialize(late.select("_name"), "late")


def extend(spark: SparkSession, paths: Paths, spec: GameSpec = G5, changed: str | None = None, retain: float = RETAIN) -> bool:
    """Bring the calculated and frequency tables up to date with the history.

    Takes every history batch that the tables do not cover yet, whoever wrote it.
    Draws that follow the stored ones of their series change no stored row: their
    features need the last few rows of the series, so only new rows are written. A
    series with an earlier draw is written anew; other series keep their files.
    Counts add up in either case. Nothing shows before the coverage is written, so a
    crash leaves the tables as they were. Of two writers at a time one commits; the other
    takes back its rows and goes on from the new state. Small parts are merged when there
    are many, and parts that no state of the last ``retain`` seconds names are removed.

    Rebuilds everything, and returns False, without a coverage, or when the batch
    ``changed`` was written again after it had been covered.
    """
    with scratch_scope(spark):
        grown = _committed(spark, paths, lambda part: _extend(spark, paths, spec, changed, part))
        merge_parts(spark, paths, retain=retain)
    return grown


def _extend(spark: SparkSession, paths: Paths, spec: GameSpec, changed: str | None, part: str) -> bool:
    state = load_coverage(spark, paths)
    if state is None or (changed and not state[0].where((F.col("kind") == HISTORY) & (F.col("name") == changed)).isEmpty()):
        return _refresh(spark, paths, spec, part)
    covered, version = state
    known = _covered(covered, HISTORY).select("name")
    missing = _history(spark, paths).join(known, F.col("batch") == F.col("name"), "left_anti").select("batch").distinct()
    names = [r["batch"] for r in missing.limit(MOST_FRESH + 1).collect()]
    if not names:
        return True
    if len(names) > MOST_FRESH:
        return _refresh(spark, paths, spec, part)
    fresh = _history(spark, paths).where(F.col("batch").isin(names)).drop("batch")
    base = [*DRAWS.names, "seq"]
    tail = materialize(order.newest_rows(_live(spark, paths, covered).select(*base), order.HIT_ROWS), "tail")
    late = _late_series(tail, fresh)
    following = fresh.join(late, _same_series(), "left_anti")
    numbered = order.with_seq(following).join(order.series_ends(tail), _same_series(), "left")
    numbered = numbered.withColumn("seq", F.col("seq") + F.coalesce(F.col("_end") + 1, F.lit(0)))
    context = tail.select(*base, F.lit(False).alias("_new"))
    rows = context.unionByName(numbered.select(*base, F.lit(True).alias("_new")))
    rows = row_features(order.history_features(rows, spec).where("_new").drop("_new"), spec)
    if not late.isEmpty():
        rest = _history(spark, paths).join(known, F.col("batch") == F.col("name"), "left_semi").drop("batch")
        whole = rest.unionByName(fresh).join(late, _same_series(), "left_semi")
        rows = rows.unionByName(calculate(whole, spec).select(*rows.columns))
    _write_part(rows, freq.frequency(fresh, spec), paths, part)
    moved = covered.join(late, _same_series() & (F.col("kind") == CALCULATED), "left_anti")
    added = spark.createDataFrame([(HISTORY, n, None) for n in names] + [(FREQUENCY, part, None)], COVERAGE)
    added = added.union(_of_kind(fresh.select("series").distinct(), CALCULATED, F.lit(part), F.col("series")))
    _save_coverage(moved.union(added), paths, version + 1)
    return True


def merge_parts(spark: SparkSession, paths: Paths, most: int | None = None, retain: float = RETAIN) -> bool:
    """Merge the parts of the tables into one if there are more than ``most``; true if it did.

    A merge gives up when another writer commits meanwhile; the next one will do. Readers
    of a former state keep their files for ``retain`` seconds.
    """
    most = MOST_PARTS if most is None else most
    state = load_coverage(spark, paths)
    if state is None or _covered(state[0], CALCULATED).select("name").distinct().count() <= most:
        return False
    covered, version = state
    part = uuid.uuid4().hex
    rows = _live(spark, paths, covered).drop("batch")
    # One file a series and task; a series of any size keeps its tasks.
    _write_part(rows, load_frequency(spark, paths), paths, part)
    series = _covered(covered, CALCULATED).select("series").distinct()
    merged = _covered(covered, HISTORY).select("kind", "name", "series")
    merged = merged.union(_of_kind(series, CALCULATED, F.lit(part), F.col("series")))
    merged = merged.union(_of_kind(spark.range(1), FREQUENCY, F.lit(part)))
    try:
        _save_coverage(merged, paths, version + 1)
    except LostRace:
        for table in paths.derived:
            _remove(spark, f"{table}/batch={part}")
        return False
    remove_dead(spark, paths, retain)
    return True


def remove_dead(spark: SparkSession, paths: Paths, retain: float = RETAIN) -> int:
    """Remove parts that no coverage of the last ``retain`` seconds names, and older coverages.

    The newest two coverages always stay, and so does a part that was written in that
    time, as its writer may not have committed yet.
    """
    versions = _versions(spark, paths)
    until = time.time() - retain
    # A state can be read until the one after it is old enough.
    ends = [at for _, at in versions[1:]] + [float("inf")]
    kept = [v for (v, _), end in zip(versions, ends) if end > until]
    kept = sorted({*kept, *(v for v, _ in versions[-2:])})
    names = {r["name"] for v in kept for r in _coverage(spark, paths, v).where(F.col("kind") != HISTORY).select("name").distinct().collect()}
    removed = 0
    for table in paths.derived:
        for folder, at in _folders(spark, table):
            if folder.startswith("batch=") and folder[len("batch=") :] not in names and at <= until:
                _remove(spark, f"{table}/{folder}")
                removed += 1
    for v, _ in versions:
        if v not in kept:
            _remove(spark, f"{paths.coverage}/version={v}")
    return removed


def ingest(
    spark: SparkSession, new: DataFrame, paths: Paths, spec: GameSpec = G5, batch: str | None = None, retain: float = RETAIN
) -> None:
    """Validate, append what passes, keep what does not, bring the tables up to date."""
    batch = batch or uuid.uuid4().hex
    checked = quality.validate_draws(new, spec)
    store.append_draws(paths.history, typed(checked), batch)
    store.write_batch(quality.rejected(checked), paths.rejects, batch)
    extend(spark, paths, spec, changed=batch, retain=retain)
