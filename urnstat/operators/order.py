"""Row positions in a series, and look-back windows over them.

A window ordered over a whole series would put that series in one task. Two
steps avoid it, whatever share of the rows one series holds:

* ``with_seq`` range-partitions by (series, order keys), so Spark cuts a big
  series into many sorted partitions, and turns places inside a partition into
  places in the series with one small table of partition counts;
* ``look_back`` cuts every series into blocks of a fixed number of rows and
  copies the last rows of a block to the next one, so a window per block sees
  everything it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from urnstat.games import G5, GameSpec
from urnstat.operators.features import indicator
from urnstat.session import materialize

BLOCK_ROWS = 1 << 16
ROLLING_ROWS = 10
HIT_ROWS = 5


def with_seq(df: DataFrame, series: str = "series", order: Sequence[str] = ("draw_date", "draw_id")) -> DataFrame:
    """Add ``seq``: 0-based position in the series, oldest first, null dates first.

    Places depend on the partition a row landed in, so they are written once
    and read back; only then are they counted. The counts, at most one row per
    partition and series, are written too: their size decides how they join.
    """
    keys = [series, *order]
    placed = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}),
        "seq",
    )
    runs = placed.groupBy(series, "_part").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col(series).alias("_series"),
        F.col("_part").alias("_run"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    starts = materialize(starts, "starts")
    same_run = (F.col("_part") == F.col("_run")) & F.col(series).eqNullSafe(F.col("_series"))
    return (
        placed.join(starts, same_run)
        .withColumn("seq", F.col("_place") + F.col("_shift"))
        .drop("_part", "_place", "_run", "_series", "_shift")
    )


def _position(direction: str) -> Column:
    """``past`` looks at earlier draws; ``file`` follows a newest-first file."""
    return {"past": F.col("seq"), "file": -F.col("seq")}[direction]


def look_back(
    df: DataFrame,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    reach: int,
    direction: str = "past",
    block_rows: int = BLOCK_ROWS,
    series: str = "series",
) -> DataFrame:
    """Add window columns that look at most ``reach`` rows back.

    ``columns`` maps a name to a function of the ordered window. One shuffle on
    (series, block) serves all of them; a block is at most ``block_rows`` +
    ``reach`` rows.
    """
    if block_rows < reach:
        raise ValueError(f"blocks of {block_rows} rows cannot look back {reach} rows")
    block = F.floor(F.col("_pos") / block_rows)
    home = F.struct(block.alias("block"), F.lit(False).alias("copy"))
    ahead = F.struct((block + 1).alias("block"), F.lit(True).alias("copy"))
    late = F.col("_pos") - block * block_rows >= block_rows - reach
    cells = F.when(late, F.array(home, ahead)).otherwise(F.array(home))
    spread = df.withColumn("_pos", _position(direction)).withColumn("_cell", F.explode(cells))
    window = Window.partitionBy(series, "_cell.block").orderBy("_pos")
    out = spread.withColumns({name: make(window) for name, make in columns.items()})
    return out.where(~F.col("_cell.copy")).drop("_pos", "_cell")


def _common(window: WindowSpec) -> Column:
    return F.coalesce(F.array_size(F.array_intersect("balls", F.lag("balls").over(window))), F.lit(0))


def _hit_rate(rows: int, spec: GameSpec):
    def make(window: WindowSpec) -> Column:
        past = F.flatten(F.collect_list("balls").over(window.rowsBetween(-rows, -1)))
        return F.coalesce(F.array_size(F.array_intersect("balls", past)), F.lit(0)) / F.lit(spec.slots)

    return make


def _rolling(number: int, rows: int):
    def make(window: WindowSpec) -> Column:
        recent = window.rowsBetween(1 - rows, 0)
        return F.when(F.count("*").over(recent) == rows, F.sum(indicator(number)).over(recent).cast("double"))

    return make


def prev_common(df: DataFrame, direction: str = "past", **layout) -> DataFrame:
    """``prev_common_count``: numbers shared with the preceding draw, 0 for the first."""
    return look_back(df, {"prev_common_count": _common}, 1, direction, **layout)


def hit_rate(df: DataFrame, k: int = HIT_ROWS, spec: GameSpec = G5, direction: str = "past", **layout) -> DataFrame:
    """``hit_rate_last_k``: share of this draw's numbers seen in the k draws before."""
    return look_back(df, {f"hit_rate_last_{k}": _hit_rate(k, spec)}, k, direction, **layout)


def history_features(df: DataFrame, spec: GameSpec = G5, direction: str = "past", **layout) -> DataFrame:
    """Both look-back model inputs in one pass."""
    columns = {"prev_common_count": _common, f"hit_rate_last_{HIT_ROWS}": _hit_rate(HIT_ROWS, spec)}
    return look_back(df, columns, HIT_ROWS, direction, **layout)


def lagged(df: DataFrame, columns: Sequence[str], direction: str = "past", **layout) -> DataFrame:
    """``prev_c`` for each column c: its value in the preceding draw, null for the first.

    Inputs that are known before a draw is made, unlike the features of the draw itself.
    """
    before = {f"prev_{c}": (lambda window, c=c: F.lag(c).over(window)) for c in columns}
    return look_back(df, before, 1, direction, **layout)


def trend_table(df: DataFrame, numbers: Sequence[int], rows: int = ROLLING_ROWS, direction: str = "past", **layout) -> DataFrame:
    """One column ``frequency_n`` per number: draws with n among the last ``rows``
    draws, null until there are that many."""
    columns = {f"frequency_{n}": _rolling(n, rows) for n in numbers}
    return look_back(df, columns, rows - 1, direction, **layout)


def rolling_frequency(df: DataFrame, numbers: Sequence[int], rows: int = ROLLING_ROWS, direction: str = "past", **layout) -> DataFrame:
    """The trend table in long form: ``series, seq, number, frequency``."""
    wide = trend_table(df, numbers, rows, direction, **layout)
    cells = F.array(*[F.struct(F.lit(n).alias("number"), F.col(f"frequency_{n}").alias("frequency")) for n in numbers])
    return wide.select("series", "seq", F.inline(cells))


def join_by_seq(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row-by-row join of two tables of the same series."""
    return left.join(right, ["series", "seq"])


def series_ends(df: DataFrame, which: str = "latest") -> DataFrame:
    """First or last ``seq`` per series as ``_name, _end``, written because it
    is small: a join with it then needs neither sort nor shuffle of ``df``."""
    pick = {"latest": F.max, "oldest": F.min}[which]
    return materialize(df.groupBy(F.col("series").alias("_name")).agg(pick("seq").alias("_end")), "ends")


def scoring_row(df: DataFrame, which: str = "latest", columns: Sequence[str] | None = None) -> DataFrame:
    """The newest (``latest``) or first (``oldest``) row of every series.

    Two scans: one of two columns to find the positions, one to fetch the rows.
    Meant for stored tables.
    """
    at_end = F.col("series").eqNullSafe(F.col("_name")) & (F.col("seq") == F.col("_end"))
    rows = df.join(series_ends(df, which), at_end, "left_semi")
    return rows.select("series", *[c for c in (columns or df.columns) if c != "series"])


def newest_rows(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` positions of every series of a stored, complete table."""
    late = F.col("series").eqNullSafe(F.col("_name")) & (F.col("seq") > F.col("_end") - n)
    return df.join(series_ends(df), late, "left_semi")
