"""Records of delimited text whose quoted fields span lines, read by byte ranges.

Spark cuts large text files into ranges of whole lines. Whether a range begins inside a
quoted field follows from the number of quotes in the ranges before it, so one pass
counts quotes by range and a running sum over that small table gives every range its
parity. A second pass puts the lines of each range together to records. Records that
cross a border leave their pieces to be joined by the range in which they begin; only
those meet in a shuffle of their own.

A quote is doubled inside a field; a quote in the middle of an unquoted field would turn
the parity over and is not supported. Lines end with ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnstat.session import materialize

QUOTE = '"'
#: Ranges whose parities go along with every task.
MOST_RANGES = 100_000
PIECES = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("nth", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("text", pa.string())])
KINDS = "file bigint, start bigint, nth bigint, begins boolean, ends boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of their range and their place."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


class Range:
    """Puts the lines of one range together, a batch at a time."""

    def __init__(self, file: int, start: int, inside: bool):
        self.at, self.inside, self.begins, self.held, self.nth = (file, start), int(inside), not inside, [], 0

    def add(self, lines: pa.StringArray) -> pa.RecordBatch | None:
        """The records that end in these lines; what follows the last one is held."""
        quotes = pc.count_substring(lines, QUOTE).to_numpy()
        open_ = (self.inside + np.cumsum(quotes)) % 2
        stops = np.flatnonzero(open_ == 0) + 1
        whole = int(stops[-1]) if len(stops) else 0
        out = None
        if whole:
            offsets = pa.array(np.concatenate([[0], stops]), pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(0, whole)), "\n")
            if self.held:
                texts = pa.concat_arrays([pa.array(["\n".join([*self.held, texts[0].as_py()])]), texts[1:]])
            begins = np.full(len(texts), True)
            begins[0] = self.begins
            out = self._batch(texts, begins, True)
            self.held, self.begins = [], True
        self.held += lines.slice(whole).to_pylist()
        self.inside = int(open_[-1])
        return out

    def rest(self) -> pa.RecordBatch | None:
        return self._batch(pa.array(["\n".join(self.held)]), np.array([self.begins]), False) if self.held else None

    def _batch(self, texts, begins, ends: bool) -> pa.RecordBatch:
        n = len(texts)
        file, start = (pa.array(np.full(n, v), pa.int64()) for v in self.at)
        nth = pa.array(np.arange(self.nth, self.nth + n))
        self.nth += n
        return pa.RecordBatch.from_arrays([file, start, nth, pa.array(begins), pa.array(np.full(n, ends)), texts.cast(pa.string())], schema=PIECES)


def _cut(parities: dict[tuple[int, int], int] | None = None):
    """Records of the ranges of a task, and parts of records.

    Without ``parities`` a range begins with a row that holds its parity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            places = [batch.column(c).to_numpy() for c in ("file", "start")]
            new = np.logical_or(*[v[1:] != v[:-1] for v in places])
            marks = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for at, stop in zip(marks, marks[1:]):
                where = (int(places[0][at]), int(places[1][at]))
                if now is None or now.at != where:
                    if now and (last := now.rest()):
                        yield last
                    now = Range(*where, (batch.column("inside")[at].as_py() if parities is None else parities[where]) == 1)
                    at += parities is None
                if at < stop and (found := now.add(batch.column("value").slice(at, stop - at))):
                    yield found
        if now and (last := now.rest()):
            yield last

    return run


def _records(lines: DataFrame) -> DataFrame:
    """Pieces of records of all ranges.

    Lines come from the scan in order, so their ranges only need their parities: one
    number a range, which go along with the tasks up to ``MOST_RANGES``. For more ranges
    they meet their lines in a shuffle.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    ranges = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int")
    ranges = materialize(ranges.select("file", "start", inside.alias("inside")), "ranges")
    known = ranges.limit(MOST_RANGES + 1).collect()
    if len(known) <= MOST_RANGES:
        parities = {(r["file"], r["start"]): r["inside"] for r in known}
        return lines.select("file", "start", "value").mapInArrow(_cut(parities), KINDS)
    heads = ranges.select("file", "start", F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("value"), "inside")
    rows = heads.unionByName(lines.withColumn("inside", F.lit(None).cast("int")))
    return rows.repartition("file", "start").sortWithinPartitions("file", "start", "place").mapInArrow(_cut(), KINDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, first``: the texts of all records, and whether it is the first of its file."""
    cut = _records(_lines(spark, path))
    first = (F.col("start") == 0) & (F.col("nth") == 0)
    whole = cut.where("begins and ends").select("text", first.alias("first"))
    # A record that crosses borders: its parts are numbered by the last part that begins one.
    parts = cut.where("not (begins and ends)")
    before = Window.partitionBy("file").orderBy("start", "nth")
    opened = F.last(F.when(F.col("begins"), F.struct("start", "nth")), ignorenulls=True).over(before)
    joined = parts.withColumn("opened", opened).groupBy("file", "opened").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "nth", "text"))), lambda p: p["text"]), "\n").alias("text"),
        F.bool_or(first).alias("first"),
    )
    found = whole.unionByName(joined.select("text", "first"))
    return found.select(F.regexp_replace("text", "\r\\z", "").alias("record"), "first")
