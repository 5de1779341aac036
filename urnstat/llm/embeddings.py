"""Embedding near-duplicates by PCA-ordered, tiled comparison within labels.

1. Usable vectors are scaled to length one; equal vectors of a label become one with
   a number of copies. Their moments about the mean, summed by Spark, give the principal
   axes; each vector is turned so that its leading numbers tell it from others best.
   Of very wide vectors block power iteration finds the leading axes.
2. Each label is cut along the first axis into bands as wide as the greatest distance of
   a link, so links stay inside a band or join neighbours. Bands are ordered by the next
   axes and cut into blocks, so no task ever holds a label or band. Blocks of a band
   and its neighbour meet if their boxes along the leading axes leave a chance; a block
   is sent once for up to ``PARTNERS`` others and those come to it one after another.
3. Blocks are compared tile by tile, ``TILE`` rows each, again by boxes first. In a pair
   of tiles the products of the leading numbers are accumulated step by step. After each
   step the rest of a product is at most the product of the two suffix norms; pairs
   that cannot reach the threshold stop there. Survivors are decided by the cosine of
   the given vectors in double precision.
4. A pair of blocks returns a number of links per vector and a spanning forest of its
   links, never all pairs, so a large group of near copies stays linear.

Vectors that are null, empty, zero, or hold null or non-finite numbers, and rows
without a label, link with nothing: they have 0 links and are their own component.
Vectors of other lengths link only among their own length. Copies of one vector link
with each other. Repeated ids are separate rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnstat.llm.components import components
from urnstat.session import materialize

THRESHOLD = 0.98
#: Rows of a tile; numbers of a block, which has a tile's rows at least.
TILE = 256
BLOCK_NUMBERS = 1 << 19
#: Blocks that are compared with one copy of a block.
PARTNERS = 16
#: Axes whose range decides whether blocks and tiles meet, and numbers per accumulation step.
BOX_AXES = 8
STEP = 8
#: Room for rounding in bounds; the final decision has none.
SLACK = 1e-9
#: Up to this width all axes come from the summed moments; of wider vectors this many
#: leading axes come from rounds of block power iteration, and what they leave follows.
WHOLE_WIDTH = 1024
LEADING = 64
POWER_ROUNDS = 4


def usable(vector: Column, label: Column) -> Column:
    """Not null, not zero, only finite numbers, and a label."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of huge numbers overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Frame(NamedTuple):
    """Where the unit vectors lie: their mean, and directions as columns, the most telling first."""

    mean: np.ndarray
    axes: np.ndarray

    def turn(self, unit: np.ndarray) -> np.ndarray:
        """Numbers along the axes, followed by what the axes do not hold; distances stay."""
        x = unit - self.mean
        along = x @ self.axes
        if self.axes.shape[1] == len(self.axes):
            return along
        return np.concatenate([along, x - along @ self.axes.T], axis=1)


def _summed(vectors: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over blocks of unit vectors; its rows meet in Spark and come as arrays."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(_unit(_matrix(batch.column("vector"), width)))
                total = more if total is None else total + more
        if total is not None:
            rows = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), rows], ["row", "sums"])

    parts = vectors.select("vector").mapInArrow(run, "row bigint, sums array<double>")
    cells = parts.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    rows = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "x")))["x"].alias("sums"))
    return np.array([r["sums"] for r in rows.orderBy("row").collect()])


def frame(vectors: DataFrame, width: int, whole: int = WHOLE_WIDTH) -> Frame:
    """Mean and principal axes of the unit vectors of ``vectors``, which all have ``width`` numbers."""
    with_one = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    if width <= whole:
        sums = _summed(vectors, width, lambda x: with_one(x).T @ with_one(x))
        mean = sums[:-1, -1] / sums[-1, -1]
        return Frame(mean, np.linalg.eigh(sums[:-1, :-1] / sums[-1, -1] - np.outer(mean, mean))[1][:, ::-1])
    sums = _summed(vectors, width, lambda x: with_one(x).sum(axis=0)[:, None])[:, 0]
    mean = sums[:-1] / sums[-1]
    axes = np.linalg.qr(np.random.default_rng(7).normal(size=(width, min(LEADING, width))))[0]
    for _ in range(POWER_ROUNDS):
        axes = np.linalg.qr(_summed(vectors, width, lambda x, q=axes: (x - mean).T @ ((x - mean) @ q)))[0]
    # Where less than all directions differ, the rest of the basis is arbitrary but still right.
    return Frame(mean, axes)


def lead(vectors: DataFrame, at: Frame) -> DataFrame:
    """``vectors`` with ``lead``: the first numbers of each turned unit vector."""
    width = len(at.mean)

    def run(batches):
        for batch in batches:
            turned = at.turn(_unit(_matrix(batch.column("vector"), width)))[:, :BOX_AXES] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(turned), pa.list_(pa.float64()))], [*batch.schema.names, "lead"]
            )

    schema = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{schema}, lead array<double>")


def reach(threshold: float) -> float:
    """The greatest distance of linked unit vectors, and room for rounding."""
    return max(2 - 2 * threshold, 0.0) ** 0.5 + 1e-4


def blocks(led: DataFrame, rows: int, threshold: float = THRESHOLD) -> DataFrame:
    """``led`` with ``band`` along the first axis and ``block``: at most ``rows`` neighbours in a band.

    Places come from a range-partitioned order and a table of partition sizes, so a
    label or band that holds most rows is numbered by many tasks.
    """
    parts = int(led.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = lambda k: F.floor(F.coalesce(F.get("lead", F.lit(k)), F.lit(0.0)) / reach(threshold))
    order = ["label", "band", "second", "third", "rep"]
    ordered = led.withColumns({"band": cut(0), "second": cut(1), "third": cut(2)})
    ordered = ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("second", "third")
    # The numbers below rest on the partitioning, so it is stored before use.
    ordered = materialize(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    sizes = ordered.groupBy("label", "band", "part").agg(F.count("*").alias("size"), F.min("at").alias("origin"))
    before = Window.partitionBy("label", "band").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size"), "starts")
    block = F.floor((F.col("start") + F.col("at") - F.col("origin")) / rows)
    return ordered.join(starts, ["label", "band", "part"]).withColumn("block", block).drop("part", "at", "origin", "start")


def compare(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b``, unit vectors less a common mean, whose cosine may reach the threshold.

    Products are accumulated from the leading dimensions on. Unit vectors with the cosine
    c are sqrt(2 - 2 c) apart wherever the origin lies, which says how large a product must be.
    """
    width = a.shape[1]
    suffix = [np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]) for x in (a, b)]
    suffix = [np.concatenate([s, np.zeros((len(s), 1))], axis=1) for s in suffix]
    half = [s[:, 0] ** 2 / 2 for s in suffix]
    at = min(step, width)
    sums = a[:, :at] @ b[:, :at].T
    needed = half[0][:, None] + half[1][None, :] - (1 - threshold) - SLACK
    i, j = np.nonzero(sums + suffix[0][:, at][:, None] * suffix[1][:, at][None, :] >= needed)
    left, needed = sums[i, j], needed[i, j]
    while at < width and len(i):
        to = min(at + step, width)
        left = left + np.einsum("ij,ij->i", a[i, at:to], b[j, at:to])
        at = to
        stay = left + suffix[0][i, at] * suffix[1][j, at] >= needed
        i, j, left, needed = i[stay], j[stay], left[stay], needed[stay]
    return i, j


def reaching(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of rows ``i`` of ``a`` and ``j`` of ``b`` reach the threshold."""
    size = max(1, BLOCK_NUMBERS // a.shape[1])
    parts = [np.einsum("ij,ij->i", a[i[k : k + size]], b[j[k : k + size]]) for k in range(0, len(i), size)]
    return np.concatenate(parts) >= threshold if parts else np.zeros(0, bool)


def forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of links that connect what all links connect, without a ring."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    kept = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return np.array(kept, np.int64)


class Block(NamedTuple):
    """Rows of a block in a task: ids, copies, unit vectors as given and turned, and boxes of the tiles."""

    ids: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    turned: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _block(pieces: list[pa.RecordBatch], at: Frame, tile: int) -> Block:
    ids, copies = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in pieces]) for c in ("rep", "copies"))
    unit = _unit(np.concatenate([_matrix(p.column("vector"), len(at.mean)) for p in pieces]))
    turned = at.turn(unit)
    # Rows of a block come in any order; along the first two axes tiles get narrow.
    order = np.lexsort((turned[:, 0], np.floor(turned[:, min(1, turned.shape[1] - 1)] * 8)))
    ids, copies, unit, turned = (x[order] for x in (ids, copies, unit, turned))
    starts = np.arange(0, len(ids), tile)
    low, high = (f.reduceat(turned[:, :BOX_AXES], starts, axis=0) for f in (np.minimum, np.maximum))
    return Block(ids, copies, unit, turned, low, high)


def _block_pair(a: Block, b: Block, tile: int, threshold: float) -> pa.RecordBatch | None:
    """Links per vector of both blocks, and links of a spanning forest; ``b`` may be ``a``."""
    gap = np.maximum(0, np.maximum(a.low[:, None] - b.high[None], b.low[None] - a.high[:, None]))
    near = (gap * gap).sum(axis=2) <= 2 - 2 * threshold + SLACK
    counts = [np.zeros(len(a.ids)), np.zeros(len(b.ids))]
    lefts, rights = [], []
    for s, t in zip(*np.nonzero(np.triu(near) if a is b else near)):
        i, j = compare(a.turned[s * tile : (s + 1) * tile], b.turned[t * tile : (t + 1) * tile], threshold)
        i, j = i + s * tile, j + t * tile
        if a is b and s == t:
            i, j = i[i < j], j[i < j]
        linked = reaching(a.unit, b.unit, i, j, threshold)
        i, j = i[linked], j[linked]
        if len(i):
            counts[0] += np.bincount(i, b.copies[j], len(a.ids))
            counts[1] += np.bincount(j, a.copies[i], len(b.ids))
            edges = forest(a.ids[i], b.ids[j])
            lefts.append(a.ids[i[edges]])
            rights.append(b.ids[j[edges]])
    if not lefts:
        return None
    left, right = np.concatenate(lefts), np.concatenate(rights)
    edges = forest(left, right)
    reps = np.concatenate([left[edges], *(x.ids[c > 0] for x, c in zip((a, b), counts))])
    others = [*right[edges].tolist(), *[None] * (len(reps) - len(edges))]
    numbers = np.concatenate([np.zeros(len(edges)), *(c[c > 0] for c in counts)]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(others, pa.int64()), pa.array(numbers)], ["rep", "other", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, list[pa.RecordBatch]]]:
    """Neighbouring rows of one ``task`` and ``turn``, with ``own`` of the first."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "turn")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(keys[start].tolist())
            if held and key != now:
                yield *now, held[0].column("own")[0].as_py(), held
                held = []
            now = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield *now, held[0].column("own")[0].as_py(), held


def block_pairs(cut: DataFrame, width: int, threshold: float = THRESHOLD, partners: int = PARTNERS) -> DataFrame:
    """``label, band, block, to_band, to_block`` of the blocks that may hold links, and the ``task`` of a pair."""
    axes = range(min(BOX_AXES, width))
    box = [f(F.col("lead")[k]).alias(f"{n}{k}") for k in axes for n, f in (("low", F.min), ("high", F.max))]
    boxes = materialize(cut.groupBy("label", "band", "block").agg(*box), "blocks")
    one, two = boxes.alias("one"), boxes.withColumn("near", F.explode(F.array("band", F.col("band") - 1))).alias("two")
    # How far two boxes are apart.
    gap = lambda k: F.greatest(
        F.lit(0.0), F.col(f"one.low{k}") - F.col(f"two.high{k}"), F.col(f"two.low{k}") - F.col(f"one.high{k}")
    )
    apart = sum((gap(k) * gap(k) for k in axes[1:]), gap(0) * gap(0))
    once = (F.col("two.band") > F.col("one.band")) | (F.col("two.block") >= F.col("one.block"))
    same = (F.col("one.label") == F.col("two.label")) & (F.col("one.band") == F.col("two.near"))
    pairs = one.join(two, same & once & (apart <= 2 - 2 * threshold + SLACK)).select(
        "one.label", "one.band", "one.block", F.col("two.band").alias("to_band"), F.col("two.block").alias("to_block")
    )
    pairs = pairs.withColumn("share", F.floor(F.col("to_block") / partners))
    keys = ["label", "band", "block", "to_band", "share"]
    tasks = materialize(pairs.select(*keys).distinct().withColumn("task", F.monotonically_increasing_id()), "block-tasks")
    return materialize(pairs.join(tasks, keys).drop("share"), "block-pairs")


def block_links(cut: DataFrame, at: Frame, threshold: float = THRESHOLD, tile: int = TILE, partners: int = PARTNERS) -> DataFrame:
    """``rep, other, n``: links per vector and pair of blocks (``n``), and links of a spanning forest (``other``)."""
    cut = materialize(cut, "cut")
    pairs = block_pairs(cut, len(at.mean), threshold, partners)
    itself = (F.col("to_band") == F.col("band")) & (F.col("to_block") == F.col("block"))
    homes = pairs.groupBy("task", "label", "band", "block").agg(F.max(itself).alias("own"))
    guests = pairs.where(~itself).select("task", "label", F.col("to_band").alias("band"), F.col("to_block").alias("block"))
    keys, sent = ["label", "band", "block"], ["rep", "copies", "vector"]
    rows = cut.join(homes, keys).select("task", F.lit(-1).cast("bigint").alias("turn"), "own", *sent)
    rows = rows.union(cut.join(guests, keys).select("task", F.col("block").alias("turn"), F.lit(False), *sent))
    rows = rows.repartition("task").sortWithinPartitions("task", "turn")

    def run(batches):
        home = None
        for _, turn, own, pieces in _runs(batches):
            block = _block(pieces, at, tile)
            if turn < 0:
                home = block
                found = _block_pair(home, home, tile, threshold) if own else None
            else:
                found = _block_pair(home, block, tile, threshold)
            if found is not None:
                yield found

    kind = dict(cut.dtypes)["rep"]
    return rows.mapInArrow(run, f"rep {kind}, other bigint, n bigint")


def near_duplicates(
    rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, block: int | None = None, partners: int = PARTNERS, whole: int = WHOLE_WIDTH
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every ``vec_id, embedding, label`` row.

    ``block`` sets the rows of a block, which else follow from ``BLOCK_NUMBERS``.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = rows.select("vec_id", "label", vector.alias("vector"))
    fine = usable(F.col("vector"), F.col("label"))
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    # A negative zero equals zero, so copies are told by the numbers, not their bits.
    plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    good = rows.where(fine).select("vec_id", "label", plain.alias("vector"))
    reps = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # A number per different vector: ids may be null or repeated.
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    found = None
    for width in [r[0] for r in reps.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]:
        own = reps.where(F.size("vector") == width)
        at = frame(own, width, whole)
        cut = blocks(lead(own, at), block or max(tile, BLOCK_NUMBERS // width), threshold)
        part = block_links(cut, at, threshold, tile, partners)
        found = part if found is None else found.union(part)
    if found is None:
        return alone.withColumn("kept", F.lit(True))
    found = materialize(found, "vector-links")
    numbers = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    classes = components(found.where("other IS NOT NULL"), "rep", "other")
    named = reps.join(numbers, "rep", "left").join(classes, reps["rep"] == classes["node"], "left").select(
        "label", "vector", "first", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("class")
    )
    named = materialize(named, "vector-classes")
    ids = named.groupBy("class").agg(F.min("first").alias("component_id"))
    named = named.join(ids, "class").select("label", "vector", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    # Without any id a component has none, and each of its rows keeps itself.
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB, from all pairs within a label."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(r, x) AS (SELECT r, r FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.x = links.a),
classes AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.x GROUP BY reach.r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN classes USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY a) USING (r)"""
