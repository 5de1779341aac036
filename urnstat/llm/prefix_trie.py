"""Prefix trie of conversations, with sums over subtrees by depth bands.

A node is a distinct sequence of first turns; the root has none. A node is known by
128 bits: for every turn, two 64-bit hashes of place, role and text are cut into four
32-bit numbers, and a prefix is the four sums of them. Sums can be taken in pieces, so
a conversation of any length is split into blocks; texts are left behind at the scan.

Sums over subtrees go up by *bands* of ``BAND`` depths. Inside a band each node is
exploded to its ancestors in the band, at most ``BAND`` rows. Band roots then form a
trie of their own, one ``BAND``-th as deep, to which the same is applied until one band
is left; its completed totals are pushed down the levels again, from every band root to
the nodes of the band above it. So there are log(depth) rounds and at most ``BAND`` rows
for each node in each of them. The path of a node inside its band is that of its
smallest member. A node with very many members, children or descendants is a sum that
is combined before each shuffle, or one side of a join whose other side Spark splits.

Null roles and texts are empty, a null turn comes first, equal turns follow role and
hash. Rows with a null ``conv_id`` are one conversation, which shares no other's turns,
is no smallest member beside others and has no decimal in a digest. Repeated rows are
turns like others. An empty table has no nodes; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnstat.llm.turns import batched, decimal, plain, streamed
from urnstat.operators.order import with_seq
from urnstat.session import materialize

#: Conversations of a group share the first turns of the one whose id is a multiple of it.
GROUP = 100
#: Up to one less of them.
SHARED = 6
#: Depths of a band.
BAND = 16
#: Turns of a block, over which prefix hashes are summed at once.
BLOCK = 1 << 16
#: Ids that are joined into one text before they meet those of other tasks.
IDS = 4096


# ---- rebuilt conversations -------------------------------------------------


def _numbered(convs: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, chars``: turns by their place, from 1, without texts."""
    slim = plain(convs).select(
        "conv_id",
        "turn",
        "role",
        F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "text", "role").alias("t2"),
        F.char_length("text").cast("bigint").alias("chars"),
    )
    placed = with_seq(slim, "conv_id", ("turn", "role", "t1", "t2"))
    return placed.select("conv_id", (F.col("seq") + 1).cast("bigint").alias("pos"), "t1", "t2", "chars")


def rebuilt(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``c, d, t1, t2, chars, last`` and conversations ``c, total``.

    A conversation c becomes the first h turns of conversation c - c % GROUP and its own
    turns after its first h, where h is the checksum of its decimal modulo ``SHARED``.
    """
    turns = materialize(_numbered(convs), "turns")
    sizes = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "sizes")
    c = F.col("c")
    heads = sizes.select(
        F.col("conv_id").alias("c"),
        "n",
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("b"),
        F.when(F.col("conv_id").isNull(), 0).otherwise(F.crc32(decimal("conv_id")) % SHARED).cast("bigint").alias("h"),
    )
    bases = sizes.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("b"), F.col("n").alias("_base"))
    heads = heads.join(bases, "b", "left").withColumn("m", F.least("h", F.coalesce("_base", F.lit(0))))
    heads = heads.select("c", "b", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    heads = materialize(heads, "heads")
    own = turns.join(heads, F.col("conv_id").eqNullSafe(c)).where("pos > h").withColumn("d", F.expr("pos - h + m"))
    firsts = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED))
    given = firsts.join(heads, F.col("conv_id") == F.col("b")).where("pos <= h").withColumn("d", F.col("pos"))
    rows = own.unionByName(given).select("c", "d", "t1", "t2", "chars", (F.col("d") == F.col("total")).alias("last"))
    return rows, heads.select("c", "total")


# ---- nodes -----------------------------------------------------------------


def _parts() -> dict[str, Column]:
    one, two = F.xxhash64("t1", "t2", "d"), F.xxhash64("t2", "d", "t1")
    low = F.lit((1 << 32) - 1)
    return {
        "_p1": F.shiftrightunsigned(one, 32),
        "_p2": one.bitwiseAND(low),
        "_p3": F.shiftrightunsigned(two, 32),
        "_p4": two.bitwiseAND(low),
    }


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def paths(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``c, d, node, parent, chars, last``: the nodes on the way of every conversation, root included."""
    parts = _parts()
    rows = rows.withColumn("_block", F.floor((F.col("d") - 1) / BLOCK)).withColumns(parts)
    inside = Window.partitionBy("c", "_block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({f"_s{p[2:]}": F.sum(p).over(inside) for p in parts})
    # Sums of the blocks before, for the few conversations that have more than one.
    long = rows.where(F.col("d") > BLOCK).select("c").distinct().withColumnRenamed("c", "_c")
    blocks = rows.join(long, F.col("c").eqNullSafe(F.col("_c")), "left_semi")
    blocks = blocks.groupBy(F.col("c").alias("_c"), F.col("_block").alias("_b")).agg(*[F.sum(p).alias(p) for p in parts])
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_c", "_b", *[F.sum(p).over(before).alias(f"_o{p[2:]}") for p in parts]).where("_b > 0")
    starts = materialize(starts, "blocks")
    sums = sums.join(starts, F.col("c").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    here = [F.col(f"_s{i}") + F.coalesce(f"_o{i}", F.lit(0)) for i in range(1, 5)]
    above = [s - F.col(f"_p{i + 1}") for i, s in enumerate(here)]
    found = sums.select("c", "d", _key(F.col("d"), here).alias("node"), _key(F.col("d") - 1, above).alias("parent"), "chars", "last")
    root = _key(F.lit(0), [F.lit(0)] * 4)
    roots = heads.select(
        "c",
        F.lit(0).cast("bigint").alias("d"),
        root.alias("node"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("bigint").alias("chars"),
        (F.col("total") == 0).alias("last"),
    )
    return found.unionByName(roots)


# ---- sums over subtrees ----------------------------------------------------


def subtree_sums(ways: DataFrame, nodes: DataFrame, values: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """``node`` and its ``values``, each summed over the node's subtree.

    ``ways`` has the nodes ``c, d, node`` on the way of every member c, ``nodes`` has
    ``node, rep, d`` and the values, where ``rep`` is a member.
    """
    level = F.floor(F.col("d") / band)
    listed = ways.groupBy(F.col("c").alias("_c"), level.alias("_band"))
    bands = listed.agg(F.sort_array(F.collect_list(F.struct("d", "node"))).alias("_way"))
    way = F.col("rep").eqNullSafe(F.col("_c")) & (F.col("_level") == F.col("_band"))
    up = nodes.withColumn("_level", level).join(bands, way)
    up = up.select(F.explode(F.slice("_way.node", F.lit(1), (F.col("d") % band + 1).cast("int"))).alias("node"), *values)
    totals = [F.sum(v).alias(v) for v in values]
    inside = up.groupBy("node").agg(*totals)
    if deepest < band:
        return inside
    inside = materialize(inside, "bands")
    tops = nodes.where(F.col("d") % band == 0).select("node", "rep", level.alias("d")).join(inside, "node")
    tops = materialize(tops, "tops")
    higher = ways.where(F.col("d") % band == 0).select("c", level.alias("d"), "node")
    done = subtree_sums(higher, tops, values, deepest // band, band)
    done = tops.where("d > 0").select("node", "rep", (F.col("d") - 1).alias("_level")).join(done, "node")
    pushed = done.join(bands, way).select(F.explode("_way.node").alias("node"), *values)
    return inside.unionByName(pushed).groupBy("node").agg(*totals)


# ---- members that end at a node --------------------------------------------


def _joined(batches):
    """Ids of one node that follow one another, as texts of at most ``IDS`` of them."""

    def rows():
        now, held = None, []
        for node, c in streamed(batches, ["node", "c"]):
            if held and (node != now or len(held) == IDS):
                yield now, held[0], ",".join(map(str, held))
                held = []
            now = node
            held.append(c)
        if held:
            yield now, held[0], ",".join(map(str, held))

    return batched(rows(), pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]), 256)


def _hashed(batches):
    def rows():
        now = state = None
        for node, ids in streamed(batches, ["node", "ids"]):
            if node != now:
                if state:
                    yield now, state.hexdigest()
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if state:
            yield now, state.hexdigest()

    return batched(rows(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))


def end_digests(ways: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the nodes at which conversations end.

    Ids are sorted over all tasks and joined where they are, so a node at which very many
    end is a few long texts when it reaches the one task that can hash them in order.
    """
    ends = ways.where(F.col("last") & F.col("c").isNotNull()).select("node", "c")
    texts = ends.repartitionByRange("node", "c").sortWithinPartitions("node", "c")
    texts = texts.mapInArrow(_joined, "node binary, first bigint, ids string")
    texts = texts.repartition("node").sortWithinPartitions("node", "first")
    return texts.mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(convs: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the rebuilt conversations, with its sums."""
    rows, heads = rebuilt(convs)
    ways = materialize(paths(rows, heads), "ways")
    groups = ways.groupBy("node", "parent", "d")
    nodes = groups.agg(F.min("c").alias("rep"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("d > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(
        nodes.withColumns(
            {"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}
        ),
        "nodes",
    )
    deepest = nodes.agg(F.max("d")).first()[0] or 0
    sums = subtree_sums(ways.select("c", "d", "node"), nodes, ["n_leaves", "saved_tokens"], deepest, band)
    above = nodes.select(F.col("node").alias("parent"), F.col("rep").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, "node").join(end_digests(ways), "node", "left")
    return out.join(above, "parent", "left").select(
        F.col("rep").alias("conv_id"),
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def oracle_sql() -> str:
    """Nodes by chained digests; subtrees by the ways of smallest members."""
    bits = "list_reduce(list_concat([xor(x, b)], range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))"
    codes = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda x, b: {bits}), 4294967295)"
    return f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations),
s AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (SELECT c, n, c - c % {GROUP} AS b, {crc} % {SHARED} AS h FROM s),
g AS (SELECT h.*, least(h.h, coalesce(s.n, 0)) AS m FROM h LEFT JOIN s ON s.c = h.b),
p AS (
  SELECT g.c, t.i AS d, t.r, t.x FROM g JOIN t ON t.c = g.b AND t.i <= g.h
  UNION ALL
  SELECT g.c, t.i - g.h + g.m, t.r, t.x FROM g JOIN t ON t.c = g.c AND t.i > g.h),
k AS (
  SELECT c, d, length(x) AS len, md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM p
  UNION ALL SELECT c, 0, 0, '' FROM s),
w AS (
  SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY c) AS last FROM k),
n AS (
  SELECT k, min(c) AS c, any_value(d) AS d, any_value(pk) AS pk, any_value(len) AS len, count(*) AS n,
    sha256(coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends
  FROM w GROUP BY k),
f AS (SELECT pk, count(*) AS kids FROM n GROUP BY pk),
u AS (SELECT n.*, coalesce(f.kids, 0) AS kids FROM n LEFT JOIN f ON f.pk = n.k),
a AS (
  SELECT w.k, sum(CASE WHEN u.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.len) AS saved
  FROM u JOIN w ON w.c = u.c AND w.d <= u.d GROUP BY w.k)
SELECT u.c AS conv_id, CAST(u.d AS BIGINT) AS depth, q.c AS parent_conv_id, u.n AS n_convs, CAST(u.kids AS BIGINT) AS n_children,
  CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, u.ends AS ends_sha256
FROM u JOIN a ON a.k = u.k LEFT JOIN n q ON q.k = u.pk"""
