"""Joins of combinations with a history: drawn before or not."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnstat.functions import balls as B
from urnstat.functions import chance, ranks
from urnstat.games import G5, GameSpec
from urnstat.session import materialize

#: Random sets that a drawn prediction tries before it takes a place among the free sets.
TRIES = 8
#: Columns that an aggregate can hold in a hash table.
FIXED = {"int", "bigint", "double", "float", "smallint", "tinyint", "boolean", "date", "timestamp"}
BALL_BITS = 6


@dataclass
class Drawn:
    """The sets of a history as bitmaps over their places, in one stored row.

    A game has so many sets and no more: 296 KB for 5 of 50, 2.9 MB for 6 of 52.
    """

    row: DataFrame
    spec: GameSpec

    @classmethod
    def of(cls, history: DataFrame, spec: GameSpec = G5) -> Drawn:
        """One aggregate; a task sends at most one bitmap for each part of the game."""
        place = ranks.set_rank(F.col("balls"), spec) + 1
        placed = history.select(place.alias("_place")).where(F.col("_place").isNotNull())
        maps = placed.groupBy(F.bitmap_bucket_number("_place").alias("id")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bits")
        )
        legal = ranks.legal_sets(spec)
        room = F.greatest(F.least(F.lit(ranks.BUCKET), legal - (F.col("id") - 1) * ranks.BUCKET), F.lit(0))
        free = F.when(room > 0, room - F.coalesce(F.bitmap_count("bits"), F.lit(0))).otherwise(0).cast("bigint")
        parts = history.sparkSession.range(1, ranks.buckets(spec) + 1).join(maps, "id", "left")
        one = parts.agg(F.sort_array(F.collect_list(F.struct("id", "bits", free.alias("free")))).alias("_parts"))
        zero = F.lit(0).cast("bigint")
        before = F.transform("_parts", lambda p, i: F.aggregate(F.slice("_parts.free", F.lit(1), i), zero, lambda n, f: n + f))
        total = F.aggregate("_parts.free", zero, lambda n, f: n + f)
        return cls(materialize(one.select(F.col("_parts.bits").alias("bits"), before.alias("before"), total.alias("free")), "drawn"), spec)

    def has(self, place: Column) -> Column:
        """Whether the set at a place was drawn: a look into the bitmap, without a join."""
        bits = F.get(self.row.select("bits").scalar(), F.floor(place / ranks.BUCKET).cast("int"))
        return F.coalesce(ranks.bit(bits, place % ranks.BUCKET), F.lit(False))


def already_drawn(cands: DataFrame, history: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Add ``drawn``: is this number set in the history, in any order."""
    return cands.withColumn("drawn", Drawn.of(history, spec).has(ranks.set_rank(F.col("balls"), spec)))


def exclude_drawn(cands: DataFrame, history: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Candidates whose number set is not in the history."""
    return cands.where(~Drawn.of(history, spec).has(ranks.set_rank(F.col("balls"), spec)))


def avoid_drawn(preds: DataFrame, history: DataFrame, spec: GameSpec = G5, seed: int = 42, key: str = "pred_id") -> DataFrame:
    """Replace predictions that were drawn before by a set that was not.

    A drawn prediction takes the first undrawn one of ``TRIES`` seeded random sets, or
    else the set at a seeded place among all free ones, so it gets a free set whenever
    there is one. ``replaced`` tells who got one, ``exhausted`` who was drawn although
    the game has no free set; its ``balls`` are null. All of it happens inside the row: a
    try is made only after the one before was drawn, and a free place is found by halving
    the part of the bitmap that holds it.
    """
    drawn = Drawn.of(history, spec)
    rest = preds.columns
    mixed = lambda t: F.sort_array(F.slice(chance.shuffled_domain(spec.high, seed, F.col(key), t), 1, spec.slots))
    placed = lambda t: F.get(F.transform(F.array(mixed(F.lit(t))), lambda b: F.struct(b.alias("balls"), ranks.set_rank(b, spec).alias("place"))), F.lit(0))

    def step(df: DataFrame, **new: Column) -> DataFrame:
        """Going through a generator keeps later uses from repeating what is found here."""
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))

    now = step(preds, _drawn=drawn.has(ranks.set_rank(F.col("balls"), spec)))
    now = step(now, _try1=F.when(F.col("_drawn"), placed(1)))
    for t in range(2, TRIES + 1):
        last = F.col(f"_try{t - 1}")
        now = step(now, **{f"_try{t}": F.when(drawn.has(last["place"]), placed(t)).otherwise(last)}).drop(f"_try{t - 1}")
    last = F.col(f"_try{TRIES}")
    now = step(now, _fresh=F.when(~drawn.has(last["place"]), last["balls"]))
    left = F.col("_drawn") & F.col("_fresh").isNull() & (drawn.row.select("free").scalar() > 0)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), drawn.row.select("free").scalar())
    now = step(now, _nth=F.when(left, place), _before=F.when(left, drawn.row.select("before").scalar()))
    # The last part that begins at or before the place; later parts without a free set begin there too.
    at = F.array_position(F.transform("_before", lambda b: b <= F.col("_nth")), F.lit(False))
    now = step(now, _part=F.when(left, F.when(at > 0, at - 2).otherwise(F.size("_before") - 1)))
    now = step(now, _bits=F.when(left, F.get(drawn.row.select("bits").scalar(), F.col("_part").cast("int"))))
    nth = F.col("_nth") - F.get("_before", F.col("_part").cast("int"))
    now = step(now, _place=F.when(left, ranks.free_place(F.col("_bits"), nth)))
    found = F.col("_place") + F.col("_part") * ranks.BUCKET
    fresh = F.coalesce("_fresh", F.when(left, ranks.set_at(found, spec)))
    now = step(now, _new=F.when(F.col("_drawn"), fresh))
    keep = {"balls": F.when(F.col("_drawn"), F.col("_new")).otherwise(F.col("balls"))}
    keep["replaced"] = F.col("_drawn") & F.col("_new").isNotNull()
    keep["exhausted"] = F.col("_drawn") & F.col("_new").isNull()
    return now.withColumns(keep).select(*dict.fromkeys([*rest, "replaced", "exhausted"]))


def _packed(balls: Column, spec: GameSpec) -> Column:
    """Numbers of a legal set, in their order, as one bigint."""
    cells = [F.call_function("shiftleft", b.cast("bigint"), F.lit(BALL_BITS * i)) for i, b in enumerate(B.slots(balls, spec))]
    return reduce(lambda x, y: x.bitwiseOR(y), cells)


def _unpacked(packed: Column, spec: GameSpec) -> Column:
    cells = [F.shiftright(packed, BALL_BITS * i).bitwiseAND(F.lit((1 << BALL_BITS) - 1)).cast("int") for i in range(spec.slots)]
    return F.array(*cells)


def dedupe_combos(cands: DataFrame, spec: GameSpec = G5, key: str = "cand_id") -> DataFrame:
    """One row per (number set, bonus): the one with the lowest ``cand_id``.

    Legal sets are packed into a bigint, so the minimum is a hash aggregate that
    combines on the map side: heavily repeated combinations shuffle one row per task.
    Other sets, and rows with columns that have no fixed width, are ranked in their
    group, which also leaves one row per task and group before the shuffle.
    """
    columns = cands.columns
    kinds = dict(cands.dtypes)
    rest = [c for c in columns if c not in (key, "balls", "bonus")]
    keyed = cands.withColumn("_key", B.set_key(F.col("balls"), spec))
    legal = F.col("_key").isNotNull()
    if any(kinds[c] not in FIXED for c in rest) or spec.slots * BALL_BITS > 60:
        legal = F.lit(False)
    held = keyed.where(legal).withColumn("_balls", _packed(F.col("balls"), spec)).groupBy("_key", "bonus")
    first = held.agg(F.min(key).alias(key), *[F.min_by(c, key).alias(c) for c in ["_balls", *rest]])
    first = first.withColumn("balls", _unpacked(F.col("_balls"), spec).cast(kinds["balls"])).select(*columns)
    numbers = F.array_join(F.array_sort(F.array_distinct("balls")), " ")
    ranked = Window.partitionBy(F.coalesce(F.col("_key").cast("string"), numbers), "bonus").orderBy(key)
    others = keyed.where(~legal).withColumn("_nth", F.row_number().over(ranked)).where("_nth = 1")
    return first.unionByName(others.select(*columns))


def complete_prediction(preds: DataFrame, spec: GameSpec = G5, seed: int = 42, key: str = "pred_id") -> DataFrame:
    """Make predictions legal: repeats go, free places are filled with unused
    numbers of the domain, numbers are sorted, a bonus out of range is redrawn."""
    chosen = F.array_distinct("balls")
    pool = F.array_except(chance.shuffled_domain(spec.high, seed, F.col(key)), chosen)
    filled = F.slice(F.concat(chosen, pool), 1, spec.slots)
    redrawn = F.get(chance.shuffled_domain(spec.bonus_high, seed, F.col(key), F.lit("bonus")), F.lit(0))
    return preds.withColumns(
        {
            "balls": F.sort_array(F.when(F.size(chosen) >= spec.slots, F.slice(chosen, 1, spec.slots)).otherwise(filled)),
            "bonus": F.when(F.col("bonus").between(1, spec.bonus_high), F.col("bonus")).otherwise(redrawn),
        }
    )
