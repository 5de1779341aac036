"""Slot probabilities and what follows from them.

Every operator takes ``probs(slot, number, p)``: at most one row per slot and
number of the domain, whoever made it (relative frequencies or forests). Where one
table holds several series, ``keys`` names what tells them apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnstat.functions import balls as B
from urnstat.games import G5, GameSpec
from urnstat.operators.features import explode_slots
from urnstat.operators.frequency import fill_domain
from urnstat.session import materialize

# Fixed value: probability of a number the table does not know.
UNSEEN = 0.01


def empirical_probs(draws: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Relative frequency per slot; a deterministic provider of ``probs``."""
    counts = explode_slots(draws, spec, keys=()).groupBy("slot", "number").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("slot"))
    return counts.select("slot", "number", (F.col("_n") / total).alias("p"))


def in_domain(probs: DataFrame, spec: GameSpec) -> DataFrame:
    """Rows of known slots and numbers; bounds the table by the game itself."""
    high = F.when(F.col("slot") == spec.bonus_slot, spec.bonus_high).otherwise(spec.high)
    return probs.where(F.col("slot").between(1, spec.bonus_slot) & F.col("number").between(1, high))


def prob_grid(probs: DataFrame, spec: GameSpec = G5) -> Column:
    """The whole table as one ``array<array<double>>`` value, ``[slot-1][number-1]``.

    A scalar subquery: evaluated once and shipped with the tasks, so scoring a
    combination is a lookup by position and needs neither join nor shuffle.
    Unknown pairs are null. Put it in a column before using it in a lambda.
    """
    return _grids(probs, spec).scalar()


def _grids(probs: DataFrame, spec: GameSpec, keys: Sequence[str] = ()) -> DataFrame:
    """One ``_grid`` of each series."""
    code = F.col("slot") * 1000 + F.col("number")
    one = in_domain(probs, spec).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(code, "p"))).alias("_m"))

    def row(slot: int) -> Column:
        codes = F.sequence(F.lit(slot * 1000 + 1), F.lit(slot * 1000 + spec.domain_high(slot)))
        return F.transform(codes, lambda c: F.try_element_at("_m", c))

    return one.select(*keys, F.array(*[row(s) for s in range(1, spec.bonus_slot + 1)]).alias("_grid"))


def rank_slots(probs: DataFrame) -> DataFrame:
    """Numbers of every slot from most to least likely, lower number first on ties."""
    ranked = Window.partitionBy("slot").orderBy(F.desc("p"), "number")
    return probs.withColumn("rank", F.row_number().over(ranked))


def predict_slots(probs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most likely number of every slot."""
    best = F.max_by("number", F.struct(F.col("p"), -F.col("number")))
    return probs.groupBy(*keys, "slot").agg(best.alias("number"))


def number_likelihood(probs: DataFrame, spec: GameSpec = G5, places: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Percent per main number: the mean of its slot probabilities, 0 if unseen."""
    mains = in_domain(probs, spec).where(F.col("slot") <= spec.slots)
    summed = mains.groupBy(*keys, "number").agg((F.sum("p") / spec.slots * 100).alias("likelihood"))
    return _percent(summed, spec.high, places, keys)


def bonus_likelihood(probs: DataFrame, spec: GameSpec = G5, places: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Percent per bonus number, 0 if unseen."""
    bonus = in_domain(probs, spec).where(F.col("slot") == spec.bonus_slot)
    return _percent(bonus.select(*keys, "number", (F.col("p") * 100).alias("likelihood")), spec.bonus_high, places, keys)


def _percent(known: DataFrame, high: int, places: int, keys: Sequence[str]) -> DataFrame:
    if keys:
        numbers = F.explode(F.sequence(F.lit(1), F.lit(high))).alias("number")
        full = known.select(*keys).distinct().select(*keys, numbers).join(known, [*keys, "number"], "left").na.fill(0.0, ["likelihood"])
    else:
        full = fill_domain(known, high, "likelihood", 0.0)
    return full.withColumn("likelihood", F.round("likelihood", places))


def rank_likelihood(table: DataFrame) -> DataFrame:
    """From high to low, lower number first on ties; one row per number of the domain."""
    ranked = Window.orderBy(F.desc("likelihood"), "number")
    return table.withColumn("rank", F.row_number().over(ranked)).orderBy("rank")


def lookup_probs(cands: DataFrame, probs: DataFrame, spec: GameSpec = G5, default: float = UNSEEN) -> DataFrame:
    """One row per candidate and slot with the probability of its number."""
    cells = explode_slots(cands, spec, keys=("cand_id",))
    known = F.broadcast(in_domain(probs, spec).select("slot", "number", "p"))
    joined = cells.join(known, ["slot", "number"], "left")
    return joined.select("cand_id", "slot", "number", F.coalesce("p", F.lit(default)).alias("p"))


def pick_probs(grid: Column, balls: Column, bonus: Column, spec: GameSpec, default: float | None = UNSEEN) -> list[Column]:
    """Probability of every ball at its slot, then of the bonus."""
    numbers = [*B.slots(balls, spec), bonus]
    found = [F.get(F.get(grid, F.lit(i)), n - 1) for i, n in enumerate(numbers)]
    return found if default is None else [F.coalesce(p, F.lit(default)) for p in found]


def score_combos(
    cands: DataFrame, probs: DataFrame, spec: GameSpec = G5, places: int = 2, default: float = UNSEEN, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``score``: mean slot probability of mains and bonus, in percent.

    With ``keys`` every candidate meets the table of its own series, one small row each.
    """
    found = pick_probs(F.col("_grid"), F.col("balls"), F.col("bonus"), spec, default)
    score = B.total(found) / F.lit(spec.slots + 1) * 100
    if keys:
        met = cands.join(materialize(_grids(probs, spec, keys), "grids"), [*keys], "left")
    else:
        met = cands.withColumn("_grid", prob_grid(probs, spec))
    return met.withColumn("score", F.round(score, places)).drop("_grid")


def compare_scores(scored: DataFrame, reference: DataFrame) -> DataFrame:
    """Compare every score with the one score of a prediction."""
    out = scored.withColumn("reference_score", reference.select("score").scalar())
    mine, theirs = F.col("score"), F.col("reference_score")
    return out.withColumn("verdict", F.when(mine > theirs, "higher").when(mine < theirs, "lower").otherwise("same"))


def best_worst(scored: DataFrame, columns: tuple[str, ...] = ("cand_id", "score")) -> DataFrame:
    """First of the highest and last of the lowest scores, as two rows."""
    place = F.struct("score", -F.col("cand_id"))
    row = F.struct(*columns)
    ends = scored.agg(F.max_by(row, place).alias("best"), F.min_by(row, place).alias("worst"))
    pairs = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("row")) for k in ("best", "worst")]
    return ends.select(F.inline(F.array(*pairs))).select("kind", "row.*")


def greedy_combo(probs: DataFrame, spec: GameSpec = G5, places: int = 2) -> DataFrame:
    """Slot by slot the most likely unused number, plus the most likely bonus.

    The score takes each probability at the slot its number was picked for. A
    slot without unused numbers in the table makes the combination null.
    """
    entry = F.struct((-F.col("p")).alias("q"), "number")
    ranked = [
        F.sort_array(F.collect_list(F.when(F.col("slot") == s, entry))) for s in range(1, spec.bonus_slot + 1)
    ]
    lists = in_domain(probs, spec).agg(F.array(*ranked[:-1]).alias("_mains"), ranked[-1].alias("_bonus"))
    nothing = F.array().cast("array<struct<q:double,number:int>>")

    def step(picks: Column, numbers: Column) -> Column:
        free = F.filter(numbers, lambda e: ~F.exists(picks, lambda q: q["number"] == e["number"]))
        return F.concat(picks, F.array(F.get(free, F.lit(0))))

    picked = lists.select(F.aggregate("_mains", nothing, step).alias("_picks"), F.get("_bonus", F.lit(0)).alias("_bonus"))
    parts = [-F.get("_picks.q", F.lit(i)) for i in range(spec.slots)] + [-F.col("_bonus.q")]
    score = F.round(B.total(parts) / (spec.slots + 1) * 100, places)
    return picked.select(F.sort_array("_picks.number").alias("balls"), F.col("_bonus.number").alias("bonus"), score.alias("score"))
