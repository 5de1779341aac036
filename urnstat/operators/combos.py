"""Generated combinations: weighted draws, random samples, exact extremes, profiles."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnstat.functions import balls as B
from urnstat.functions import chance, text
from urnstat.games import G5, GameSpec
from urnstat.operators import likelihood as L
from urnstat.operators.features import row_features
from urnstat.operators.frequency import history_profile
from urnstat.operators.matching import already_drawn, dedupe_combos
from urnstat.session import materialize

SAMPLE = 1000
#: Rounds of tries, each as long as all before it, before the rest is drawn without replacement.
ROUNDS = 5
SCORE_UNIT = 10**12


def _race(slot: Column, high: int, seed: int) -> Column:
    """All numbers of a slot with their arrival time ``-ln(u) / p``.

    The first arrival is distributed by p, and the first one that is unused is
    distributed by p conditioned on being unused.
    """
    row = F.get("_grid", slot - 1)
    runners = F.transform(
        F.sequence(F.lit(1), F.lit(high)),
        lambda n: F.struct(
            (-F.ln(chance.uniform(seed, F.col("cand_id"), slot, n)) / F.get(row, n - 1)).alias("t"),
            n.alias("number"),
            F.get(row, n - 1).alias("p"),
        ),
    )
    return F.filter(runners, lambda r: r["p"] > 0)


def _weighted(cands: DataFrame, probs: DataFrame, spec: GameSpec, seed: int) -> DataFrame:
    """One combination per candidate, slot after slot inside the row: each
    slot's pick joins an accumulator that the next slot's race must avoid."""
    nothing = F.array().cast("array<struct<t:double,number:int,p:double>>")

    def step(picks: Column, slot: Column) -> Column:
        free = F.filter(_race(slot, spec.high, seed), lambda r: ~F.exists(picks, lambda q: q["number"] == r["number"]))
        return F.concat(picks, F.array(F.array_min(free)))

    picks = F.aggregate(F.sequence(F.lit(1), F.lit(spec.slots)), nothing, step)
    bonus = F.array_min(_race(F.lit(spec.bonus_slot), spec.bonus_high, seed))
    # Going through a generator keeps later uses of the picks from repeating the race.
    drawn = cands.withColumn("_grid", L.prob_grid(probs, spec)).select(
        "cand_id", F.inline(F.array(F.struct(picks.alias("_picks"), bonus.alias("_bonus"))))
    )
    parts = [F.get("_picks.p", F.lit(i)) for i in range(spec.slots)]
    return drawn.select(
        "cand_id",
        F.sort_array("_picks.number").alias("balls"),
        F.col("_bonus.number").alias("bonus"),
        (B.total(parts) + F.col("_bonus.p")).alias("_total"),
    )


def _first_distinct(make, spec: GameSpec, n: int, possible: int | None, tries: int | None = None, tail=None) -> DataFrame:
    """First ``n`` distinct combinations of ``make(start, stop)``, in candidate order.

    Without a given number of tries it goes on until ``n``, or all ``possible`` ones,
    are there; tries double from round to round, and each is made and stored once. With
    a ``tail`` the tries end after ``ROUNDS`` and ``tail(found, stop)`` adds the rest.
    """
    if tries is not None:
        return dedupe_combos(make(0, tries), spec).orderBy("cand_id").limit(n)
    wanted = n if possible is None else min(n, possible)
    start, stop, distinct = 0, 2 * n, None
    for done in itertools.count(1):
        found = make(start, stop)
        found = found if distinct is None else distinct.unionByName(found)
        distinct = materialize(dedupe_combos(found, spec), "combos")
        if distinct.limit(wanted).count() >= wanted:
            break
        if tail and done == ROUNDS:
            distinct = tail(distinct, stop)
            break
        start, stop = stop, 2 * stop
    return distinct.orderBy("cand_id").limit(n)


# ---- drawing without replacement -------------------------------------------


def _beam(probs: DataFrame, spec: GameSpec, seed: int, width: int) -> tuple[DataFrame, bool]:
    """The first ``width`` picks of a draw without replacement from all ordered picks, and whether these are all.

    Every beginning of a pick carries the time at which the first pick below it comes up, on
    a scale where greater is earlier. The times of its continuations are drawn so that the
    earliest is its own, so only the ``width`` earliest beginnings of a slot need to go on.
    """
    now = probs.sparkSession.range(1).select(
        F.array().cast("array<int>").alias("picks"), F.lit(0.0).alias("phi"), F.lit(0.0).alias("time"), F.lit(0.0).alias("_total")
    )
    whole = True
    for slot in range(1, spec.bonus_slot + 1):
        row = F.get("_grid", F.lit(slot - 1))
        free = F.lit(True) if slot == spec.bonus_slot else ~F.array_contains("picks", F.col("_n"))
        grown = now.withColumn("_grid", L.prob_grid(probs, spec)).select(
            "picks", "phi", "time", "_total", F.posexplode(row).alias("_at", "p")
        ).withColumn("_n", F.col("_at") + 1).where(F.col("p") > 0).where(free)
        u = chance.uniform(seed, F.lit("tail"), F.array_join(F.col("picks").cast("array<string>"), ","), F.lit(slot), F.col("_n"))
        # Siblings are a domain at most; they meet by their beginning.
        mine = Window.partitionBy("picks")
        grown = grown.withColumn("phi", F.col("phi") + F.ln(F.col("p") / F.sum("p").over(mine)))
        grown = grown.withColumn("_g", F.col("phi") - F.ln(-F.ln(u)))
        gap = F.col("_g") - F.max("_g").over(mine)
        v = F.col("time") - F.col("_g") + F.when(gap < 0, F.ln(-F.expm1(gap)))  # null for the earliest one
        late = F.col("time") - F.greatest(v, F.lit(0.0)) - F.log1p(F.exp(-F.abs(v)))
        grown = grown.select(
            F.array_append("picks", F.col("_n").cast("int")).alias("picks"),
            "phi",
            F.coalesce(late, F.col("time")).alias("time"),
            (F.col("_total") + F.col("p")).alias("_total"),
        )
        now = materialize(grown.orderBy(F.desc("time"), "picks").limit(width), "beam")
        whole = whole and now.count() < width
    return now, whole


def _rest(probs: DataFrame, spec: GameSpec, seed: int, n: int):
    """What draws on without replacement once plain tries find little that is new."""

    def tail(found: DataFrame, stop: int) -> DataFrame:
        width = 4 * n
        while True:
            picks, whole = _beam(probs, spec, seed, width)
            order = Window.orderBy(F.desc("time"), "picks")  # at most ``width`` rows
            new = picks.select(
                (F.lit(stop) + F.row_number().over(order) - 1).cast("bigint").alias("cand_id"),
                F.sort_array(F.slice("picks", 1, spec.slots)).alias("balls"),
                F.get("picks", F.lit(spec.slots)).alias("bonus"),
                "_total",
            )
            distinct = materialize(dedupe_combos(found.unionByName(new), spec), "combos")
            if whole or distinct.count() >= n:
                return distinct
            width *= 4

    return tail


def weighted_combos(
    probs: DataFrame, spec: GameSpec = G5, n: int = 10, seed: int = 42, places: int = 2, tries: int | None = None
) -> DataFrame:
    """``n`` distinct combinations, every slot drawn by its probabilities.

    Fewer than ``n`` come out only if no more have a positive probability: where tries
    keep giving what is there already, the rest is drawn without replacement.
    """
    score = F.round(F.col("_total") / (spec.slots + 1) * 100, places)

    def make(start: int, stop: int) -> DataFrame:
        cands = probs.sparkSession.range(start, stop).select(F.col("id").alias("cand_id"))
        return _weighted(cands, probs, spec, seed).where(F.col("_total").isNotNull())

    combos = _first_distinct(make, spec, n, None, tries, _rest(probs, spec, seed, n))
    return combos.select("cand_id", "balls", "bonus", score.alias("score")).orderBy(F.desc("score"), "cand_id")


def sampled_combos(spark, spec: GameSpec = G5, n: int = SAMPLE, seed: int = 42, tries: int | None = None) -> DataFrame:
    """``n`` distinct uniform combinations of the whole domain."""
    mains = F.slice(chance.shuffled_domain(spec.high, seed, F.col("cand_id")), 1, spec.slots)
    bonus = F.get(chance.shuffled_domain(spec.bonus_high, seed, F.col("cand_id"), F.lit("bonus")), F.lit(0))

    def make(start: int, stop: int) -> DataFrame:
        cands = spark.range(start, stop).select(F.col("id").alias("cand_id"))
        return cands.select("cand_id", F.sort_array(mains).alias("balls"), bonus.alias("bonus"))

    return _first_distinct(make, spec, n, math.comb(spec.high, spec.slots) * spec.bonus_high, tries)


def sampled_extremes(probs: DataFrame, spec: GameSpec = G5, n: int = SAMPLE, seed: int = 42, places: int = 4) -> DataFrame:
    """Best and worst of ``n`` uniform combinations, scored by sorted slot."""
    scored = L.score_combos(sampled_combos(probs.sparkSession, spec, n, seed), probs, spec, places)
    return L.best_worst(scored, ("cand_id", "balls", "bonus", "score"))


def exact_extremes(probs: DataFrame, spec: GameSpec = G5, places: int = 4) -> DataFrame:
    """Best and worst of all combinations, scored by sorted slot.

    Sorted slots make it a path over increasing numbers: the best path that
    ends in number n at slot i extends the best path of slot i - 1 ending below
    n. That is one running maximum per slot over the domain, where listing all
    combinations would take millions of rows. Probabilities become whole units
    so that equal scores are equal; ties go to the smallest numbers.
    """
    spark = probs.sparkSession
    known = L.in_domain(probs, spec)
    units = F.round(F.col("p") * SCORE_UNIT).cast("long")
    unseen = round(L.UNSEEN * SCORE_UNIT)
    table = known.groupBy("number").agg(
        *[F.max(F.when(F.col("slot") == s, units)).alias(f"_u{s}") for s in range(1, spec.bonus_slot + 1)]
    )
    domain = spark.range(1, spec.high + 1).select(F.col("id").cast("int").alias("number"))
    cells = domain.join(F.broadcast(table), "number", "left").select(
        "number",
        *[F.coalesce(f"_u{s}", F.lit(unseen)).alias(f"_u{s}") for s in range(1, spec.slots + 1)],
    )
    highs = domain.where(F.col("number") <= spec.bonus_high).join(F.broadcast(table), "number", "left")
    bonus_units = F.coalesce(f"_u{spec.bonus_slot}", F.lit(unseen))
    below = Window.partitionBy("kind").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)

    ends = []
    for kind, sign in (("best", 1), ("worst", -1)):
        # Smallest struct wins: signed score first, then the numbers themselves.
        paths = cells.withColumn("kind", F.lit(kind)).withColumn(
            "_path", F.struct((F.col("_u1") * -sign).alias("u"), F.array("number").alias("balls"))
        )
        for s in range(2, spec.slots + 1):
            paths = paths.withColumn("_prev", F.min("_path").over(below)).withColumn(
                "_path",
                F.when(
                    F.col("_prev").isNotNull(),
                    F.struct(
                        (F.col("_prev.u") + F.col(f"_u{s}") * -sign).alias("u"),
                        F.concat("_prev.balls", F.array("number")).alias("balls"),
                    ),
                ),
            )
        main = paths.groupBy("kind").agg(F.min("_path").alias("main"))
        bonus = highs.agg(F.min(F.struct((bonus_units * -sign).alias("u"), "number"))).scalar()
        ends.append(main.withColumn("bonus", bonus).withColumn("_units", (F.col("main.u") + F.col("bonus.u")) * -sign))
    score = F.round(F.col("_units") / SCORE_UNIT / (spec.slots + 1) * 100, places)
    return ends[0].unionByName(ends[1]).select(
        "kind", F.col("main.balls").alias("balls"), F.col("bonus.number").alias("bonus"), score.alias("score")
    )


# The statistics of a profile, in the order they are shown.
PROFILE = [
    "Mean",
    "Median",
    "Range",
    "Sum Without Bonus",
    "Sum With Bonus",
    "Even Count",
    "Odd Count",
    "Low Range Count",
    "High Range Count",
    "Has Consecutive Numbers",
    "Already Drawn Before",
]


def combo_profile(cands: DataFrame, history: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Eleven statistics per candidate in long form ``cand_id, stat, value``."""
    df = row_features(already_drawn(cands, history, spec), spec)
    values = [
        F.round("mean", 2).cast("string"),
        F.col("median").cast("string"),
        *[
            F.col(c).cast("string")
            for c in (
                "range",
                "sum_without_bonus",
                "sum_with_bonus",
                "even_count",
                "odd_count",
                "low_range_count",
                "high_range_count",
            )
        ],
        text.yes_no(F.col("has_consecutive")),
        text.yes_no(F.col("drawn")),
    ]
    rows = [F.struct(F.lit(name).alias("stat"), value.alias("value")) for name, value in zip(PROFILE, values)]
    return df.select("cand_id", F.inline(F.array(*rows)))


def hypothetical_features(cands: DataFrame, calculated: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Model inputs of combinations that were never drawn.

    Shape statistics are those of the whole history, counts are the candidate's
    own, and it shares nothing with a previous draw. The history summary is one
    scalar row, so candidates are not shuffled.
    """
    profile = history_profile(calculated)
    summary = profile.select(F.struct(*profile.columns)).scalar()
    own = row_features(cands, spec).withColumn("_h", summary)
    return own.select(
        *cands.columns,
        *[F.col(f"_h.{c}").alias(c) for c in profile.columns],
        "sum_without_bonus",
        "even_count",
        "odd_count",
        "low_range_count",
        "high_range_count",
        F.lit(0).alias("prev_common_count"),
        F.col("has_consecutive").cast("int").alias("has_consecutive"),
    )
