"""Column expressions over one draw.

The number of slots is fixed per game, so expressions are unrolled over the
slots instead of using lambdas: all of them stay inside generated code.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from urnstat.games import KEY_BITS, GameSpec


def slot(balls: Column, i: int) -> Column:
    """Ball of 0-based slot ``i``; null when the array is too short."""
    return F.get(balls, F.lit(i))


def slots(balls: Column, spec: GameSpec) -> list[Column]:
    return [slot(balls, i) for i in range(spec.slots)]


def total(cols: list[Column]) -> Column:
    return reduce(add, cols)


def count_if(conds: list[Column]) -> Column:
    return total([c.cast("int") for c in conds])


def ball_sum(balls: Column, spec: GameSpec) -> Column:
    return total(slots(balls, spec))


def mean(balls: Column, spec: GameSpec) -> Column:
    return ball_sum(balls, spec) / F.lit(spec.slots)


def median(ordered: Column, spec: GameSpec) -> Column:
    half = spec.slots // 2
    if spec.slots % 2:
        return slot(ordered, half).cast("double")
    return (slot(ordered, half - 1) + slot(ordered, half)) / F.lit(2)


def population_std(balls: Column, spec: GameSpec) -> Column:
    centre = mean(balls, spec)
    squares = [(b - centre) * (b - centre) for b in slots(balls, spec)]
    return F.sqrt(total(squares) / F.lit(spec.slots))


def even_count(balls: Column, spec: GameSpec) -> Column:
    return count_if([b % 2 == 0 for b in slots(balls, spec)])


def low_count(balls: Column, spec: GameSpec, cut: int | None = None) -> Column:
    cut = spec.low_cut if cut is None else cut
    return count_if([b <= cut for b in slots(balls, spec)])


def has_consecutive(ordered: Column, spec: GameSpec) -> Column:
    pairs = zip(slots(ordered, spec)[1:], slots(ordered, spec))
    return reduce(or_, [(b - a) == 1 for b, a in pairs])


def average_gap(ordered: Column, spec: GameSpec) -> Column:
    """Mean distance of neighbours; the inner terms of the sum cancel out."""
    return (slot(ordered, spec.slots - 1) - slot(ordered, 0)) / F.lit(spec.slots - 1)


def set_key(balls: Column, spec: GameSpec) -> Column:
    """Order-free identity of a number set as a bigint, one bit per number.

    Null for a wrong slot count or a number outside 1..62, so such a set never
    matches another one.
    """
    cells = slots(balls, spec)
    legal = reduce(and_, [b.between(1, KEY_BITS) for b in cells], F.size(balls) == spec.slots)
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, b) for b in cells]
    return F.when(legal, reduce(lambda x, y: x.bitwiseOR(y), bits))


def wide(balls: Column, spec: GameSpec, prefix: str = "b") -> list[Column]:
    """The slots as columns b1, b2, …"""
    return [slot(balls, i).alias(f"{prefix}{i + 1}") for i in range(spec.slots)]
