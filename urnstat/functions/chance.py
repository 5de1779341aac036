"""Seeded pseudo-randomness that depends on keys, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *parts: Column) -> Column:
    """Hex digest of ``seed:part:part…``; also a random sort key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int, *parts: Column) -> Column:
    """Uniform in (0, 1), never 0 or 1, so its logarithm is finite."""
    draw = F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("long")
    return (draw + 0.5) / float(1 << 32)


def shuffled_domain(high: int, seed: int, *parts: Column) -> Column:
    """The numbers 1..high in a random order fixed by ``seed`` and ``parts``."""
    numbers = F.sequence(F.lit(1), F.lit(high))
    keyed = F.transform(numbers, lambda n: F.struct(digest(seed, *parts, n).alias("k"), n.alias("n")))
    return F.transform(F.sort_array(keyed), lambda s: s["n"])
