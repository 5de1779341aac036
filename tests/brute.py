"""Plain-Python versions of operators, for small fixtures."""

from __future__ import annotations

import random
from itertools import combinations


def make_rows(n, seed=1, series=("a", "b", "c"), weights=(6, 3, 1), high=50, slots=5, bonus_high=20):
    """Draw rows; the first series holds most of them, ids are shuffled."""
    rng = random.Random(seed)
    ids = list(range(n))
    rng.shuffle(ids)
    return [
        (
            rng.choices(series, weights)[0],
            i,
            f"2020-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" if rng.random() > 0.02 else None,
            rng.sample(range(1, high + 1), slots),
            rng.randint(1, bonus_high),
        )
        for i in ids
    ]


def by_series(rows):
    """Rows of every series, oldest first, undated first."""
    out = {}
    for row in sorted(rows, key=lambda r: (r[2] or "", r[1])):
        out.setdefault(row[0], []).append(row)
    return out


def look_back(rows, numbers, direction="past"):
    """(series, seq) → previous common count, hit rate, rolling counts."""
    out = {}
    for series, ordered in by_series(rows).items():
        seqs = list(range(len(ordered)))
        if direction == "file":
            ordered, seqs = ordered[::-1], seqs[::-1]
        for i, row in enumerate(ordered):
            balls = set(row[3])
            prev = len(balls & set(ordered[i - 1][3])) if i else 0
            past = set().union(*[set(r[3]) for r in ordered[max(i - 5, 0) : i]])
            rolling = [
                float(sum(n in r[3] or n == r[4] for r in ordered[i - 9 : i + 1])) if i >= 9 else None for n in numbers
            ]
            out[series, seqs[i]] = (prev, len(balls & past) / len(row[3]), *rolling)
    return out


def extremes(grid, bonus, slots):
    """Best and worst combination by listing all of them."""
    numbers = sorted({n for _, n in grid})
    scored = [
        (sum(grid[i + 1, n] for i, n in enumerate(c)), c) for c in combinations(numbers, slots)
    ]
    best = min(scored, key=lambda s: (-s[0], s[1]))
    worst = min(scored)
    return (best[1], max(bonus, key=lambda b: (bonus[b], -b))), (worst[1], min(bonus, key=lambda b: (bonus[b], b)))
