"""Growing and walking classification trees on numpy arrays, for one task at a time.

A tree grows level by level until its leaves are pure or their rows cannot be told
apart. All nodes of a level are split at once: the rows are sorted by node, value and class,
those with the same are put together, and running sums of squared class weights on both
sides give the Gini gain of every cut.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

import numpy as np

#: Rows that are walked through a tree at once, so that they stay near the processor.
STEP_ROWS = 4096
#: Nodes whose inputs are put in order at once.
STEP_NODES = 1 << 16
#: Levels after which rows that reached a leaf are left out.
STEP_LEVELS = 4


@dataclass
class Tree:
    """Nodes by index, level by level.

    ``feature`` is -1 for a leaf. The children of a node are ``left`` (value up to the
    threshold) and the one after it; a leaf has there the place of its ``size`` entries
    in ``label`` and ``share``.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    size: np.ndarray
    label: np.ndarray
    share: np.ndarray

    TYPES = {"feature": "int16", "threshold": "float64", "left": "int32", "size": "int16", "label": "int16", "share": "float64"}

    def packed(self) -> tuple[bytes, ...]:
        return tuple(getattr(self, f.name).astype(self.TYPES[f.name]).tobytes() for f in fields(self))

    @classmethod
    def unpacked(cls, parts) -> Tree:
        return cls(*(np.frombuffer(part, kind) for part, kind in zip(parts, cls.TYPES.values())))


    def thin(self) -> bytes:
        """The tree in a sixth of its room, for sending: places follow from the order of the
        nodes, thresholds are places among the different ones, and only leaves of several
        classes name their shares."""
        split = self.feature >= 0
        value, code = np.unique(self.threshold[split], return_inverse=True)
        leaves = self.size[~split]
        mixed = np.flatnonzero(leaves != 1)
        parts = [self.feature, code, self.label, mixed, leaves[mixed], value, self.share[np.repeat(leaves != 1, leaves)]]
        parts = [_narrow(p) if i < 5 else p.astype("float64") for i, p in enumerate(parts)]
        head = ",".join(f"{p.dtype.str}{len(p)}" for p in parts).encode()
        return head + b"\n" + b"".join(p.tobytes() for p in parts)

    @classmethod
    def thick(cls, sent: bytes) -> Tree:
        place = sent.index(b"\n") + 1
        parts = []
        for kind in sent[: place - 1].decode().split(","):
            parts.append(np.frombuffer(sent, kind[:3], int(kind[3:]), place))
            place += parts[-1].nbytes
        feature, code, label, mixed, size, value, share = parts
        split = feature >= 0
        leaves = np.ones(len(feature) - len(code), "int64")
        leaves[mixed] = size
        threshold, sizes, left, shares = np.zeros(len(feature)), np.zeros(len(feature), "int64"), np.empty(len(feature), "int64"), np.ones(len(label))
        threshold[split], sizes[~split] = value[code], leaves
        left[split], left[~split] = 1 + 2 * np.arange(len(code)), np.cumsum(leaves) - leaves
        shares[np.repeat(leaves != 1, leaves)] = share
        return cls(feature, threshold, left, sizes, label, shares)


def _narrow(part: np.ndarray) -> np.ndarray:
    low, high = (int(part.min()), int(part.max())) if len(part) else (0, 0)
    return part.astype(np.promote_types(np.min_scalar_type(low), np.min_scalar_type(high)))


@dataclass
class Coded:
    """Rows of inputs as places among the different values of each input, which split alike."""

    code: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Coded:
        code, values = np.empty(x.shape, "int32"), []
        for f in range(x.shape[1]):
            found, code[:, f] = np.unique(x[:, f], return_inverse=True)
            values.append(found)
        return cls(code, values)

    def different(self) -> tuple[Coded, np.ndarray]:
        """The different rows, and which of them each row is."""
        keys, room = [np.zeros(len(self.code), "int64")], 1
        for f, found in enumerate(self.values):  # as many inputs in a number as fit
            if room * len(found) >= 1 << 62:
                keys.append(np.zeros(len(self.code), "int64"))
                room = 1
            room *= max(1, len(found))
            keys[-1] = keys[-1] * len(found) + self.code[:, f]
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        which = np.empty(len(order), "int64")
        which[order] = np.cumsum(new) - 1
        return Coded(self.code[order[new]], self.values), which


def together(x: Coded, which: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[Coded, np.ndarray, np.ndarray]:
    """Rows with the same inputs, row ``which`` of ``x``, and the same class as one of their whole weight."""
    cells, place = np.unique(which * classes + y, return_inverse=True)
    return Coded(x.code[cells // classes], x.values), cells % classes, np.bincount(place, w)


def _sorted(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 to below ``top`` in order, and their places. Sorting numbers that
    carry their place is much faster than sorting places, so that is done where both fit."""
    room = int(len(keys)).bit_length()
    if int(top).bit_length() + room > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = (keys << room) | np.arange(len(keys))
    both.sort()
    return both >> room, both & ((1 << room) - 1)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


@dataclass
class Grove:
    """Several trees, as a task walks them one after another."""

    trees: Iterable[Tree]
    classes: int


def grove(trees: Iterable[Tree], classes: int) -> Grove:
    return Grove(trees, classes)


def grow(x: np.ndarray | Coded, y: np.ndarray, w: np.ndarray, classes: int, tries: int, rng, max_depth: int | None = None) -> tuple[Tree, int]:
    """One tree on rows ``x`` with classes ``y`` and whole weights ``w`` above 0, and its depth.

    Every node looks at ``tries`` random inputs, and at the others if those cannot split it.
    Only rows of nodes that were split go on to the next level.
    """
    x = x if isinstance(x, Coded) else Coded.of(x)
    row, y, w = np.arange(len(y)), y.astype("int64"), w.astype("int64")
    node = np.zeros(len(y), "int64")
    known, first = np.concatenate(x.values), np.cumsum([0, *map(len, x.values)])
    levels, labels, shares = [], [], []
    m, made, stored, depth = 1, 1, 0, 0
    while True:
        key, order = _sorted(node * classes + y, m * classes)
        begins = _starts(key)
        mass = np.add.reduceat(w[order], begins)
        at, label = key[begins] // classes, key[begins] % classes
        count, total = np.bincount(at, minlength=m), np.bincount(at, mass, m)
        feature, low, high, threshold = np.full(m, -1), *np.zeros((2, m), "int64"), np.zeros(m)
        if (count > 1).any() and (max_depth is None or depth < max_depth):
            own = np.empty_like(w)
            own[order] = np.repeat(mass, np.diff(begins, append=len(order)))
            squares = np.bincount(at, mass * mass, m)
            feature, low, high = _splits(x, row, y, w, own, node, count > 1, total, squares, classes, tries, rng)
        split = feature >= 0
        below, above = (known[first[feature[split]] + code[split]] for code in (low, high))
        middle = (below + above) / 2
        threshold[split] = np.where(middle < above, middle, below)
        size = np.where(split, 0, count)
        left = stored + np.cumsum(size) - size
        children = np.cumsum(split) - 1
        left[split] = made + 2 * children[split]
        ends = ~split[at]
        labels.append(label[ends])
        shares.append(mass[ends] / total[at[ends]])
        levels.append((feature, threshold, left, size))
        stored += int(size.sum())
        if not split.any():
            break
        going = split[node]
        row, y, w, node = row[going], y[going], w[going], node[going]
        node = 2 * children[node] + (x.code[row, feature[node]] > low[node])
        m = 2 * int(split.sum())
        made += m
        depth += 1
    return Tree(*(np.concatenate(c) for c in zip(*levels)), np.concatenate(labels), np.concatenate(shares)), depth


def _splits(x, row, y, w, own, node, open_, total, squares, classes, tries, rng):
    """Best input of every node of a level, and the codes next to its cut; input -1 where nothing splits it."""
    m, width = len(open_), x.code.shape[1]
    turn = rng.random((m, width))
    best, feature = np.full(m, -np.inf), np.full(m, -1)
    low, high = np.zeros(m, "int64"), np.zeros(m, "int64")
    for part in (slice(0, tries), slice(tries, width)):
        wanted = open_ & (feature < 0)
        rows = np.flatnonzero(wanted[node])
        if not rows.size:
            continue
        asked = np.flatnonzero(wanted)
        place = np.cumsum(wanted) - 1
        # Inputs of a node are tried in their order, each for all nodes at once.
        steps = (turn[asked[at : at + STEP_NODES]] for at in range(0, len(asked), STEP_NODES))
        inputs = np.concatenate([np.sort(step.argsort(1)[:, part], 1).astype("int16") for step in steps])
        mine, first, parts = place[node[rows]], row[rows] * width, (y[rows], w[rows], own[rows])
        for k in range(inputs.shape[1]):
            code = x.code.take(first + inputs[mine, k])
            at, gain, under, over = _best_cuts(code, *parts, mine, total[asked], squares[asked], classes)
            better = gain > best[asked[at]] + 1e-9
            at = at[better]
            best[asked[at]], feature[asked[at]] = gain[better], inputs[at, k]
            low[asked[at]], high[asked[at]] = under[better], over[better]
    return feature, low, high


def _best_cuts(code, label, weight, own, node, total, squares, classes):
    """The nodes that the code can cut, the best gain of each and the codes next to that cut.

    ``own`` is the weight of a row's class in its node. All sums are whole numbers.
    """
    bits, more = (classes - 1).bit_length(), int(code.max()).bit_length()
    key, order = _sorted((((node << more) | code) << bits) | label, len(total) << (more + bits))
    begins = _starts(key)  # rows of a node with the same code and class
    key, order = key[begins], (order, order[begins])
    weight, own = np.add.reduceat(weight[order[0]], begins), own[order[1]]
    at, node = key >> bits, key >> (more + bits)
    kind, order = _sorted((node << bits) | (key & ((1 << bits) - 1)), len(total) << bits)
    run = np.cumsum(weight[order]) - weight[order]
    begins = _starts(kind)
    before = np.empty_like(run)
    before[order] = run - np.repeat(run[begins], np.diff(begins, append=len(run)))
    able = np.flatnonzero((node[1:] == node[:-1]) & (at[1:] != at[:-1]))
    if not able.size:
        return able, np.empty(0), able, able
    # Sums from the start of the node; those before it are taken off.
    begins = _starts(node)
    ahead = np.repeat(begins, np.diff(begins, append=len(node)))[able]

    def running(step):
        sums = np.cumsum(step)
        return sums[able] - (sums - step)[ahead]

    left = running(weight * (2 * before + weight))
    right = squares[node[able]] - 2 * running(own * weight) + left
    weight_left = running(weight)
    gain = left / weight_left + right / (total[node[able]] - weight_left)
    begins = _starts(node[able])
    most = np.maximum.reduceat(gain, begins)
    hits = np.flatnonzero(gain == np.repeat(most, np.diff(begins, append=len(able))))
    cut = able[hits[np.searchsorted(hits, begins)]]
    mask = (1 << more) - 1
    return node[cut], most, at[cut] & mask, at[cut + 1] & mask


def votes(trees: Grove, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Sum over the trees of the class shares of every row's leaf; only of the trees that ``mask`` allows a row.

    Rows with the same inputs are walked once, and without a mask also voted on once.
    """
    x = np.ascontiguousarray(x, "float64")
    same = np.empty(len(x), "int64")
    order = np.lexsort(x.T) if len(x) > 1 else np.arange(len(x))
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
    same[order] = np.cumsum(new) - 1
    different = x[order[new]]
    first = np.arange(len(different) if mask is None else len(x)) * trees.classes
    sums = np.zeros(len(first) * trees.classes)
    for i, tree in enumerate(trees.trees):
        walk = _walker(tree)
        leaf = np.concatenate([np.empty(0, "int64"), *(walk(different[at : at + STEP_ROWS]) for at in range(0, len(different), STEP_ROWS))])
        cell = first
        if mask is not None:
            rows = np.flatnonzero(mask[:, i])
            leaf, cell = leaf[same[rows]], first[rows]
        size, entry = tree.size[leaf], tree.left[leaf]
        for k in range(int(size.max(initial=0))):  # no row meets a class of its leaf twice
            held = slice(None) if size.min() > k else np.flatnonzero(size > k)
            sums[cell[held] + tree.label[entry[held] + k]] += tree.share[entry[held] + k]
    sums = sums.reshape(-1, trees.classes)
    return sums[same] if mask is None else sums


def _walker(tree: Tree):
    """The leaves that rows reach. A leaf leads to itself, so rows go down together."""
    leaf = tree.feature < 0
    feature = np.where(leaf, 0, tree.feature).astype("int64")
    threshold = np.where(leaf, np.inf, tree.threshold)
    left = np.where(leaf, np.arange(len(leaf)), tree.left).astype("int64")

    def walk(x: np.ndarray) -> np.ndarray:
        values, out = x.ravel(), np.zeros(len(x), "int64")
        live = np.arange(len(x))
        first = live * x.shape[1]
        at = out.copy()
        while live.size:
            for _ in range(STEP_LEVELS):
                at = left.take(at) + (values.take(first + feature.take(at)) > threshold.take(at))
            going = ~leaf.take(at)
            out[live[~going]] = at[~going]
            live, first, at = live[going], first[going], at[going]
        return out

    return walk
