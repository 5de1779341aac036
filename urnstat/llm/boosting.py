"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are. Trees are grown from a bounded sample of
at most ``SAMPLE_ROWS`` labelled ids, the smallest by a hash of the id, and of at most as
many different (id, statistics) of theirs, the smallest by a hash of both, so training
takes the same memory at any size of the corpus; scoring covers every row.
Trees are flattened into arrays and all rows of a batch walk a tree at once.

Null and empty texts have all statistics 0 and a score like any other row. Labels
with a null id or quality are not learnt from, nor are ids with contradicting labels;
repeated equal labels count once. Without two classes to learn from every score is
the share of label 1, or 0.5 without labels. Repeated rows are scored one by one, an
empty table gives no rows, and columns beside the id and the text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnstat.llm.common import find_words, id_remainder, slices, texts_of

#: Most labelled rows that trees are grown from.
SAMPLE_ROWS = 20_000
TREES = 60
DEPTH = 4
RATE = 0.15
BINS = 64
LEAST_WEIGHT = 2.0
SHRINK = 1.0
#: Scores from here on predict label 1.
THRESHOLD = 0.3
HELD_OUT = 5

STATISTICS = (
    "words",
    "mean_word",
    "distinct_share",
    "top_word_share",
    "follow_share",
    "upper_share",
    "digit_share",
    "other_share",
    "symbols_per_word",
    "shouts_per_word",
    "commas_per_word",
    "stops_per_word",
    "bare_line_share",
    "repeated_line_share",
    "words_per_line",
    "bar_share",
    "packed_share",
)


def statistics(text: str) -> list[float]:
    """The numbers that trees look at, in the order of ``STATISTICS``."""
    words = find_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = sum(map(len, words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    follow = sum(map(str.__eq__, words, words[1:]))
    raw = text.encode()
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [s for line in text.split("\n") if (s := line.strip())] or [text]
    bare = sum(line[-1] not in ".!?…\"'”’。！？" for line in lines)
    letters = int(codes[65:91].sum() + codes[97:123].sum() + codes[128:].sum())
    upper = int(codes[65:91].sum())
    digits = int(codes[48:58].sum())
    return [
        float(n),
        chars / n,
        len(counts) / n,
        max(counts.values()) / n,
        follow / n,
        upper / max(1, letters),
        digits / chars,
        max(0, chars - letters - digits) / chars,
        int(codes[[35, 36, 37, 38, 42, 60, 62, 124]].sum()) / n,
        int(codes[33]) / n,
        int(codes[44]) / n,
        int(codes[46]) / n,
        bare / len(lines),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        counts.get("|", 0) / n,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


@dataclass
class Trees:
    """All trees as arrays, ``2 ** DEPTH - 1`` inner nodes then leaves for each."""

    base: float
    feature: np.ndarray  # trees × inner nodes
    limit: np.ndarray  # trees × inner nodes: a row goes right above it
    value: np.ndarray  # trees × leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Fit by logistic loss; each split is the best of the gradient histograms."""
    inner = 2**depth - 1
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        # Nothing to tell apart: the share itself, kept off the ends of the scale.
        share = min(max(share, 1e-6), 1 - 1e-6)
        trees = 0
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if trees else []
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if trees else None
    features = x.shape[1]
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            at = (local[:, None] * features + np.arange(features)) * BINS + binned
            size = width * features * BINS
            shape = (width, features, BINS)
            g = np.bincount(at.ravel(), np.repeat(gradient, features), size).reshape(shape).cumsum(-1)
            h = np.bincount(at.ravel(), np.repeat(weight, features), size).reshape(shape).cumsum(-1)
            all_g, all_h = g[..., -1:], h[..., -1:]
            gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain = np.where((h >= LEAST_WEIGHT) & (all_h - h >= LEAST_WEIGHT), gain, 0).reshape(width, -1)
            best = gain.argmax(axis=1)
            for i in np.flatnonzero(gain.max(axis=1) > 1e-9):
                feature, cut = divmod(int(best[i]), BINS)
                out.feature[t, first + i], out.limit[t, first + i] = feature, edges[feature][min(cut, len(edges[feature]) - 1)]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.limit[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        out.value[t] = -RATE * g / (h + SHRINK)
        margin += out.value[t, leaf]
    return out


def _measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``label_id, label, x`` of labelled rows."""
    kind = docs.schema["label_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            x = [statistics(t) for t in texts_of(batch, text_column)]
            columns = [batch.column("label_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label_id", "label", "x"])

    return docs.select("label_id", "label", text_column).mapInArrow(run, f"label_id {kind}, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from the labelled documents whose id's remainder is not 0.

    The ``rows`` ids taken are a bounded top-k, so the hint to broadcast them and the
    collected statistics are bounded too. Repeated labels and documents are one before
    they are counted against the bound, and the bound does not look at the label.
    """
    order = (F.xxhash64("label_id"), F.col("label_id"))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_remainder("doc_id", HELD_OUT) != 0))
    quality = F.col("quality").cast("int")
    sample = usable.groupBy(F.col("doc_id").alias("label_id")).agg(F.min(quality).alias("label"), F.max(quality).alias("high"))
    sample = sample.where(F.col("label") == F.col("high")).select("label_id", "label").orderBy(*order).limit(rows)
    ids = docs["doc_id"] == sample["label_id"]
    found = _measured(docs.select("doc_id", "text").join(F.broadcast(sample), ids)).groupBy("label_id", "x").agg(F.min("label").alias("label"))
    got = found.orderBy(F.xxhash64("label_id", "x"), "label_id", "x").limit(rows).orderBy("label", "x").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return grow(x, got.column("label").to_numpy().astype(float))


def predict(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts_of(batch, "text")]).reshape(-1, len(STATISTICS))
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(trees.score(x))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score"])

    held_out = (id_remainder("doc_id", HELD_OUT) == 0).alias("held_out")
    scored = docs.select("doc_id", held_out, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns."""

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts_of(batch, text_column)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(trees.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, train(docs, labels))
