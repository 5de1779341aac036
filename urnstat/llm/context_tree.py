"""Language-model scoring by context-tree weighting over bytes.

Each byte of a lower-cased text is eight binary decisions; the context of a decision
is the bits of this byte so far and the ``d`` bytes before it, for every depth ``d``
up to ``DEPTH``. Each node holds Krichevsky-Trofimov estimates of its counts, and
weights by evidence mix all depths, so the model gives a code length for every byte.

Training counts byte strings of ``DEPTH + 1`` over the whole training texts with Spark;
shorter contexts are sums of longer ones. Every context that occurs is kept, at any size
of the corpus, so the model grows with it and stays in Spark tables. Strings that end in
the same ``ROOT`` bytes of context meet in one task, which holds a run of such subtrees
at a time: a first pass gives the evidence of their roots, the driver mixes the depths
above (bounded by the number of byte pairs), a second pass carries the mixture down and
gives each string its code length. Strings of held-out texts go along with count 0.
Strings that hold one part in ``COMMON_STRINGS`` of all positions (a bounded number) are
looked up in the task, all others are joined.

A text is coded as its bytes and one end symbol, after a start of pad symbols (bytes
that UTF-8 never uses). The unigram base counts words the same way over all training
texts: words that hold a large enough share (again a bounded number) are looked up in
the task, all others are joined. Null texts are empty; an empty training set leaves
uniform estimates; repeated rows are counted and scored one by one; null ids train.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnstat.llm.common import find_byte_words, id_remainder, slices, texts_of
from urnstat.session import materialize

DEPTH = 5
#: Bytes of context that strings of one subtree share.
ROOT = 3
#: Only for ``learn``, the tree in one process: a context is kept from one part in this on.
SHARE = 60_000
PAD, STOP = 0xFE, 0xFF
#: Bytes that are scored side by side in one row of a matrix.
STRIDE = 256
#: A word is looked up in the task if it holds one part in this of the tokens or more.
COMMON = 200_000
#: A string of ``DEPTH + 1`` bytes is looked up in the task if it holds one part in this of all positions or more.
COMMON_STRINGS = 8_000_000
#: Strings whose subtrees a task holds at once, as far as a subtree is not larger.
TREE_ROWS = 100_000
HELD_OUT, REMAINDER = 7, 2
#: Text bytes that a task gathers before it counts or scores them.
CHUNK = 2 << 20
#: Counted strings that a task gathers before it adds up equal ones; half as many different ones leave it.
RUN_ROWS = 1 << 20
#: Different words that a task counts before they leave it.
WORD_ROWS = 1 << 17


def lowered(text: str) -> bytes:
    return text.encode().lower()  # A-Z only


def _groups(texts: list[bytes]):
    """Runs of texts of about ``CHUNK`` bytes, as (first, stop)."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def coded_strings(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings of ``depth + 1`` bytes, the newest lowest, and the text each is of, ``CHUNK`` bytes at a time."""
    pad, stop, more = bytes([PAD]) * depth, bytes([STOP]), 7 - depth
    joined = b"".join([*(pad + t + stop for t in texts), bytes(more)])
    size = max(0, len(joined) - 7)
    # The eight bytes from every place on, of which the string is the first ``depth + 1``.
    eights = np.ndarray(size, "<u8", joined, strides=(1,))
    # A string belongs to the text that holds its newest byte. A pad is never coded, so no string crosses texts.
    ends = np.cumsum([len(t) + 1 for t in texts]) + depth * np.arange(len(texts))
    firsts = ends - [len(t) + 1 for t in texts]
    for at in range(0, size, CHUNK):
        code = eights[at : at + CHUNK].copy().byteswap(inplace=True)
        code >>= np.uint64(8 * more)
        first, end = np.clip(firsts - at, 0, len(code)), np.clip(ends - at, 0, len(code))
        parts = [code[a:b] for a, b in zip(first.tolist(), end.tolist())]
        yield np.concatenate(parts).view(np.int64), np.repeat(np.arange(len(texts)), end - first)


def _added(runs: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Runs of (codes in order, numbers …) as one, the numbers of a code added up."""
    code, *numbers = (np.concatenate(c) for c in zip(*runs))
    order = np.argsort(code, kind="stable")  # which merges what is in order
    code = code[order]
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return [code[begins], *(np.add.reduceat(n[order], begins) for n in numbers)]


def strings(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``code, n, m`` over all whole texts, summed in parts: times in texts that are not held out, times in all."""

    def run(batches):
        runs, rows = [], 0
        for batch in slices(batches, 4096):
            texts, held = [lowered(t) for t in texts_of(batch, "text")], batch.column("held_out").to_pylist()
            for kind in (False, True):
                chosen = [t for t, h in zip(texts, held) if h == kind]
                for a, b in _groups(chosen):
                    for code, _ in coded_strings(chosen[a:b], depth):
                        code, m = np.unique(code, return_counts=True)
                        runs.append((code, np.zeros_like(m) if kind else m, m))
                        rows += len(code)
                        if rows >= RUN_ROWS:
                            runs = [_added(runs)]
                            rows = len(runs[0][0])
                        if rows >= RUN_ROWS // 2 and len(runs) == 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in runs[0]], ["code", "n", "m"])
                            runs, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(runs)], ["code", "n", "m"])

    return docs.select("text", "held_out").mapInArrow(run, "code bigint, n bigint, m bigint")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0, by Stirling's series."""
    shifted, product = x.astype(float), np.ones_like(x, float)
    for _ in range(8):
        low = shifted < 8
        product = np.where(low, product * shifted, product)
        shifted = np.where(low, shifted + 1, shifted)
    inverse = 1 / shifted
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _pairs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary nodes above 256 symbols, level by level."""
    zeros, ones = [], []
    for level in range(8):
        split = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(-1)
        zeros.append(split[..., 0])
        ones.append(split[..., 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def _evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    half = math.lgamma(0.5)
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - 2 * half - _lgamma(zeros + ones + 1)


class Automaton:
    """States (kept contexts), the next state for each byte, log10 code of each byte."""

    def __init__(self, contexts: list[tuple[int, int]], counts: np.ndarray, depth: int):
        """``contexts``: (length, code), shortest first, the empty one first of all."""
        place = {c: i for i, c in enumerate(contexts)}
        size = len(contexts)
        lengths = np.array([d for d, _ in contexts])
        parent = np.array([0] + [place[d - 1, code & (1 << 8 * (d - 1)) - 1] for d, code in contexts[1:]])
        rest = counts.copy()
        np.subtract.at(rest, parent[1:], counts[1:])
        has_child = np.zeros(size, bool)
        has_child[parent[1:]] = True
        stay = np.ones((size, 255), np.float32)  # weight of a node's own estimate against its children's
        inner = np.zeros((size, 255))  # log evidence of the children and the remainder
        for d in range(depth, -1, -1):
            for rows in np.array_split(np.flatnonzero(lengths == d), max(1, size // 2048)):
                own = _evidence(*_pairs(counts[rows]))
                total = own.copy()
                split = np.flatnonzero(has_child[rows])
                if len(split):
                    below = inner[rows[split]] + _evidence(*_pairs(rest[rows[split]]))
                    both = np.logaddexp(own[split], below) - math.log(2)
                    stay[rows[split]] = np.exp(own[split] - math.log(2) - both)
                    total[split] = both
                if d:
                    np.add.at(inner, parent[rows], total)
        del inner
        gathered, pass_on = np.zeros((size, 255), np.float32), np.ones((size, 255), np.float32)
        self.codes = np.zeros((size, 256), np.float32)
        for d in range(depth + 1):
            for rows in np.array_split(np.flatnonzero(lengths == d), max(1, size // 2048)):
                zeros, ones = _pairs(counts[rows])
                own = (ones + 0.5) / (zeros + ones + 1)
                before = (gathered[parent[rows]], pass_on[parent[rows]]) if d else (0.0, 1.0)
                gathered[rows] = before[0] + before[1] * stay[rows] * own
                pass_on[rows] = before[1] * (1 - stay[rows])
                zeros, ones = _pairs(rest[rows])
                one = gathered[rows] + pass_on[rows] * (ones + 0.5) / (zeros + ones + 1)
                logs = np.zeros((len(rows), 1))
                for level in range(8):
                    p = np.clip(one[:, (1 << level) - 1 : (2 << level) - 1], 1e-12, 1 - 1e-12)
                    logs = (logs[:, :, None] + np.log10(np.stack([1 - p, p], axis=2))).reshape(len(rows), 2 << level)
                self.codes[rows] = logs
        self.next = np.zeros((size, 256), np.uint16 if size <= 1 << 16 else np.int32)
        by_length = [dict() for _ in range(depth + 1)]
        for i, (d, code) in enumerate(contexts):
            by_length[d][code] = i
        for i, (d, code) in enumerate(contexts):
            # The longest kept context that ends this one and one more byte: with the
            # oldest byte, or what it is without that byte.
            if d:
                self.next[i] = self.next[parent[i]]
            if d < depth:
                for byte, child in self._longer(by_length[d + 1], code):
                    self.next[i, byte] = child
        self.depth = depth

    def _longer(self, codes: dict[int, int], code: int):
        """Kept contexts that are ``code`` and one more byte."""
        return [(byte, codes[key]) for byte in range(256) if (key := code << 8 | byte) in codes]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        depth, pad, stop = self.depth, bytes([PAD]), bytes([STOP])
        out = np.zeros(len(texts))
        for a, b in _groups(texts):
            joined = np.frombuffer(b"".join([pad * depth + t + stop for t in texts[a:b]]), np.uint8)
            sizes = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
            firsts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]]) + depth
            # Cut into strips that are walked side by side; the state hangs on ``depth`` bytes only.
            strips = -(-sizes // STRIDE)
            owner = np.repeat(np.arange(b - a), strips)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
            at = firsts[owner] + nth * STRIDE
            width = np.minimum(STRIDE, sizes[owner] - nth * STRIDE)
            order = np.argsort(-width, kind="stable")
            at, width, owner = at[order], width[order], owner[order]
            alive = np.searchsorted(-width, -np.arange(STRIDE), side="left")  # strips longer than i
            state = np.zeros(len(at), np.int64)
            for i in range(depth, 0, -1):
                state = self.next[state, joined[at - i]]
            sums = np.zeros(len(at))
            for i in range(STRIDE):
                n = int(alive[i])
                if not n:
                    break
                byte = joined[at[:n] + i]
                sums[:n] += self.codes[state[:n], byte]
                state[:n] = self.next[state[:n], byte]
            out[a:b] = np.bincount(owner, sums, b - a)
        return out


def learn(docs: DataFrame, depth: int = DEPTH, share: int = SHARE) -> Automaton:
    """The weighted tree of all whole texts of ``docs`` as one automaton, for small corpora and tests.

    ``score`` does not use it: contexts under one part in ``share`` are left to their parents.
    """
    counted = strings(docs.withColumn("held_out", F.lit(False)), depth)
    level = materialize(counted.groupBy("code").agg(F.sum("n").alias("n")), f"strings-{depth}")
    positions = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, -(-positions // share))
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(depth, -1, -1):
        context = F.shiftrightunsigned("code", 8)
        # At most ``share`` contexts of a depth hold so much, so the hint's side is bounded.
        kept = level.groupBy(context.alias("context")).agg(F.sum("n").alias("all")).where(F.col("all") >= least)
        wanted = level.withColumn("context", context).join(F.broadcast(kept.select("context")), "context")
        got = wanted.select("context", F.col("code").bitwiseAND(F.lit(255)).alias("byte"), "n").toArrow()
        found.append((d, *(got.column(c).to_numpy() for c in ("context", "byte", "n"))))
        if d:
            mask = F.lit((1 << 8 * d) - 1).cast("long")
            level = level.groupBy(F.col("code").bitwiseAND(mask).alias("code")).agg(F.sum("n").alias("n"))
            level = materialize(level, f"strings-{d - 1}")
    contexts: list[tuple[int, int]] = [(0, 0)]
    for d, context, _, _ in reversed(found[:-1]):
        contexts += [(d, int(c)) for c in np.unique(context)]
    place = {c: i for i, c in enumerate(contexts)}
    counts = np.zeros((len(contexts), 256))
    for d, context, byte, n in found:
        rows = np.fromiter((place[d, c] for c in context.tolist()), np.int64, len(context))
        np.add.at(counts, (rows, byte.astype(np.int64)), n)
    return Automaton(contexts, counts, depth)


def _up(keys: np.ndarray, d: int) -> np.ndarray:
    """Keys (context of ``d + 1`` bytes, node) as those of the contexts of ``d`` bytes."""
    return (keys >> 8 & (1 << 8 * d) - 1) << 8 | keys & 0xFF


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log evidence of nodes with children and the weight of their own estimates."""
    own = _evidence(zeros, ones)
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class Subtrees:
    """Contexts of ``top`` to ``depth`` bytes of all strings given, by sorted (context, binary node) keys.

    Only nodes that a string passes are here. Of any other one a context knows nothing:
    it gives one half and evidence 1, which leaves the mixture as the shorter contexts have it.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, total: np.ndarray, depth: int, top: int, leaf: bool):
        """``keys``: of contexts of ``depth`` bytes; ``total``: evidence below, or for ``leaf`` nothing is below."""
        self.levels, place = [], None  # deepest first: keys, own estimate, its weight, places in the next level
        for d in range(depth, top - 1, -1):
            found, place = np.unique(keys if d == depth else _up(keys, d), return_inverse=True)
            zeros, ones, total = (np.bincount(place, v, len(found)) for v in (zeros, ones, total))
            if leaf and d == depth:
                total, stay = _evidence(zeros, ones), np.ones(len(found))
            else:
                total, stay = _mixed(zeros, ones, total)
            self.levels.append((found, (ones + 0.5) / (zeros + ones + 1), stay, place))
            keys = found
        self.keys, self.zeros, self.ones, self.total = keys, zeros, ones, total

    def down(self, gathered: np.ndarray, pass_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixture at the keys given at first, from that of the parents of ``keys``."""
        for _, own, stay, place in reversed(self.levels):
            gathered, pass_on = (gathered + pass_on * stay * own)[place], (pass_on * (1 - stay))[place]
        return gathered, pass_on


def _leaves(code: np.ndarray, n: np.ndarray, depth: int) -> tuple[Subtrees, np.ndarray]:
    """Subtrees of strings, and the bits (strings × 8) of their newest bytes."""
    byte, level = (code & 0xFF)[:, None], np.arange(8)
    bits = byte >> 7 - level & 1
    keys = (code >> 8)[:, None] << 8 | 1 << level | byte >> 8 - level
    ones = bits * n[:, None].astype(float)
    zeros = n[:, None] - ones
    return Subtrees(keys.ravel(), zeros.ravel(), ones.ravel(), np.zeros(keys.size), depth, ROOT, True), bits


def _whole_roots(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by root, cut between roots into runs of ``TREE_ROWS`` or a little more."""
    kept: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        kept.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        held += batch.num_rows
        if held < TREE_ROWS:
            continue
        rows = [np.concatenate(c) for c in zip(*kept)]
        root = rows[0] >> 8 & (1 << 8 * ROOT) - 1
        cut = int(np.searchsorted(root == root[-1], True))  # the last root may go on
        if cut:
            yield [c[:cut] for c in rows]
        kept, held = [[c[cut:] for c in rows]], len(root) - cut
    if held:
        yield [np.concatenate(c) for c in zip(*kept)]


def string_codes(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``code, m, log``: log10 code of the newest byte after the bytes before it, of every string in ``code, n, m``."""
    root = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit((1 << 8 * ROOT) - 1))
    counted = materialize(counted, "strings").withColumn("root", root)
    dealt = counted.repartition("root").sortWithinPartitions("root").select("code", "n", "m")

    def rise(batches):
        for code, n, _ in _whole_roots(batches, ("code", "n", "m")):
            tree, _ = _leaves(code, n, depth)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (tree.keys, tree.zeros, tree.ones, tree.total)], ["key", "z", "o", "t"])

    roots = dealt.mapInArrow(rise, "key bigint, z double, o double, t double")
    up = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * (ROOT - 1)) - 1))
    key = F.shiftleft(up, 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    # At most 256 nodes for each context of ROOT - 1 bytes, whatever the corpus.
    upper = roots.groupBy(key.alias("key")).agg(*[F.sum(c).alias(c) for c in "zot"]).orderBy("key").toArrow()
    keys, zeros, ones, total = (upper.column(c).to_numpy() for c in ("key", "z", "o", "t"))
    crown = Subtrees(keys, zeros, ones, total, ROOT - 1, 0, False)
    gathered, pass_on = crown.down(np.zeros(len(crown.keys)), np.ones(len(crown.keys)))

    def fall(batches):
        for code, n, m in _whole_roots(batches, ("code", "n", "m")):
            tree, bits = _leaves(code, n, depth)
            at = np.searchsorted(keys, _up(tree.keys, ROOT - 1))
            one, _ = tree.down(gathered[at], pass_on[at])
            one = np.clip(one.reshape(-1, 8), 1e-12, 1 - 1e-12)
            log = np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(m), pa.array(log)], ["code", "m", "log"])

    return dealt.mapInArrow(fall, "code bigint, m bigint, log double")


class Lookup:
    """Values of codes, by buckets of a multiplicative hash."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        """The earlier a code comes, the sooner it is found."""
        bits = max(4, (2 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = self._slot(codes)
        order = np.argsort(slot, kind="stable")
        self.codes, self.values = np.append(codes[order], -1), np.append(values[order], 0.0)
        self.starts = np.searchsorted(slot[order], np.arange((1 << bits) + 1)).astype(np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which codes are known; the value of others means nothing."""
        slot = self._slot(codes)
        at = self.starts[slot]
        known = self.codes[at] == codes
        left = np.flatnonzero(~known)
        while len(left := left[at[left] + 1 < self.starts[slot[left] + 1]]):
            at[left] += 1
            fits = self.codes[at[left]] == codes[left]
            known[left[fits]] = True
            left = left[~fits]
        return self.values[at], known


def score_strings(texts: list[bytes], lookup: Lookup, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the codes of each text's known strings; other strings and their texts, in order of texts."""
    sums, others = np.zeros(len(texts)), []
    for a, b in _groups(texts):
        for code, owner in coded_strings(texts[a:b], depth):
            value, known = lookup.find(code)
            sums[a:b] += np.bincount(owner[known], value[known], b - a)
            others.append((code[~known], owner[~known] + a))
    return sums, *(np.concatenate([o[i] for o in others] or [np.zeros(0, np.int64)]) for i in (0, 1))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, c``: how often each word occurs in all whole texts."""

    def counted_so_far(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])

    def run(batches):
        counts = Counter()
        for batch in slices(batches):
            for t in texts_of(batch, "text"):
                counts.update(find_byte_words(lowered(t)))
                if len(counts) >= WORD_ROWS:
                    yield counted_so_far(counts)
                    counts = Counter()
        yield counted_so_far(counts)

    counted = docs.select("text").mapInArrow(run, "word binary, c bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, depth: int = DEPTH, common_strings: int = COMMON_STRINGS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Documents whose id's remainder is ``REMAINDER`` are held out: nothing is learnt from them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = id_remainder("doc_id", HELD_OUT) == REMAINDER
    training = docs.where(~held_out)
    counted = strings(docs.select("text", held_out.alias("held_out")), depth)
    counted = counted.groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    codes = materialize(string_codes(counted, depth), "codes")
    positions = codes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    frequent = F.col("m") * common_strings >= positions
    # Held-out positions count too, so no string that is left to the join is hot.
    top = codes.where(frequent).orderBy(F.desc("m"), "code").toArrow()
    lookup = Lookup(top.column("code").to_numpy(), top.column("log").to_numpy())
    counts = materialize(word_counts(training), "words")
    ends = training.count()
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = row[0] + ends, row[1] + (ends > 0)
    # A word with one part in COMMON of all tokens: there are COMMON of them at most.
    common = counts.where(F.col("c") * COMMON >= tokens).toArrow()
    known = dict(zip(common.column("word").to_pylist(), np.log10(common.column("c").to_numpy() + 1.0).tolist()))
    end_score = math.log10(ends + 1)
    names = ["part", "nth", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare", "strings"]

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
        for batch in slices(batches, 1024):
            texts = [lowered(t) for t in texts_of(batch, "text")]
            tokens, found, logs, rare = [], [], [], []
            for t in texts:
                words = find_byte_words(t)
                values = list(map(known.get, words))
                others = [w for w, v in zip(words, values) if v is None]
                tokens.append(len(words) + 1)
                found.append(int(ends > 0) + len(words) - len(others))
                logs.append(end_score + sum(filter(None, values)))  # logs of counts above 0 are not 0
                rare.append(Counter(others).items())
            n = batch.num_rows
            flat = [pair for other in rare for pair in other]
            offsets = np.concatenate([[0], np.cumsum([len(other) for other in rare])]).astype(np.int32)
            values = pa.StructArray.from_arrays(
                [pa.array([w for w, _ in flat], pa.binary()), pa.array([k for _, k in flat], pa.int64())], fields=list(rare_type.value_type)
            )
            sums, others, owner = score_strings(texts, lookup, depth)
            string_offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(at, at + n)),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(tokens, pa.int64()),
                    pa.array(found, pa.int64()),
                    pa.array(logs, pa.float64()),
                    pa.array(sums),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.ListArray.from_arrays(pa.array(string_offsets), pa.array(others)),
                ],
                names,
            )
            at += n

    scored = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run,
        f"part int, nth bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, "
        "score double, rare array<struct<word: binary, times: bigint>>, strings array<bigint>",
    )
    scored = materialize(scored, "scores")
    words = (
        scored.select("part", "nth", F.explode("rare").alias("rare"))
        .select("part", "nth", "rare.word", "rare.times")
        .join(counts, "word")
        .select("part", "nth", "times", (F.col("times") * F.log10(F.col("c") + 1)).alias("logs"), F.lit(0.0).alias("log"))
    )
    others = (
        scored.select("part", "nth", F.explode("strings").alias("code"))
        .join(codes.where(~frequent).select("code", "log"), "code")
        .select("part", "nth", F.lit(0).cast("bigint").alias("times"), F.lit(0.0).alias("logs"), "log")
    )
    rest = (
        words.union(others)
        .groupBy("part", "nth")
        .agg(F.sum("times").alias("more"), F.sum("logs").alias("more_logs"), F.sum("log").alias("more_score"))
    )
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(tokens + distinct + 1)
    return scored.drop("rare", "strings").join(rest, ["part", "nth"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
