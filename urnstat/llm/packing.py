"""Best-fit packing of token sequences by length patterns.

1. Documents become ids; one longer than the capacity is cut into full pieces and
   a rest. Each piece gets a number among the pieces of its length.
2. The histogram of lengths, at most one row per length, goes to the driver. There
   patterns of few documents that fill a sequence are enumerated on a grid of
   lengths, repeat counts are fitted to the histogram by non-negative least
   squares and rounded down. Each repeat takes real lengths: all but the last from
   the pattern, the last as the longest piece that still fits. What the rounding
   leaves is packed best fit, longest first, again on the histogram.
3. A piece finds its sequence and offset from its number and the plan, so no group
   of pieces ever meets in one task.

Null and empty texts have only the end token. A null id is carried like any other,
repeated rows are packed once per row, an empty table gives no rows, and columns
beside the id and the text are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urnstat.llm.common import slices, texts_of
from urnstat.session import materialize

CAPACITY = 4096
#: The token that ends every document.
END = 1
#: Grid cells per sequence and documents per pattern in the least-squares fit.
CELLS = 256
PATTERN_DOCS = 3
#: The fit ends when nothing gains more than this share of the first gain; repeats are whole numbers anyway.
FIT_SLACK = 1e-4
#: Words and word parts that one Python worker remembers.
MEMO_ROWS = 400_000
MEMO_CHARS = 64

#: Letters below U+0250. In normalised text made of such characters only, the end
#: of a run of letters always ends a token, whatever follows.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: Without the four separators that Python splits at and the tokenizer does not.
_NARROW = re.compile("[\x00-\x1b\x20-ɏ]*").fullmatch
_PARTS = re.compile(f"[^ \\t\\n\\r\\f\\v{_LETTERS}]*[{_LETTERS}]+|[^ \\t\\n\\r\\f\\v{_LETTERS}]+").findall
#: Marks after a letter and before white space, which are words of their own.
_FREE = re.compile(f"([.,;:!?])(?<=[{_LETTERS}].)(?!\\S)").sub
#: Byte-level tokenizers spell bytes that do not print as characters from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


class WordEncoder:
    """Ids of whole texts for tokenizers that never join tokens across white space.

    Texts fall into words, and unknown words into parts, at places where such a tokenizer
    always ends a token; what a word or part gave is remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.memo = Memo(self.ids)

    def encode(self, text: str) -> np.ndarray:
        if _NARROW(text) and unicodedata.is_normalized("NFC", text):
            words = _FREE(r" \1", text.lower()).split()
        else:
            words = [p for p in re.split("[ \n]+", text) if p]
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.uint32)

    def ids(self, part: str) -> list[int]:
        if part.isalpha() and part.islower() and (part.isascii() or _NARROW(part) and part == part.lower()):
            # Letters only: neither the normaliser nor the split would change it.
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            return [t.id for t in self.model.tokenize(spelled)]
        return self.tokenizer.encode(part, add_special_tokens=False).ids


class Memo(dict):
    """Ids as bytes by word or part, made when first asked for.

    When full the later half goes: common words come early, so they stay.
    """

    def __init__(self, ids: Callable[[str], list[int]]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        parts = [word]
        if not word.isalpha() and _NARROW(word) and word == word.lower() and unicodedata.is_normalized("NFC", word):
            parts = _PARTS(word)
        made = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else array("I", self.ids(word)).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ROWS:
                for late in list(self)[MEMO_ROWS // 2 :]:
                    del self[late]
            self[word] = made
        return made


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token pieces ``doc_id, piece, start, length, ids_crc32, part, nth``.

    ``nth`` counts the pieces of one length inside the writing task ``part``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], np.uint32).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in slices(batches):
            rows: list[list] = [[] for _ in names]
            origin = []
            for row, text in enumerate(texts_of(batch, "text")):
                data = encode(text).tobytes() + tail
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    length = len(cut) // 4
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    origin.append(row)
                    for values, value in zip(rows[1:], (piece, at // 4, length, zlib.crc32(cut), part, nth)):
                        values.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            ids = batch.column(0).take(pa.array(origin, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(rows[1:], kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    )


def patterns(cells: int, most: int) -> np.ndarray:
    """All ways to fill ``cells`` with 1 … ``most`` sizes, as columns of counts per size 1 … cells."""
    found: list[tuple[int, ...]] = []

    def grow(rest: int, largest: int, left: int, taken: tuple[int, ...]) -> None:
        if rest <= largest:
            found.append((*taken, rest))
        if left > 1:
            for size in range(min(largest, rest - 1), 0, -1):
                if size * left < rest:
                    break
                grow(rest - size, size, left - 1, (*taken, size))

    grow(cells, cells, most, ())
    out = np.zeros((cells, len(found)))
    for column, sizes in enumerate(found):
        for size in sizes:
            out[size - 1, column] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, slack: float = 1e-9, most: int = 1000) -> np.ndarray:
    """Non-negative least squares by an active set: min ‖a x − b‖ with x ≥ 0.

    Ends when no column's gain is above ``slack`` of the largest at the start.
    """
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    target = a.T @ b
    slack *= max(1e-300, float(np.abs(target).max(initial=0)))
    for _ in range(most if a.shape[1] else 0):
        gradient = np.where(free, -np.inf, target - a.T @ (a @ x))
        best = int(gradient.argmax())
        if gradient[best] <= slack:
            break
        free[best] = True
        while free.any():
            chosen = np.flatnonzero(free)
            part = a[:, chosen]
            gram = part.T @ part
            gram[np.diag_indices(len(chosen))] *= 1 + 1e-12
            value = np.linalg.solve(gram, target[chosen])
            if (value > 0).all():
                x[:] = 0
                x[chosen] = value
                break
            low = value <= 0
            step = float(np.min(x[chosen][low] / np.maximum(x[chosen][low] - value[low], 1e-300)))
            x[chosen] += step * (value - x[chosen])
            gone = chosen[low & (x[chosen] <= 1e-12 * max(1.0, float(x.max())))]
            if not len(gone):
                gone = chosen[low][:1]
            x[gone] = 0
            free[gone] = False
    return x


class Plan:
    """Sequences as groups of equal ones; each use of a length is a slot.

    A slot says: the ``nth`` pieces from ``first`` up to ``stop`` of this length lie
    in sequences from ``sequence`` on, ``times`` in each, from ``offset`` on.
    """

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.left = histogram.astype(np.int64).copy()
        self.given = np.zeros(capacity + 1, np.int64)
        self.capacity = capacity
        self.sequences = 0
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}  # space left → (first sequence, how many)
        self.space = np.zeros(capacity + 1, bool)

    def put(self, length: int, sequence: int, count: int, times: int, offset: int) -> None:
        first, n = int(self.given[length]), count * times
        self.slots.append((length, first, first + n, sequence, times, offset))
        self.given[length] += n
        self.left[length] -= n

    def keep_open(self, space: int, sequence: int, count: int) -> None:
        if space > 0 and count > 0:
            self.open.setdefault(space, []).append((sequence, count))
            self.space[space] = True

    def repeat(self, cells: list[int], count: int, width: int) -> None:
        """Up to ``count`` sequences of one pattern, with real lengths."""
        while count > 0:
            chosen: list[int] = []
            room = self.capacity
            for i, cell in enumerate(cells):
                low, high = (cell - 1) * width + 1, min(cell * width, room)
                if i == len(cells) - 1:
                    low, high = max(1, (cell - 1) * width + 1), room
                spare = self.left[low : high + 1].copy()
                for c in chosen:
                    if low <= c <= high:
                        spare[c - low] -= 1
                found = np.flatnonzero(spare > 0)
                if not len(found):
                    return
                chosen.append(low + int(found[-1]))
                room -= chosen[-1]
            runs = {c: chosen.count(c) for c in chosen}
            n = min(count, *(int(self.left[c]) // k for c, k in runs.items()))
            if n == 0:
                return
            offset = 0
            for length, times in runs.items():
                self.put(length, self.sequences, n, times, offset)
                offset += length * times
            self.keep_open(room, self.sequences, n)
            self.sequences += n
            count -= n

    def best_fit(self) -> None:
        """What is left, longest first, each to the fullest sequence that still has room."""
        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                rooms = np.flatnonzero(self.space[length:])
                if not len(rooms):
                    times = self.capacity // length
                    count, times = (n // times, times) if n >= times else (1, n)
                    self.put(length, self.sequences, count, times, 0)
                    self.keep_open(self.capacity - times * length, self.sequences, count)
                    self.sequences += count
                    continue
                room = length + int(rooms[0])
                sequence, count = self.open[room].pop()
                times = room // length
                use, times = (min(count, n // times), times) if n >= times else (1, n)
                if use < count:
                    self.open[room].append((sequence + use, count - use))
                if not self.open[room]:
                    self.space[room] = False
                self.put(length, sequence, use, times, self.capacity - room)
                self.keep_open(room - times * length, sequence, use)


def plan(histogram: np.ndarray, capacity: int = CAPACITY, cells: int = CELLS, most: int = PATTERN_DOCS) -> Plan:
    """Slots for a histogram of lengths (index 0 unused, capacity last)."""
    made = Plan(histogram, capacity)
    if full := int(made.left[capacity]):
        made.put(capacity, 0, full, 1, 0)
        made.sequences = full
    cells = min(cells, capacity)
    width = -(-capacity // cells)
    cells = capacity // width
    lengths = np.flatnonzero(made.left)
    if len(lengths):
        grid = np.bincount(-(-lengths // width) - 1, made.left[lengths], cells + 1)[:cells]
        a = patterns(cells, most)
        a = a[:, ((a > 0) <= (grid > 0)[:, None]).all(axis=0)]
        weight = nnls(a, grid, FIT_SLACK)
        for column in np.argsort(-weight, kind="stable"):
            repeats = int(weight[column])
            if repeats == 0:
                break
            sizes = [s + 1 for s in range(cells - 1, -1, -1) for _ in range(int(a[s, column]))]
            made.repeat(sizes, repeats, width)
    made.best_fit()
    return made


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = materialize(pieces(docs, path, capacity, end), "pieces")
    counts = materialize(cut.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    # One row per length at most, whatever the input.
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = np.array(sorted(plan(histogram, capacity).slots), np.int64).reshape(-1, 6)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The stored counts are many times smaller than their rows, so Spark would broadcast too many.
    numbered = cut.join(bases.hint("merge"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("nth")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, nth = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "nth"))
            slot = slots[np.searchsorted(starts, length << 44 | nth, side="right") - 1]
            row = nth - slot[:, 1]
            sequence, offset = slot[:, 3] + row // slot[:, 4], slot[:, 5] + row % slot[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    return numbered.mapInArrow(
        place,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
