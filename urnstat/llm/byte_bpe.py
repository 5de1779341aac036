"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap for the rest.

``encode`` gives, per row, the ids that the rank file defines for each match of
the split pattern. Tier one looks a pre-token up in the vocabulary with a minimal
perfect hash (hash and displace). Tier two joins linked bytes by a heap of
neighbouring pairs, lowest rank first, leftmost first among equals, so a
pre-token of n bytes takes O(n log n) however long it is.

Null and empty texts have no ids. Repeated rows are encoded again. Only the two
named columns are read; other columns never clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from urnstat.llm.common import slices, texts_of

#: Pre-tokens that one Python worker remembers; it starts anew when full.
MEMO_ROWS = 400_000
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64
#: Mean number of keys that share one displacement.
KEYS_PER_BUCKET = 4
#: Odd multipliers that spread a key's digest under each displacement.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Displacements tried at once while building.
TRIES = np.arange(64, dtype=np.uint64)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order, from lines of base64 text and rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} have gaps")
    return [ranks[r] for r in range(len(ranks))]


class PerfectHash:
    """Key → place in 0 … n-1, one to one for the keys it was built from.

    Any other key also gets some place, so the caller compares the key stored there.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // KEYS_PER_BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket, code = self._parts(keys)
        taken = np.zeros(self.size, bool)
        by_bucket = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(-counts, kind="stable")
        for b in order[: np.count_nonzero(counts > 1)].tolist():
            rows = by_bucket[first[b] : first[b + 1]]
            for base in range(1, 1 << 24, len(TRIES)):
                places = self._place(code[rows][None, :], (TRIES + np.uint64(base))[:, None])
                fits = ~taken[places].any(axis=1)
                for i in np.flatnonzero(fits).tolist():
                    if len(set(places[i].tolist())) == len(rows):
                        break
                else:
                    continue
                break
            else:
                raise ValueError("repeated keys")
            taken[places[i]] = True
            self.shift[b] = base + i
        # A bucket with one key names a place that is still free, as a negative number.
        single = np.flatnonzero(counts == 1)
        self.shift[single] = -1 - np.flatnonzero(~taken)[: len(single)]

    def _parts(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), np.uint64).reshape(-1, 2)
        return (digests[:, 0] % np.uint64(self.buckets)).astype(np.int64), digests[:, 1]

    def _place(self, code: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (code ^ (shift * MIX[0])) * MIX[1]
        return ((mixed >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64)

    def places(self, keys: list[bytes]) -> np.ndarray:
        bucket, code = self._parts(keys)
        shift = self.shift[bucket]
        return np.where(shift < 0, -1 - shift, self._place(code, shift.astype(np.uint64)))


class Vocabulary:
    """A rank file ready for lookups; one per Python worker."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.hash = PerfectHash(tokens)
        self.at_place = np.empty(len(tokens), np.int64)
        self.at_place[self.hash.places(tokens)] = np.arange(len(tokens))

    def whole(self, words: list[bytes]) -> list[int | None]:
        """Tier one: the rank of each word that is itself a token."""
        if not words:
            return []
        ranks = self.at_place[self.hash.places(words)].tolist()
        return [r if self.tokens[r] == w else None for r, w in zip(ranks, words)]

    def merge(self, word: bytes) -> list[int]:
        """Tier two: join neighbours by a heap until no pair of them is a token."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is joined to its left
        before = list(range(-1, n - 1))
        heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := word[i : i + 2]) in ranks]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has changed meanwhile
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(word[i : end[stop]])) is not None:
                    heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(word[left:stop])) is not None:
                heappush(heap, (rank, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        return [[r] if r is not None else self.merge(w) for r, w in zip(self.whole(raw), raw)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class Encoder:
    """Encodes texts and remembers what it made of frequent pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}  # ids as 32-bit numbers

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        known = self.memo
        new = list({w for w in words if w not in known})
        long = {}
        if new:
            if len(known) + len(new) > MEMO_ROWS:
                known.clear()
                new = list(set(words))
            for w, ids in zip(new, self.vocabulary.encode_words(new)):
                (known if len(w) <= MEMO_CHARS else long)[w] = np.array(ids, np.int32).tobytes()
        if long:
            parts = [long[w] if len(w) > MEMO_CHARS else known[w] for w in words]
        else:
            parts = map(known.__getitem__, words)
        return np.frombuffer(b"".join(parts), np.int32)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, ids array<int>`` of every whole text."""
    source = docs.select(id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        encoder = Encoder(path, pattern)
        for batch in slices(batches):
            ids = [encoder.encode(t) for t in texts_of(batch, text_column)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    return source.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column, data binary``: the bytes behind ``ids``; null ids are none."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        words = vocabulary(path)
        for batch in slices(batches):
            data = [words.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_column, "data"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: a round trip in one pass.

    Encodes and decodes in the same task, so ids need not travel.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(path, pattern)
        digits = [str(r) for r in range(len(encoder.vocabulary.tokens))]
        for batch in slices(batches):
            counts, coded, back = [], [], []
            for text in texts_of(batch, "text"):
                ids = encoder.encode(text).tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(encoder.vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
