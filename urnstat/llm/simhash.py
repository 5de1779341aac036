"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint is cut into ``limit // 2 + 1`` segments. Two fingerprints that differ
in at most ``limit`` bits then differ in at most one bit of some segment, so they
agree on that segment with one of its bits left out. Every segment is indexed under
all its one-wildcard variants; equal keys are joined and the full distance is
verified inside the join. Exact copies are one fingerprint and are never expanded.

Null and empty texts have the fingerprint 0 and link like any other. Repeated rows
and repeated ids are separate rows with one fingerprint; a null id is never the
smallest of a component unless all ids there are null. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urnstat.llm.common import find_byte_words, slices, texts_of
from urnstat.llm.components import components
from urnstat.session import materialize

SHINGLE = 4
SEED = 42
BITS = 64
LIMIT = 4
#: Shingles of one text whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 majority bits over the shingle hashes, as a signed number."""
    words = find_byte_words(text.encode().lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *stops[:-1].tolist()]
    ends = (stops[size - 1 :] - 1).tolist() or [len(joined)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), CHUNK):
        pairs = zip(starts[at : at + CHUNK], ends[at : at + CHUNK])
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in pairs]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends)).view(">i8")[0])


def fingerprints(docs: DataFrame, text_column: str = "text", size: int = SHINGLE, code_column: str = "code") -> DataFrame:
    """All columns of ``docs`` and ``code_column``, the fingerprint of each row as bigint."""
    schema = T.StructType([*docs.schema.fields, T.StructField(code_column, T.LongType())])

    def run(batches):
        for batch in slices(batches):
            codes = pa.array([fingerprint(t, size) for t in texts_of(batch, text_column)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, code_column])

    return docs.mapInArrow(run, schema)


def segments(limit: int = LIMIT) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments that bound one's share of the differences by one bit."""
    n = limit // 2 + 1
    edges = [i * BITS // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits).cast("long")


def variants(code: Column, limit: int = LIMIT) -> Column:
    """Keys of a code: each segment whole, and with each of its bits left out.

    A key is the segment's bits above a tag: which bit is out, or ``BITS`` + the
    segment's number where none is.
    """
    keys = []
    for number, (low, width) in enumerate(segments(limit)):
        for tag in (BITS + number, *range(low, low + width)):
            kept = _mask(low, width) & ~(1 << tag)
            segment = F.shiftrightunsigned(code.bitwiseAND(_long(kept)), low)
            keys.append(F.shiftleft(segment, 7).bitwiseOR(F.lit(tag)))
    return F.array(*keys)


def links(codes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b``: all pairs of different codes at most ``limit`` bits apart, a < b, each once.

    A pair can agree on many keys; only one of them passes it on: of the first segment
    with at most one difference, the whole segment or the variant without that bit.
    """
    # Spark sizes the keys like the codes they are exploded from, some sixty times too low: never broadcast.
    keyed = codes.select("code", F.explode(variants(F.col("code"), limit)).alias("key")).hint("merge")
    one, two = keyed.alias("one"), keyed.alias("two")
    both = F.col("one.code").bitwiseXOR(F.col("two.code"))
    # From both sides, so that no filter of one side alone keeps them from sharing a shuffle.
    tag = F.greatest("one.key", "two.key").bitwiseAND(F.lit(127))
    exact = (tag >= BITS) | (F.getbit(both, tag % BITS) == 1)
    first, earlier = F.lit(False), F.lit(True)
    for number, (low, width) in enumerate(segments(limit)):
        own = (tag == BITS + number) | ((tag >= low) & (tag < low + width))
        first = first | (own & earlier)
        earlier = earlier & (F.bit_count(both.bitwiseAND(_long(_mask(low, width)))) > 1)
    near = (F.bit_count(both) <= limit) & exact & first
    pairs = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("one.code") < F.col("two.code")) & near)
    return pairs.select(F.col("one.code").alias("a"), F.col("two.code").alias("b"))


def classes(coded: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``code, component_id`` for the codes of ``doc_id, code`` rows: the smallest id of each component."""
    smallest = materialize(coded.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    found = components(links(smallest, limit))
    grouped = smallest.join(found, smallest["code"] == found["node"], "left").select(
        "code", "first", F.coalesce("component", "code").alias("class")
    )
    ids = grouped.groupBy("class").agg(F.min("first").alias("component_id"))
    return materialize(grouped.join(ids, "class").select("code", "first", "component_id", "class"), "classes")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``; the fingerprint as 16 hex digits."""
    coded = materialize(fingerprints(docs.select("doc_id", "text")).select("doc_id", "code"), "fingerprints")
    named = classes(coded).select("code", "component_id")
    return coded.join(named, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest id.

    Rows that share this id and the fingerprint leave the one with the smallest text,
    null first. In a component without ids the smallest fingerprint, then text, stays.
    """
    code = "code"
    while code in docs.columns:
        code += "_"
    coded = materialize(fingerprints(docs, code_column=code), "fingerprints")
    named = classes(coded.select("doc_id", F.col(code).alias("code")))
    best = named.groupBy("class").agg(F.min_by("code", F.struct(F.col("first").isNull(), "first", "code")).alias("best"))
    best = named.join(best, "class").where(F.col("code") == F.col("best")).select(
        F.col("code").alias("kept_code"), F.col("component_id").alias("kept_id")
    )
    same = coded["doc_id"].eqNullSafe(best["kept_id"]) & (coded[code] == best["kept_code"])
    left = coded.join(best, same, "left_semi")
    of_row = Window.partitionBy("doc_id", code).orderBy(F.col("text").asc_nulls_first())
    rank = "nth"
    while rank in docs.columns:
        rank += "_"
    return left.withColumn(rank, F.row_number().over(of_row)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
