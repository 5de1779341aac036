"""Chat formatting into a prefix tree whose shared turns are written once.

Every turn becomes a control string, its escaped text and a closing control string.
The tokens are the UTF-8 bytes of that. Conversations that begin with the same turns
share them: the forest of all distinct beginnings is walked depth first, in the order
of the turns' hashes, and written as one stream of tokens. A conversation adds one
*run* to it, the turns that no conversation before it in the walk has. A run carries

* ``start``, its place in the stream, and ``position``, the position id of its first
  token (the tokens on the path above it; ids then go up by one);
* ``attends``, the intervals of the stream that its tokens see besides their own run up
  to themselves: one for each run on the path above, never more than it has turns;
* ``loss``, the intervals of the texts of assistants, without their control strings.

A place in the walk needs the sequence before it. Sequences of turn hashes, not texts,
are range-partitioned; two sequences for each partition go to the driver, which hands
every partition the path that is open where it begins. Texts are shuffled once, by
conversation, and written as runs; a run of over ``PIECE`` bytes is several rows.

Reading back needs no shuffle for a run that no other touches; for the others the runs
of the path are joined by their starts.

Null texts and roles are empty, a null turn comes first, equal turns follow the digest of
role and text. A null ``conv_id`` is a conversation of its own. Repeated rows are turns
like others. An empty table has no runs; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urnstat.llm.turns import batched, plain, streamed
from urnstat.session import materialize

#: Control strings around the texts of known roles, and around the name of any other.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
NAMED, NAMED_END, TEXT_END = "[ROLE]", "[/ROLE]", "</s>"
LEARNT = "assistant"
#: A control string, with any number of backslashes after its first character: one more
#: of them hides it, one less gives it back. Its first character occurs in it only once.
CONTROL = r"([<\[])(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)"
HIDDEN = re.compile(r"([<\[])\\(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)")
#: Characters of a turn's hash in a sequence key.
HASH = 32
#: Bytes of a run from which it is written as several rows.
PIECE = 1 << 20

SPANS = "array<struct<start:bigint,end:bigint>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


# ---- template --------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return HIDDEN.sub(r"\1\2\3", text) if "\\" in text else text


def render(role: Column, text: Column) -> Column:
    """One formatted turn."""
    body = escape(text)
    out = F.concat(F.lit(NAMED), escape(role), F.lit(NAMED_END), body, F.lit(TEXT_END))
    for name, (first, last) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(first), body, F.lit(last))).otherwise(out)
    return out


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted text."""
    at = 0
    while at < len(formatted):
        for role, (first, last) in MARKS.items():
            if formatted.startswith(first, at):
                at += len(first)
                break
        else:
            stop = formatted.index(NAMED_END, at)
            role, last = unescape(formatted[at + len(NAMED) : stop]), TEXT_END
            at = stop + len(NAMED_END)
        stop = formatted.index(last, at)
        yield role, unescape(formatted[at:stop])
        at = stop + len(last)


def _turns(convs: DataFrame) -> DataFrame:
    rows = plain(convs).withColumn("formatted", render(F.col("role"), F.col("text")))
    return rows.select("conv_id", "turn", "role", "formatted", F.substring(F.sha2("formatted", 256), 1, HASH).alias("hash"))


# ---- walk ------------------------------------------------------------------


def _sums(sizes: list[int]) -> list[int]:
    out = [0]
    for size in sizes:
        out.append(out[-1] + size)
    return out


class Walk:
    """A depth-first walk: the sequence it is at and the runs on its path.

    A run is (turns above it, its start). ``end`` is the length of the stream so far.
    """

    def __init__(self, key: str = "", runs=(), end: int = 0):
        self.key, self.runs, self.end = key, [tuple(r) for r in runs], end

    def step(self, key: str, sizes: list[int]) -> tuple[int, int, int, int, list]:
        """Shared turns, start, position, size of the run that ``key`` adds, and what it attends."""
        shared = len(os.path.commonprefix([self.key, key])) // HASH
        sums = _sums(sizes)
        above = [r for r in self.runs if r[0] < shared]
        stops = [r[0] for r in above[1:]] + [shared]
        before = [(start, start + sums[stop] - sums[first]) for (first, start), stop in zip(above, stops)]
        start, size = self.end, sums[-1] - sums[shared]
        self.key, self.runs, self.end = key, [*above, (shared, start)], start + size
        return shared, start, sums[shared], size, before

    def after(self, part) -> Walk:
        """Where the walk is after a partition that was walked on its own."""
        shared = len(os.path.commonprefix([self.key, part["first"]])) // HASH
        shift = self.end - _sums(part["sizes"])[shared]
        runs = [(r["turns"], r["start"]) for r in part["runs"]]
        out = []
        if runs[0] == (0, 0):  # the first run of the partition: what it shares is in earlier ones
            stop = runs[1][0] if len(runs) > 1 else len(part["last"]) // HASH
            out = [r for r in self.runs if r[0] < min(shared, stop)] + [(shared, self.end)] * (stop > shared)
            runs = runs[1:]
        return Walk(part["last"], [*out, *((t, s + shift) for t, s in runs)], part["end"] + shift)


RUNS = "array<struct<turns:int,start:bigint>>"
RUN = pa.list_(pa.struct([("turns", pa.int32()), ("start", pa.int64())]))
SUMMARY = pa.schema(
    [("part", pa.int32()), ("first", pa.string()), ("sizes", pa.list_(pa.int64())), ("last", pa.string()), ("runs", RUN), ("end", pa.int64())]
)


def _summaries(batches):
    """Each partition walked on its own: its first sequence, and the path open at its end."""

    def rows():
        now, walk, first, sizes_of_first = None, None, None, None
        for part, key, sizes in streamed(batches, ["part", "key", "sizes"]):
            if part != now:
                if walk:
                    yield now, first, sizes_of_first, walk.key, walk.runs, walk.end
                now, walk, first, sizes_of_first = part, Walk(), key, sizes
            walk.step(key, sizes)
        if walk:
            yield now, first, sizes_of_first, walk.key, walk.runs, walk.end

    return batched(((p, f, s, k, [{"turns": t, "start": a} for t, a in r], e) for p, f, s, k, r, e in rows()), SUMMARY)


PLACE = pa.schema(
    [("rep", pa.int64()), ("kid", pa.string()), ("shared", pa.int32()), ("run", pa.int64()), ("position", pa.int64()), ("size", pa.int64()), ("before", SPAN)]
)


def _walked(batches):
    """Places of all sequences; a partition begins with a row that holds the open path."""

    def rows():
        walk = Walk()
        for kind, rep, kid, key, sizes, runs, end in streamed(batches, ["kind", "rep", "kid", "key", "sizes", "runs", "end"]):
            if kind == 0:
                walk = Walk(key, [(r["turns"], r["start"]) for r in runs], end)
                continue
            shared, start, position, size, before = walk.step(key, sizes)
            yield rep, kid, shared, start, position, size, [{"start": a, "end": b} for a, b in before]

    return batched(rows(), PLACE)


def _places(sequences: DataFrame) -> DataFrame:
    """One row per distinct sequence: its run's place in the stream, and ``branches``: whether others hang on it."""
    spark = sequences.sparkSession
    alike = sequences.groupBy("kid", "key", "sizes").agg(F.min("conv_id").alias("rep"))
    ordered = alike.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "ordered")
    own = ordered.repartition("part").sortWithinPartitions("part", "key")
    ends = own.mapInArrow(_summaries, f"part int, first string, sizes array<bigint>, last string, runs {RUNS}, end bigint")
    walk, opened = Walk(), []
    for part in materialize(ends, "ends").orderBy("part").toLocalIterator():
        shared = len(os.path.commonprefix([walk.key, part["first"]])) // HASH
        opened.append((part["part"], walk.key[: shared * HASH], [r for r in walk.runs if r[0] < shared], walk.end))
        walk = walk.after(part)
    heads = spark.createDataFrame(opened, f"part int, key string, runs {RUNS}, end bigint").withColumn("kind", F.lit(0))
    rows = ordered.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    rows = rows.repartition("part").sortWithinPartitions("part", "kind", "key")
    placed = rows.mapInArrow(_walked, f"rep bigint, kid string, shared int, run bigint, position bigint, size bigint, before {SPANS}")
    placed = materialize(placed, "places")
    hung = placed.select(F.explode("before.start").alias("run")).distinct().withColumn("branches", F.lit(True))
    return placed.join(hung, "run", "left").withColumn("branches", F.coalesce("branches", F.lit(False)))


# ---- stream ----------------------------------------------------------------

PIECES = pa.schema(
    [
        ("run", pa.int64()),
        ("start", pa.int64()),
        ("position", pa.int64()),
        ("tokens", pa.binary()),
        ("loss", SPAN),
        ("attends", SPAN),
        ("branches", pa.bool_()),
        ("whole", pa.bool_()),
    ]
)


def _written(batches, piece_bytes: int):
    """Rows of runs from turns; a conversation that adds one begins with a row of its place."""

    def rows():
        fields = ["conv_id", "kind", "role", "formatted", "shared", "run", "position", "size", "before", "branches"]
        now, place, nth, piece = (), None, 0, None
        for conv, kind, role, formatted, shared, run, position, size, before, branches in streamed(batches, fields):
            if (conv,) != now:
                if piece:
                    yield piece.row(place)
                now, place, nth, piece = (conv,), None, 0, None
            if kind == 0:
                place = (shared, run, before, branches, size <= piece_bytes)
                piece = _Piece(run, position)
            elif place:
                nth += 1
                if nth <= place[0]:
                    continue
                if not place[4] and piece.size >= piece_bytes:
                    yield piece.row(place)
                    piece = _Piece(piece.start + piece.size, piece.position + piece.size)
                piece.add(role, formatted.encode())
        if piece:
            yield piece.row(place)

    return batched(rows(), PIECES, 64)


class _Piece:
    def __init__(self, start: int, position: int):
        self.start, self.position, self.size, self.turns, self.loss = start, position, 0, [], []

    def add(self, role: str, tokens: bytes) -> None:
        if role == LEARNT:
            first, last = MARKS[role]
            at = self.start + self.size
            self.loss.append({"start": at + len(first), "end": at + len(tokens) - len(last)})
        self.turns.append(tokens)
        self.size += len(tokens)

    def row(self, place) -> tuple:
        _, run, before, branches, whole = place
        earlier = [{"start": run, "end": self.start}] if self.start > run else []
        return run, self.start, self.position, b"".join(self.turns), self.loss, [*before, *earlier], branches, whole


@dataclass
class ChatTree:
    """``runs``: the stream of tokens; ``members``: for each conversation its last run and what that attends.

    A member's tokens are the intervals ``before`` and then ``run`` to ``end``; a
    conversation that ends where others go on has a run of its own all the same.
    """

    runs: DataFrame
    places: DataFrame
    sequences: DataFrame
    piece_bytes: int

    @property
    def members(self) -> DataFrame:
        own = self.places.select("kid", "run", F.expr("run + size").alias("end"), "before")
        return self.sequences.select("conv_id", "kid").join(own, "kid").drop("kid")


def format_tree(convs: DataFrame, piece_bytes: int = PIECE) -> ChatTree:
    """All conversations as one stream of tokens that holds shared turns once."""
    turns = _turns(convs)
    item = F.struct("turn", "hash", F.octet_length("formatted").cast("bigint").alias("size"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    key = F.array_join("turns.hash", "")
    sequences = listed.select("conv_id", F.sha2(key, 256).alias("kid"), key.alias("key"), F.col("turns.size").alias("sizes"))
    sequences = materialize(sequences, "sequences")
    places = materialize(_places(sequences), "places")
    heads = places.select(F.col("rep").alias("conv_id"), F.lit(0).alias("kind"), "shared", "run", "position", "size", "before", "branches")
    rows = turns.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "hash")
    runs = rows.mapInArrow(
        partial(_written, piece_bytes=piece_bytes),
        f"run bigint, start bigint, position bigint, tokens binary, loss {SPANS}, attends {SPANS}, branches boolean, whole boolean",
    )
    return ChatTree(materialize(runs, "runs"), places, sequences, piece_bytes)


# ---- reading back ----------------------------------------------------------

DIGEST = pa.schema(
    [
        ("run", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _digests(batches):
    """One row for each path, whose pieces follow one another."""

    def rows():
        now = turns = learnt = None
        for path, start, tokens, loss in streamed(batches, ["path", "start", "tokens", "loss"]):
            if path != now:
                if turns:
                    yield now, n, turns.hexdigest(), n_loss, learnt.hexdigest(), n_chars
                now, n, n_loss, n_chars, turns, learnt = path, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            formatted = tokens.decode()
            n_chars += len(formatted)
            for role, text in parse(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in loss:
                if span["end"] <= start + len(tokens):
                    text = unescape(tokens[span["start"] - start : span["end"] - start].decode())
                    n_loss += len(text)
                    learnt.update(text.encode())
        if turns:
            yield now, n, turns.hexdigest(), n_loss, learnt.hexdigest(), n_chars

    return batched(rows(), DIGEST)


def read_back(tree: ChatTree) -> DataFrame:
    """What the stream says of each conversation: digests of its turns and of the text under its loss mask."""
    schema = "run bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    alone = F.col("whole") & (F.size("attends") == 0)
    simple = tree.runs.where(alone).select(F.col("run").alias("path"), "start", "tokens", "loss")
    own = F.array(F.struct(F.col("run").alias("start"), F.expr("run + size").alias("end")))
    paths = tree.places.where((F.size("before") > 0) | (F.col("size") > tree.piece_bytes))
    paths = paths.select(F.col("run").alias("path"), F.inline(F.concat("before", own)).alias("run", "stop"))
    shared = tree.runs.where(~alone | F.col("branches")).select("run", "start", "position", "tokens", "loss")
    pieces = paths.join(shared, "run").where(F.col("start") < F.col("stop"))
    cut = F.substring("tokens", F.lit(1), F.least(F.octet_length("tokens").cast("bigint"), F.expr("stop - start")).cast("int"))
    pieces = pieces.select("path", "start", cut.alias("tokens"), "loss", "position")
    pieces = pieces.repartition("path").sortWithinPartitions("path", "position").drop("position")
    found = simple.mapInArrow(_digests, schema).unionByName(pieces.mapInArrow(_digests, schema))
    last = tree.places.select("kid", "run").join(found, "run")
    return tree.sequences.select("conv_id", "kid").join(last, "kid").drop("kid", "run")


def digest(convs: DataFrame) -> DataFrame:
    """``conv_id`` and the digests of ``read_back``, also for a conversation -1 made of control strings."""
    said = "</s>[INST] ok [/INST]"
    odd = convs.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_tree(plain(convs).unionByName(odd)))


def oracle_sql() -> str:
    """The same digests from the rows; the template is written out."""
    body = r"regexp_replace({}, '([<\[])(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)', '\1\\\2\3', 'g')"
    cases = " ".join(f"WHEN '{r}' THEN '{a}' || {body.format('text')} || '{b}'" for r, (a, b) in MARKS.items())
    other = f"'{NAMED}' || {body.format('role')} || '{NAMED_END}' || {body.format('text')} || '{TEXT_END}'"
    learnt = f"coalesce(string_agg(CASE WHEN role = '{LEARNT}' THEN text END, '' ORDER BY turn NULLS FIRST), '')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE role {cases} ELSE {other} END AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  CAST(length({learnt}) AS BIGINT) AS loss_chars, sha256({learnt}) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
