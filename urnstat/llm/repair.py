"""Repair of the turn structure of conversations, by a dynamic program on a grammar.

Every row of a conversation becomes one symbol: the class of its role (s, u, a, other)
and its first fault (none, truncated, blank or repeated). The sequences of all
conversations are compressed together by Re-Pair, in batches: each round counts the
adjacent pairs of all different sequences in Spark and makes rules of the most frequent
ones, which replace them one after another.

Each rule has one min-plus matrix over the states of ``(s?(ua)+)?``: for every pair of
states the least cost of edits, and an audit rope of their initials, kept as the two
halves and the state between them. Rules are evaluated bottom-up, once for all
conversations; a sequence multiplies a row vector by the matrices of what is left of it.

Among edits of equal cost the audit that is least in ASCII wins. Every symbol's audit ends
with the edit of its row and insertions stand before it, so of two audits for the same
rows none begins the other, and both are equal only if they end in the same state. Which
is less is therefore settled by the first halves, or by the second if the first are the
same: ranks inside a matrix row do, and no rope is read to compare it.

A null role or text reads as one space. A null turn comes first, equal turns follow role
and hash of the text. A conversation without rows keeps its id, with zeros and an empty
audit; a null ``conv_id`` is a conversation of its own. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnstat.llm.turns import batched, decimal, plain, streamed
from urnstat.session import materialize

SPACES = " \t\n\x0b\f\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3

# States: nothing yet, after s, after u, after a. What may follow, and the one that can be put in.
STATES = range(4)
ROLES = "sua"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PUT = {0: "u", 1: "u", 2: "a", 3: "u"}
#: Insertions that end a conversation well from each state.
TAIL = {0: 0, 1: 2, 2: 1, 3: 0}
FULL = {"u": "user", "a": "assistant"}

#: First character of the symbols: class of role times three, plus the kind of fault.
FIRST = 0x4E00
FINE, CUT, GONE = 0, 1, 2
#: Rules made in a round at most, and rounds; what is left is multiplied as it is.
ROUND_RULES = 64
ROUNDS = 8
#: A pair seen less often in all sequences makes no rule.
LEAST_PAIRS = 2


def symbol(role_class: int, fault: int) -> str:
    return chr(FIRST + 3 * role_class + fault)


# ---- matrices --------------------------------------------------------------


class Matrix:
    """``cost[p][q]`` (None: impossible), ``rank[p][q]``: order of the audits of row p."""

    def __init__(self, cost, rank, audit=None, halves=None, via=None):
        self.cost, self.rank, self.audit, self.halves, self.via = cost, rank, audit, halves, via

    def rope(self, p: int, q: int) -> str:
        """The audit of p to q; ropes of rules are unrolled without recursion."""
        out, todo = [], [(self, p, q)]
        while todo:
            m, a, b = todo.pop()
            if m.audit:
                out.append(m.audit[a][b])
            else:
                left, right = m.halves
                todo += [(right, m.via[a][b], b), (left, a, m.via[a][b])]
        return "".join(out)


def base_matrix(role_class: int, fault: int) -> Matrix:
    """Insertions, then the edit of one row."""
    cost = [[None] * 4 for _ in STATES]
    audit = [[None] * 4 for _ in STATES]

    def offer(p, q, price, text):
        if cost[p][q] is None or (price, text) < (cost[p][q], audit[p][q]):
            cost[p][q], audit[p][q] = price, text

    late = TRUNCATED_COST if fault == CUT else 0
    for p in STATES:
        at, price, text = p, 0, ""
        for _ in range(3):
            offer(p, at, price + COST[DELETE], text + DELETE)
            if fault != GONE:
                if role_class < 3 and (at, ROLES[role_class]) in NEXT:
                    offer(p, NEXT[at, ROLES[role_class]], price + COST[KEEP] + late, text + KEEP)
                for to in FULL:
                    if (at, to) in NEXT:
                        offer(p, NEXT[at, to], price + COST[REROLE] + late, text + REROLE)
            at, price, text = NEXT[at, PUT[at]], price + COST[INSERT], text + INSERT
    rank = []
    for p in STATES:
        order = sorted((t, q) for q, t in enumerate(audit[p]) if t is not None)
        places = {q: i for i, (_, q) in enumerate(order)}
        rank.append([places.get(q) for q in STATES])
    return Matrix(cost, rank, audit=audit)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; ties go to the audit whose first half ranks lower."""
    cost, rank, via = [], [], []
    for p in STATES:
        row = [_best(a.cost[p], a.rank[p], b, q) for q in STATES]
        cost.append([c for c, _ in row])
        via.append([m for _, m in row])
        rank.append(_ranks(a.rank[p], [m for _, m in row], b))
    return Matrix(cost, rank, halves=(a, b), via=via)


def _best(costs, ranks, b: Matrix, q: int):
    found = [(costs[m] + b.cost[m][q], ranks[m], m) for m in STATES if costs[m] is not None and b.cost[m][q] is not None]
    price, _, m = min(found, default=(None, None, None))
    return price, m


def _ranks(first, via, b: Matrix):
    order = sorted((first[m], b.rank[m][q], q) for q, m in enumerate(via) if m is not None)
    places = {q: i for i, (_, _, q) in enumerate(order)}
    return [places.get(q) for q in STATES]


def matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """One matrix per symbol; a rule's symbol follows those of the rules before it."""
    out = {symbol(r, f): base_matrix(r, f) for r in range(4) for f in (FINE, CUT, GONE)}
    for new, pair in rules:
        out[new] = product(out[pair[0]], out[pair[1]])
    return out


def cheapest(sequence: str, known: dict[str, Matrix]) -> tuple[int, str]:
    """Least cost and audit of a compressed sequence."""
    costs, ranks, steps = [0, None, None, None], [0, None, None, None], []
    for s in sequence:
        row = [_best(costs, ranks, known[s], q) for q in STATES]
        via = [m for _, m in row]
        ranks = _ranks(ranks, via, known[s])
        costs = [c for c, _ in row]
        steps.append(via)
    price, _, q = min((costs[q] + TAIL[q] * COST[INSERT], ranks[q], q) for q in STATES if costs[q] is not None)
    out = [INSERT * TAIL[q]]
    for s, via in zip(reversed(sequence), reversed(steps)):
        out.append(known[s].rope(via[q], q))
        q = via[q]
    return price, "".join(reversed(out))


# ---- grammar ---------------------------------------------------------------


def _pairs(batches):
    """Adjacent pairs of the sequences of a task with their counts."""
    counts: dict[str, int] = {}
    for (seq,) in streamed(batches, ["seq"]):
        for i in range(len(seq) - 1):
            pair = seq[i : i + 2]
            counts[pair] = counts.get(pair, 0) + 1
    yield from batched(iter(counts.items()), pa.schema([("pair", pa.string()), ("n", pa.int64())]))


def grammar(sequences: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``kid, seq`` compressed, and the rules (symbol, pair) in the order in which they apply.

    A task holds one count for each different pair, of which there are at most as many as
    the square of the symbols; the driver gets the ``ROUND_RULES`` most frequent.
    """
    rules: list[tuple[str, str]] = []
    free = FIRST + 12
    for _ in range(ROUNDS):
        found = sequences.select("seq").mapInArrow(_pairs, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        top = found.where(F.col("n") >= LEAST_PAIRS).orderBy(F.desc("n"), "pair").limit(ROUND_RULES).collect()
        if not top:
            break
        seq = F.col("seq")
        for row in top:
            rules.append((chr(free), row["pair"]))
            seq = F.replace(seq, F.lit(row["pair"]), F.lit(chr(free)))
            free += 1
        sequences = materialize(sequences.withColumn("seq", seq), "sequences")
    return sequences, rules


def audits(sequences: DataFrame) -> DataFrame:
    """``kid, cost, audit`` of different sequences ``kid, seq``."""
    compressed, rules = grammar(sequences)

    def run(batches):
        known = _known(tuple(rules))
        rows = ((kid, *cheapest(seq, known)) for kid, seq in streamed(batches, ["kid", "seq"]))
        return batched(rows, pa.schema([("kid", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))

    return compressed.mapInArrow(run, "kid string, cost bigint, audit string")


@lru_cache(2)
def _known(rules: tuple[tuple[str, str], ...]) -> dict[str, Matrix]:
    return matrices(list(rules))


# ---- conversations ---------------------------------------------------------


def damage(convs: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of id and turn: ``conv_id, turn, role, text, alive``."""
    rows = plain(convs, " ")
    kind = F.crc32(F.concat(decimal("conv_id", " "), F.lit(":"), decimal("turn", " "))) % 20
    rows = rows.withColumn("_kind", kind)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("alive"), F.explode(F.array_repeat(F.lit(0), times))
    ).drop("col")


def _hash() -> Column:
    return F.concat(F.hex(F.xxhash64(F.lit(1), "text")), F.hex(F.xxhash64(F.lit(2), "text"))).alias("hash")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, least cost of a repair and its audit.

    ``rows`` has ``conv_id, turn, role, text, alive``; a row that is not alive only says
    that there is such a conversation. Equal sequences are repaired once.
    """
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", _hash(), last.alias("_last"), "alive")
    seen = Window.partitionBy("conv_id", "role", "hash", "alive").orderBy("turn")
    slim = slim.withColumn("_nth", F.row_number().over(seen)).withColumn("_blank", F.col("_last") == "")
    slim = slim.withColumn("_repeated", ~F.col("_blank") & (F.col("_nth") > 1))
    slim = slim.withColumn("_cut", ~F.col("_blank") & ~F.col("_repeated") & ~F.col("_last").isin(*STOPS))
    initial = F.left("role", F.lit(1))
    slim = slim.withColumn("_class", F.when(initial.isin(*ROLES), initial).otherwise("x"))
    fault = F.when(F.col("_blank") | F.col("_repeated"), GONE).when(F.col("_cut"), CUT).otherwise(FINE)
    signs = F.lit("".join(symbol(r, f) for r in range(4) for f in (FINE, CUT, GONE)))
    sign = F.substring(signs, 3 * F.position(F.col("_class"), F.lit(ROLES + "x")) - 2 + fault, F.lit(1))
    item = F.when(F.col("alive"), F.struct("turn", "role", "hash", sign.alias("sign"), "_class"))
    turn = F.when(F.col("alive"), F.col("turn"))
    found = slim.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        (F.max(turn) - F.min(turn) + 1).alias("_span"),
        *[F.count_if(F.col("alive") & F.col(c)).alias(n) for c, n in (("_blank", "blank"), ("_repeated", "duplicate"), ("_cut", "truncated"))],
    )
    classes = F.col("items._class")
    pairs = F.zip_with(classes, F.slice(classes, F.lit(2), F.size(classes)), lambda a, b: F.concat(a, b))
    turns = F.size(F.array_distinct(F.filter("items.turn", lambda t: t.isNotNull())))
    seq = F.array_join("items.sign", "")
    found = found.select(
        "conv_id",
        (F.coalesce("_span", F.lit(0)) - turns).cast("bigint").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("bigint").alias("illegal"),
        seq.alias("seq"),
        F.sha2(seq, 256).alias("kid"),
    )
    found = materialize(found, "faults")
    edits = materialize(audits(found.where("seq <> ''").select("kid", "seq").distinct()), "audits")
    joined = found.drop("seq").join(edits, "kid", "left")
    return joined.select("conv_id", *COUNTS, F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))


# ---- repaired conversations ------------------------------------------------

HEAD = ["conv_id", *COUNTS, "cost", "audit"]


def _repaired(batches) -> Iterator[tuple]:
    """(report row, role, text) of every repaired turn, and (report row, None, None) after the last.

    Each conversation comes as its report row and then its rows in order; nothing is held.
    """
    head, state, at = None, 0, 0
    for kind, role, text, *values in streamed(batches, ["kind", "role", "text", *HEAD]):
        if kind == 0:
            if head:
                yield from _inserted(head, state, at)
                yield head, None, None
            head, state, at = tuple(values), 0, 0
            continue
        audit = head[-1]
        while audit[at] == INSERT:
            yield head, FULL[PUT[state]], ""
            state, at = NEXT[state, PUT[state]], at + 1
        if audit[at] == KEEP:
            state = NEXT[state, role[0]]
            yield head, role, text
        elif audit[at] == REROLE:
            yield head, FULL[PUT[state]], text
            state = NEXT[state, PUT[state]]
        at += 1
    if head:
        yield from _inserted(head, state, at)
        yield head, None, None


def _inserted(head, state, at):
    for _ in head[-1][at:]:
        yield head, FULL[PUT[state]], ""
        state = NEXT[state, PUT[state]]


def _in_order(rows: DataFrame, reports: DataFrame) -> DataFrame:
    texts = rows.where("alive").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", _hash())
    both = texts.unionByName(reports.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "hash")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, turn, role, text`` with turns from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        def turns():
            nth = 0
            for head, role, text in _repaired(batches):
                if role is None:
                    nth = 0
                    continue
                yield head[0], nth, role, text
                nth += 1

        return batched(turns(), schema)

    return _in_order(rows, report(rows)).mapInArrow(run, "conv_id bigint, turn bigint, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """The report of every conversation with ``repaired_sha256``, over its repaired ``role:text`` lines."""
    schema = pa.schema(
        [("conv_id", pa.int64()), *((c, pa.int64()) for c in [*COUNTS, "cost"]), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def run(batches):
        def found():
            state, first = hashlib.sha256(), True
            for head, role, text in _repaired(batches):
                if role is None:
                    yield *head, state.hexdigest()
                    state, first = hashlib.sha256(), True
                else:
                    state.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False

        return batched(found(), schema)

    kinds = ", ".join(f"{c} bigint" for c in ["conv_id", *COUNTS, "cost"])
    return _in_order(rows, report(rows)).mapInArrow(run, f"{kinds}, audit string, repaired_sha256 string")


def damaged_digests(convs: DataFrame) -> DataFrame:
    return digests(damage(convs))
