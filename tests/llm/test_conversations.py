"""Operators on conversations against brute force, on tables with every odd case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tests.llm import slow_repair
from urnstat.llm import chat_tree, prefix_trie, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, run bigint, kid string, seq string"
SAID = "</s>[INST] ok [/INST]"


def make_rows(seed=3, n=260):
    """Conversations with shared beginnings, copies, nulls, repeated rows and long texts."""
    rng = random.Random(seed)
    words = ["Yes.", "No", "why?", "[INST]", "[\\/INST]", "<s>\\", "straße 漢字 🙂!", "", " \n", "[ROLE]x", "</s>", "ok."]
    rows = []
    for conv in range(n):
        base = rng.random() < 0.4  # a third and more begin with the same turns
        turns = 1 + rng.randrange(7) if conv != 7 else 70
        for turn in range(turns):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.85 else rng.choice(["system", "tool", None, "", "[/ROLE]"])
            text = rng.choice(words) + " " + rng.choice(words)
            if base and turn < 2:
                role, text = ["user", "assistant"][turn], f"Same turn {turn}."
            rows.append((conv, turn, role, None if rng.random() < 0.03 else text))
    rows += [(1000 + i, t, r, x) for i in range(40) for t, r, x in [(0, "user", "Copy?"), (1, "assistant", "Copy. " * 50)]]
    rows += [(2000, None, "user", "first"), (2000, 5, "assistant", "later."), (2000, 9, None, None)]
    rows += [(None, 0, "user", "without id"), (None, 1, "assistant", "yes.")]
    rows += [(2100, 0, "user", "long " * 40_000 + "."), (2100, 1, "assistant", "short")]
    rows += [(2101, 0, "", ""), (2102, 0, "user", "Same turn 0."), (2103, 3, "user", "twice"), (2103, 3, "user", "twice")]
    return rows


ROWS = make_rows()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "s") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def convs(spark):
    return frame(spark, ROWS).cache()


def ordered(rows, blank=""):
    """conv_id → (role, text) of its rows by turn, nulls first and as empty texts."""
    out = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out[conv].append((blank if role is None else role, blank if text is None else text))
    return out


# Chat tree.


def slow_escape(text):
    return re.sub(r"([<\[])(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)", r"\1\\\2\3", text)


def slow_turn(role, text):
    text = slow_escape(text)
    marks = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
    first, last = marks.get(role, (f"[ROLE]{slow_escape(role)}[/ROLE]", "</s>"))
    return first + text + last


def slow_digests(rows):
    rows = [*rows, (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]
    out = []
    for conv, turns in ordered(rows).items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learnt)]
        out.append((conv, len(turns), digest[0], len(learnt), digest[1], sum(len(slow_turn(*t)) for t in turns)))
    return sorted(out, key=repr)


def test_control_strings_come_back():
    rng = random.Random(1)
    parts = ["[", "<", "\\", "/", "INST]", "s>", "[INST]", "</s>", "[ROLE]", "[/SYS]", "a", "]", "漢"]
    for _ in range(3000):
        turns = [
            (rng.choice(["user", "assistant", "system", "".join(rng.choices(parts, k=3))]), "".join(rng.choices(parts, k=rng.randrange(9))))
            for _ in range(rng.randrange(4))
        ]
        formatted = "".join(slow_turn(*t) for t in turns)
        assert list(chat_tree.parse(formatted)) == turns
        for _, text in turns:
            assert chat_tree.unescape(slow_escape(text)) == text
            assert not re.search(r"\[/?(INST|SYS|ROLE)\]|</?s>", slow_escape(text))


@pytest.mark.parametrize("piece_bytes", [chat_tree.PIECE, 16])
def test_chat_digests_equal_brute_force(spark, convs, piece_bytes):
    found = chat_tree.digest(convs)
    if piece_bytes != chat_tree.PIECE:
        odd = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], convs.select("conv_id", "turn", "role", "text").schema)
        found = chat_tree.read_back(chat_tree.format_tree(convs.select("conv_id", "turn", "role", "text").union(odd), piece_bytes))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow_digests(ROWS)


@pytest.mark.parametrize("piece_bytes", [chat_tree.PIECE, 200])
def test_stream_holds_shared_turns_once(convs, piece_bytes):
    tree = chat_tree.format_tree(convs, piece_bytes)
    runs = sorted(tree.runs.collect(), key=lambda r: r["start"])
    stream = b"".join(r["tokens"] for r in runs)
    # Without gaps, and as long as all distinct beginnings.
    assert [r["start"] for r in runs] == list(itertools.accumulate([0, *(len(r["tokens"]) for r in runs[:-1])]))
    formatted = {c: tuple(slow_turn(*t).encode() for t in turns) for c, turns in ordered(ROWS).items()}
    nodes = {turns[: i + 1] for turns in formatted.values() for i in range(len(turns))}
    assert len(stream) == sum(len(n[-1]) for n in nodes)
    cut = lambda spans: b"".join(stream[s["start"] : s["end"]] for s in spans)
    for row in runs:
        # What a row attends is the path above it, and its position the length of that.
        assert row["position"] == sum(s["end"] - s["start"] for s in row["attends"])
        assert any(b"".join(t).startswith(cut(row["attends"]) + row["tokens"]) for t in formatted.values())
    for row in tree.members.collect():
        assert cut(row["before"]) + stream[row["run"] : row["end"]] == b"".join(formatted[row["conv_id"]])
    learnt = sorted(cut([s]).decode() for r in runs for s in r["loss"])
    assert learnt == sorted(slow_escape(t) for t in [n for n in _last_turns() if n is not None])


def _last_turns():
    """Text of the last turn of every distinct beginning that an assistant ends, else None."""
    seen = set()
    for turns in ordered(ROWS).values():
        for i in range(len(turns)):
            if tuple(turns[: i + 1]) not in seen:
                seen.add(tuple(turns[: i + 1]))
                yield turns[i][1] if turns[i][0] == "assistant" else None


def test_walk_in_parts_equals_one_walk():
    rng = random.Random(5)
    for _ in range(200):
        size_of = {c: 1 + rng.randrange(9) for c in "abc"}
        seqs = sorted({"".join(rng.choices("abc", k=1 + rng.randrange(6))) for _ in range(rng.randrange(1, 40))})
        rows = [("".join(c * chat_tree.HASH for c in s), [size_of[c] for c in s]) for s in seqs]
        whole = chat_tree.Walk()
        expected = [whole.step(*r) for r in rows]
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(4)))) if len(rows) > 1 else []
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        now, found = chat_tree.Walk(), []
        for part in parts:
            alone = chat_tree.Walk()
            for r in part:
                alone.step(*r)
            begun = chat_tree.Walk(now.key, now.runs, now.end)
            found += [begun.step(*r) for r in part]
            runs = [{"turns": t, "start": s} for t, s in alone.runs]
            now = now.after({"first": part[0][0], "sizes": part[0][1], "last": alone.key, "runs": runs, "end": alone.end})
            assert (now.key, now.runs, now.end) == (begun.key, begun.runs, begun.end)
        assert found == expected


# Prefix trie.


def slow_trie(rows):
    own = ordered(rows)
    members, nodes = defaultdict(list), {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6 if conv is not None else 0
        base = own.get(conv - conv % 100, []) if conv is not None else []
        turns = tuple(base[:h] + turns[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        nodes.setdefault(turns, []).append(conv)
    smallest = {n: min((c for c in m if c is not None), default=None) for n, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in nodes.get(n, []) if c is not None)))
        parent = smallest[n[:-1]] if n else None
        out.append((smallest[n], len(n), parent, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("band, block", [(16, 1 << 16), (2, 3), (3, 16)])
def test_trie_equals_brute_force(convs, monkeypatch, band, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    assert sorted((tuple(r) for r in prefix_trie.trie(convs, band).collect()), key=repr) == slow_trie(ROWS)


# Repair.


def test_cheapest_edits_by_trying_all():
    rng = random.Random(2)
    for _ in range(150):
        row_kinds = [(rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(1, 5))]
        rules = [(chr(repair.FIRST + 12), repair.symbol(*row_kinds[0]) + repair.symbol(*row_kinds[-1]))]
        seq = "".join(repair.symbol(*k) for k in row_kinds).replace(rules[0][1], rules[0][0])
        assert repair.cheapest(seq, repair.matrices(rules)) == try_all(row_kinds)


def try_all(row_kinds):
    """Least (cost, audit) over all edits and up to two insertions in each place."""
    options = []
    for role, fault in row_kinds:
        late = 3 if fault == repair.CUT else 0
        mine = [(4, "D", "")]
        if fault != repair.GONE:
            mine += [(late, "K", "suax"[role]), (3 + late, "R", "u"), (3 + late, "R", "a")]
        options.append(mine)
    gap = [(3 * n, "I" * n, "".join(r)) for n in range(3) for r in itertools.product("ua", repeat=n)]
    found = [(0, "", "")]
    for step in [s for o in options for s in (gap, o)] + [gap]:
        found = list({(c + c2, a + a2, r + r2) for c, a, r in found for c2, a2, r2 in step if viable(r + r2)})
    return min((c, a) for c, a, r in found if re.fullmatch("(s?(ua)+)?", r))


def viable(roles):
    return re.fullmatch("s?(ua)*u?", roles) is not None


def test_repair_equals_brute_force(convs):
    rows = [tuple(r) for r in repair.damaged_digests(convs).collect()]
    assert sorted(rows, key=repr) == sorted(slow_repair.repaired(ROWS), key=repr)


def test_repaired_turns_alternate(convs):
    rows = repair.repair(repair.damage(convs)).collect()
    by_conv = defaultdict(dict)
    for r in rows:
        by_conv[r["conv_id"]][r["turn"]] = (r["role"], r["text"])
    expected = {c: slow_repair.best(k, slow_repair.faults(k))[2] for c, k in slow_repair.damaged(ROWS).items()}
    assert {c: tuple(t for _, t in sorted(turns.items())) for c, turns in by_conv.items()} == {c: t for c, t in expected.items() if t}
    for turns in by_conv.values():
        assert re.fullmatch("s?(ua)+", "".join(r[:1] for _, (r, _) in sorted(turns.items())))


# All of them.


@pytest.mark.parametrize("run", [chat_tree.digest, prefix_trie.trie, repair.damaged_digests])
def test_empty_table(spark, run):
    rows = run(frame(spark, ROWS).where("false")).collect()
    assert [r[0] for r in rows] == ([-1] if run is chat_tree.digest else [])


@pytest.mark.parametrize("module, run", [(chat_tree, chat_tree.digest), (prefix_trie, prefix_trie.trie)])
def test_sql_says_the_same(spark, module, run):
    """On the rows with an id and without ties, as SQL has no order for those."""
    rows = [r for r in ROWS if r[0] is not None and r[0] != 2103]
    conversations = frame(spark, rows).toPandas()  # noqa: F841 - read by name below
    conversations["turn"] = conversations["turn"].astype("Int64")
    db = duckdb.connect()
    db.register("conversations", conversations)
    found = run(frame(spark, rows))
    expected = db.sql(f"SELECT {', '.join(found.columns)} FROM ({module.oracle_sql()})").fetchall()
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)
