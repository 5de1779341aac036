"""Conversation repair by a plain dynamic program on whole strings, and the damage before it."""

import hashlib
import re
import zlib

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WHITE = " \t\n\x0b\f\r"


def damaged(rows):
    """conv_id → its rows (turn, role, text) after damage, in order; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows, kinds):
    """Least (cost, audit, repaired turns) by trying every edit from every state."""

    def put_in(table):
        for _ in range(2):
            for state, (cost, audit, turns) in list(table.items()):
                for role in ("user", "assistant"):
                    to = NEXT.get((state, role[0]))
                    if to is not None:
                        offer(table, to, (cost + 3, audit + "I", turns + ((role, ""),)))

    def offer(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    now = {0: (0, "", ())}
    for (_, role, text), kind in zip(rows, kinds):
        put_in(now)
        after = {}
        late = 3 if kind == "truncated" else 0
        for state, (cost, audit, turns) in now.items():
            offer(after, state, (cost + 4, audit + "D", turns))
            if kind in ("blank", "duplicate"):
                continue
            if (state, role[:1]) in NEXT:
                offer(after, NEXT[state, role[:1]], (cost + late, audit + "K", (*turns, (role, text))))
            for other in ("user", "assistant"):
                if (state, other[0]) in NEXT:
                    offer(after, NEXT[state, other[0]], (cost + 3 + late, audit + "R", (*turns, (other, text))))
        now = after
    put_in(now)
    return min((now[s] for s in (0, 3) if s in now), key=lambda e: e[:2])


def repaired(rows):
    """The contract's row of each conversation."""
    out = []
    for conv, kept in damaged(rows).items():
        kinds = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, new = best(kept, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return out
