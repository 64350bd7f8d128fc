"""Conversation repair against all edits of short conversations, in one search and in pieces."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnstile.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, fault int, dropped string"


def all_edits(rows, state=0):
    """(cost, audit, lines) of all edits with at most two inserts on end; rows: (fault, role, text)."""
    out = []

    def go(i, q, cost, audit, lines):
        if i == len(rows) and q in (0, 3):
            out.append((cost, audit, lines))
        if not audit.endswith("II"):
            for name, letter in (("user", "u"), ("assistant", "a")):
                if (q, letter) in repair.STEP:
                    go(i, repair.STEP[q, letter], cost + 5, audit + "I", [*lines, name + ":"])
        if i < len(rows):
            fault, role, text = rows[i]
            go(i + 1, q, cost + 2, audit + "D", lines)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                extra = 5 if fault == repair.CUT_OFF else 0
                if (q, role[:1]) in repair.STEP:
                    go(i + 1, repair.STEP[q, role[:1]], cost + extra, audit + "K", [*lines, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    if (q, name[0]) in repair.STEP:
                        go(i + 1, repair.STEP[q, name[0]], cost + 1 + extra, audit + "R", [*lines, f"{name}:{text}"])

    go(0, state, 0, "", [])
    return out


def by_hand(rows):
    """The row of the result; rows: (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged = set(), []
    for _, role, text in rows:
        bare = text.rstrip(repair.BLANKS)
        judged.append((1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0, role, text))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in repair.FOLLOWS for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = min(all_edits(judged))
    faults = [sum(f == k for f, _, _ in judged) for k in (1, 2, 3)]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def made(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "usher"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "Why? ", "\u00a0", "é.", "end.\n"]
    return [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_against_all_edits(spark, shared, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    made_rows = {k: made(rng, rng.randint(1, 5)) for k in [None, *range(150)]}
    df = spark.createDataFrame([(k, t, r, x, "k", 7, "d") for k, v in made_rows.items() for t, r, x in v], SCHEMA)
    out = repair.repaired(df)
    got = {r["key"]: tuple(r)[1:] for r in out.collect()}
    want = {k: by_hand(v) for k, v in made_rows.items()}
    assert got == {k: v[0] for k, v in want.items()}
    turns = defaultdict(list)
    for r in sorted(repair.repaired_turns(df, out).collect(), key=lambda r: r["place"]):
        turns[r["key"]].append(f"{r['role']}:{r['text']}")
    assert {k: turns.get(k, []) for k in want} == {k: v[1] for k, v in want.items()}


def test_search_from_and_to_every_state():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.randrange(4), rng.choice("suatx")) for _ in range(rng.randint(0, 9))]
        for entry in range(4):
            for exits in [(0,), (1,), (2,), (3,), (0, 3)]:
                # Row by row: the least path to each state, inserts after each step.
                best = {entry: (0, "")}
                for k in range(len(rows) + 1):
                    for _ in range(4):
                        for q, (cost, audit) in list(best.items()):
                            to = repair.MADE[q][1]
                            best[to] = min(best.get(to, (99999, "")), (cost + 5, audit + "I"))
                    if k == len(rows):
                        break
                    after = {}
                    for q, (cost, audit) in best.items():
                        for edit, price, (j, to) in repair.Lattice(rows).after((k, q)):
                            if j == k + 1:
                                after[to] = min(after.get(to, (99999, "")), (cost + price, audit + edit))
                    best = after
                assert repair.least_edits(rows, entry, exits) == min((best[q] for q in exits if q in best), default=None)


def test_dropped_and_empty(spark, shared):
    df = spark.createDataFrame([(1, 0, "user", "Yes.", "k", 7, "d"), (2, 0, "user", "Yes.", "k", 7, "d")], SCHEMA)
    rows = {r["key"]: r for r in repair.repaired(df, dropped=F.col("conv_id") == 1).collect()}
    assert tuple(rows[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert rows[2]["audit"] == "D" and rows[2]["cost"] == 2
    assert repair.repaired(df.limit(0)).count() == 0


def test_long_conversation_of_many_pieces(spark, shared):
    """One conversation of 5,000 turns: its pieces join to the audit of one search."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"Turn {t}.", f"Turn {t}", ""])) for t in range(5000)]
    got = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    judged = [(repair.BLANK if not x else repair.NONE if x.endswith(".") else repair.CUT_OFF, r[:1]) for _, _, r, x in rows]
    assert (got["cost"], got["audit"]) == repair.least_edits(judged, repair.START, repair.ACCEPTING)
