"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn, then user and assistant in turns.

The edit lattice of a conversation has a node for (rows read, state of the role pattern) and an arc for each edit. A
forward search from the start and a reverse search from the accepting nodes, with a heap each, settle nodes in order of
cost until no cheaper or equal crossing can come; of all crossings of the least cost the least concatenated audit is taken.

Rows reach a task sorted by conversation and turn, and are read as a stream. The lattice of a long conversation is cut
every CHUNK_ROWS rows: each piece is searched from every state to every state, and the pieces' best paths are added
up. So a task holds one piece, four audits (which are the result) and four running hashes, however long a
conversation is. Its rows pass through one task because the hash of its repaired text is one sequence; they are never collected.
A duplicate is found by a sorted window on the same partitioning, which spills.

Edge cases: a null in turn sorts first and counts in no gap; a null role or text is one space; a null conv_id is a
conversation of its own; rows that share a turn stand in the order of role and text; a repeated row is a duplicate of the
first; an empty table gives an empty one; other columns are not read, and no name of theirs matters; roles may be
any text, of which the first letter counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a conversation, and characters of text, that one search takes.
CHUNK_ROWS, CHUNK_CHARS = 1024, 8_000_000

#: Fixed values of the contract: the role pattern `(s?(ua)+)?` and the costs of edits.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FOLLOWS = {"su", "ua", "au"}

#: By state: the one role that can come next of those that an edit can make, and the state then.
MADE = {q: (r, STEP[q, r]) for q in range(4) for r in "ua" if (q, r) in STEP}
NAMES = {"u": "user", "a": "assistant"}

#: White space of the contract, and faults in the order in which they count.
BLANKS = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, CUT_OFF, DROPPED = range(5)


class Row(NamedTuple):
    fault: int
    role: str
    text: str


class Lattice:
    """The edits of some rows; a node is (rows read, state)."""

    def __init__(self, rows: list[tuple[int, str]]):
        """rows: (fault, initial of the role)."""
        self.rows = rows

    def after(self, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
        """(edit, cost, next node)."""
        i, q = node
        role, made = MADE[q]
        yield "I", INSERT, (i, made)
        if i < len(self.rows):
            fault, initial = self.rows[i]
            yield "D", DELETE, (i + 1, q)
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT_OFF else 0
                if (q, initial) in STEP:
                    yield "K", extra, (i + 1, STEP[q, initial])
                yield "R", REROLE + extra, (i + 1, made)

    def before(self, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
        """(edit, cost, node from which it leads here)."""
        i, q = node
        for p in range(4):
            for j in (i, i - 1) if i else (i,):
                for edit, cost, to in self.after((j, p)):
                    if to == node:
                        yield edit, cost, (j, p)


class _Search:
    """One direction of the search: settled nodes with their cost and least audit, and the heap."""

    def __init__(self, arcs, sources: list[tuple[int, int]], sign: int):
        self.arcs, self.sign = arcs, sign
        self.found = {s: (0, "") for s in sources}
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}
        # Arcs without cost lead one row on: of nodes of one cost, that with fewer rows read (to read, in reverse) comes first.
        self.heap = [(0, sign * s[0], s) for s in sources]
        self.heap.sort()

    def top(self) -> int | None:
        while self.heap and self.heap[0][2] in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self, other: _Search) -> int | None:
        """Settles the next node; the least cost of a path through it to what the other direction has settled."""
        cost, _, node = heappop(self.heap)
        audit = self.found[node][1]
        self.settled[node] = (cost, audit)
        met = [cost + other.settled[node][0]] if node in other.settled else []
        for edit, price, to in self.arcs(node):
            if to in other.settled:
                met.append(cost + price + other.settled[to][0])
            label = (cost + price, audit + edit if self.sign > 0 else edit + audit)
            if to not in self.settled and (to not in self.found or label < self.found[to]):
                if to not in self.found or label[0] < self.found[to][0]:
                    heappush(self.heap, (label[0], self.sign * to[0], to))
                self.found[to] = label
        return min(met, default=None)


def least_edits(rows: list[tuple[int, str]], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from the entry state to one of the exits, the ASCII-least of equal ones."""
    lattice = Lattice(rows)
    forward = _Search(lattice.after, [(0, entry)], 1)
    reverse = _Search(lattice.before, [(len(rows), q) for q in exits], -1)
    best = None
    while (a := forward.top()) is not None and (b := reverse.top()) is not None:
        if best is not None and a + b > best:
            break
        here, there = (forward, reverse) if a <= b else (reverse, forward)
        met = here.settle(there)
        if met is not None and (best is None or met < best):
            best = met
    if best is None:
        return None
    crossings = []
    for node, (cost, audit) in forward.settled.items():
        if node in reverse.settled and cost + reverse.settled[node][0] == best:
            crossings.append(audit + reverse.settled[node][1])
        for edit, price, to in lattice.after(node):
            if to in reverse.settled and cost + price + reverse.settled[to][0] == best:
                crossings.append(audit + edit + reverse.settled[to][1])
    return best, min(crossings)


def replay(rows: list[Row], state: int, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows."""
    left = iter(rows)
    for edit in audit:
        row = next(left) if edit != "I" else None
        if edit == "K":
            yield row.role, row.text
            state = STEP[state, row.role[:1]]
        elif edit != "D":
            role, state = MADE[state]
            yield NAMES[role], row.text if edit == "R" else ""


class _Conversation:
    """What is known of a conversation after the rows read so far."""

    def __init__(self, key) -> None:
        self.key, self.rows, self.chars = key, [], 0
        self.best: dict[int, tuple[int, str, object]] = {START: (0, "", hashlib.sha256())}
        self.counts = [0] * 5
        self.illegal = self.distinct = 0
        self.least = self.most = self.role = None

    def add(self, turn: int | None, fault: int, role: str | None, text: str | None) -> None:
        if fault == DROPPED:
            return
        self.counts[fault] += 1
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.distinct = turn, self.distinct + 1
        if self.role is not None and self.role + role[:1] not in FOLLOWS:
            self.illegal += 1
        self.role = role[:1]
        self.rows.append(Row(fault, role, text))
        self.chars += len(text)
        if len(self.rows) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS:
            self.fold([(q,) for q in range(4)])

    def fold(self, exits: list[tuple[int, ...]]) -> None:
        """Carries the best paths over the rows held."""
        ways: dict[tuple[int, ...], tuple[int, str, int, str]] = {}
        lattice = [(r.fault, r.role[:1]) for r in self.rows]
        for entry, (cost, audit, _) in self.best.items():
            for to in exits:
                if (found := least_edits(lattice, entry, to)) is not None:
                    way = (cost + found[0], audit + found[1], entry, found[1])
                    ways[to] = min(way, ways.get(to, way))
        after = {}
        for to, (cost, audit, entry, piece) in ways.items():
            whole = self.best[entry][2].copy()
            for k, (role, text) in enumerate(replay(self.rows, entry, piece)):
                whole.update((("\n" if k or entry != START else "") + f"{role}:{text}").encode())
            after[to[0]] = (cost, audit, whole)
        self.best, self.rows, self.chars = after, [], 0

    def result(self) -> tuple:
        self.fold([ACCEPTING])
        cost, audit, whole = self.best[ACCEPTING[0]]
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return self.key, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT_OFF], self.illegal, cost, audit, whole.hexdigest()


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Conversations in an Arrow batch that a task gives.
GIVEN = 2000


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, done, key_type = None, [], None
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def given() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *kinds], strict=True)], ["key", *[f.split()[0] for f in FIELDS.split(", ")]])

    for batch in batches:
        key_type = batch.column("key").type
        for key, turn, fault, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "fault", "role", "text")), strict=True):
            if current is None or key != current.key:
                if current is not None:
                    done.append(current.result())
                    if len(done) >= GIVEN:
                        yield given()
                current = _Conversation(key)
            current.add(turn, fault, role, text)
    if current is not None:
        done.append(current.result())
    if done:
        yield given()


def faulted(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, fault of rows with columns key, turn, role, text, dropped, in one partition a key and in order."""
    role, text = (F.when(~F.col("dropped"), F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text"))
    held = rows.select("key", "turn", role, text, "dropped").repartition("key")
    seen = F.row_number().over(Window.partitionBy("key", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    ends = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(F.col("dropped"), DROPPED).when(ends == "", BLANK).when(seen > 1, DUPLICATE).when(~ends.isin(".", "!", "?"), CUT_OFF).otherwise(NONE)
    return held.select("key", "turn", "role", "text", fault.alias("fault")).sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Rows for which `dropped` holds count as absent, though their conversation has a row in the result.
    """
    gone = F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
    rows = conversations.select(conversations[conv].alias("key"), conversations[turn].cast("long").alias("turn"), conversations[role].alias("role"), conversations[text].alias("text"), gone.alias("dropped"))
    return faulted(rows).mapInArrow(_repair, f"key {rows.schema['key'].dataType.simpleString()}, {FIELDS}")


def repaired_turns(conversations: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, place, edit, role, text of the repaired conversations' rows: the audits of `repaired` applied to the rows.

    Edits meet rows by (conversation, number of the row), so that a long conversation is dealt to many tasks.
    """
    rows = conversations.select(conversations[conv].alias("key"), conversations[turn].cast("long").alias("turn"), *(F.coalesce(conversations[c], F.lit(" ")).alias(to) for c, to in ((role, "role"), (text, "text"))))
    number = F.row_number().over(Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    numbered = rows.select("key", "role", "text", number.alias("number"))
    edits = repairs.select("key", F.posexplode(F.split("audit", "")).alias("step", "edit")).where("edit <> ''")
    so_far = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = edits.select("key", "edit", F.sum((F.col("edit") != "I").cast("int")).over(so_far).alias("number"), F.sum((F.col("edit") != "D").cast("int")).over(so_far).alias("place")).where("edit <> 'D'")
    met = placed.alias("e").join(numbered.alias("r"), F.col("e.key").eqNullSafe(F.col("r.key")) & (F.col("e.number") == F.col("r.number")) & (F.col("e.edit") != "I"), "left")
    # The first row kept as a system turn moves the turns after it by one.
    after_system = F.max(((F.col("place") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s")).cast("int")).over(Window.partitionBy("key"))
    flat = met.select("e.key", "place", "edit", "role", "text")
    made = F.when((F.col("place") - after_system) % 2 == 1, "user").otherwise("assistant")
    return flat.select("key", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(made).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(`conv_id:turn`) % 20: conv_id, turn, role, text, dropped."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    role = F.when(F.col("kind") == 4, "user").otherwise(filled("role")).alias("role")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text")).alias("text")
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind"), F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return rows.select("conv_id", "turn", role, text, (F.col("kind") == 0).alias("dropped"))
