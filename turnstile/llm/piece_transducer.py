"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines over the tropical semiring (min, +):

* the normaliser, of one state, writes the blank mark before a text and in the place of each blank (`marks`);
* the lexicon is a tree of states below `root`: an arc reads a character and leads to the next state, and where a piece
  ends it may write the piece and go back to the root. A character that no piece has takes the root's rest arc, which
  writes the pieces of its bytes;
* the grammar reads pieces and its state is the last one; `rows[last][piece]` is the weight of the arc for a further piece.

For a unigram model all rows are one: a piece weighs minus its score. For a BPE model a piece weighs nothing where merging
leaves the border to the piece before it, and infinity elsewhere; which is the case follows from the order of merges along
the two edges that meet, and rows are filled as the composition asks for their arcs.

`path` composes a part of the normalised text with lexicon and grammar, place by place, and keeps the least weight at which
a place is reached and the state of the grammar there. One state a place is enough: a unigram grammar has no more, and of
a BPE model only one sequence of pieces up to a place has a finite weight, namely the result of merging so far. No piece
has a blank mark after another character, so a text falls apart before its blanks, and equal words share one path.

Only the identity normaliser is known, as a model without a character map has it; others are refused.

Edge cases: null and empty texts have no ids and decode to the empty text; blanks, control characters and characters
outside the vocabulary come back unchanged (by byte pieces); the blank mark itself comes back as a blank, as the format
has it; texts of any length are taken whole; repeated rows are encoded each for itself; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import kept_in_worker

MARK = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
FOREVER = 1 << 40
#: In the place of a piece: the rest arc of the lexicon, and the state of the grammar at the start and after that arc.
REST = -1
INFINITE = float("inf")
#: The state without arcs, and what the root gives for a character without one.
LEAF: dict[str, tuple] = {}
NO_ARC = (LEAF, REST)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, byte_fallback, self.prefix = UNIGRAM, False, True
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]), own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only the identity normaliser is known")
                self.prefix = bool(own.get(3, 1))
        if not byte_fallback or self.kind not in (UNIGRAM, BPE) or any(k == USER for _, _, k in self.pieces):
            raise ValueError("the model needs byte fallback, no user-defined pieces, and to be unigram or BPE")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on after a blank")
        self.longest = max(map(len, self.ids))
        # Characters that no piece has stand alone; texts fall apart at line ends for speed if these are such.
        ends = "" if any("\n" in p for p in self.ids) else "\n"
        self.parts = re.compile(f"{MARK}+[^{MARK}{ends}]*|[^{MARK}{ends}]+" + ("|\n" if ends else ""))
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else b"" for p, _, k in self.pieces]
        self.table: pa.Array | None = None
        # The order of merges: higher scores first.
        by_score = sorted({s for p, s, k in self.pieces if k == NORMAL}, reverse=True)
        rank = {s: i for i, s in enumerate(by_score)}
        self.rank = {p: rank[self.pieces[i][1]] for p, i in self.ids.items()}
        self.marks = {ord(" "): MARK}
        self.root = self._lexicon()
        self.merges: dict[str, tuple[str, str] | None] = {}
        self.edges: dict[int, tuple] = {}
        if self.kind == UNIGRAM:
            weights = {i: -self.pieces[i][1] for i in self.ids.values()}
            weights[REST] = max(weights.values()) + 10
            self.rows, self.least = dict.fromkeys([REST, *self.ids.values()], weights), min(weights.values())
        else:
            self.rows, self.least = _Rows(self), 0.0

    def _lexicon(self) -> dict[str, tuple]:
        """The root of the tree. A state is its arcs: character -> (next state, what is written there; REST: nothing)."""
        root: dict[str, tuple] = {}
        for piece, i in sorted(self.ids.items()):
            state = root
            for char in piece[:-1]:
                after, written = state.get(char, (LEAF, REST))
                if after is LEAF:
                    state[char] = after, written = {}, written
                state = after
            state[piece[-1]] = LEAF, i
        return root

    # -- grammar -------------------------------------------------------------------------------------------------

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging a piece's characters joins last; None if merging does not end in the piece."""
        if piece not in self.merges:
            parts, rank = list(piece), self.rank
            while len(parts) > 2:
                found = [(r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                at = min(found)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.merges[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.merges[piece]

    def _edge(self, i: int) -> tuple | None:
        """(left edge, right edge): the parts at a piece's two ends, whole piece first, each with the rank of the merge
        that made it (-1: a character) and of the merge that took it up (FOREVER: the whole). None: never a result."""
        if i not in self.edges:
            found = []
            for side in (0, 1):
                edge, part, taken = [], self.pieces[i][0], FOREVER
                while part is not None:
                    if len(part) == 1:
                        edge.append((part, -1, taken))
                        break
                    two = self._last_merge(part)
                    if two is None:
                        edge = None
                        break
                    made = self.rank[part]
                    edge.append((part, made, taken))
                    part, taken = two[side], made
                found.append(edge)
            self.edges[i] = None if found[0] is None or found[1] is None else tuple(found)
        return self.edges[i]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between two pieces: going back merge by merge, no two parts that met there
        would have merged before one of them was taken up by its own side."""
        if b == REST:
            return True
        right = self._edge(b)
        if a == REST or right is None:
            return right is not None
        left = self._edge(a)
        if left is None:
            return False
        ends, starts, rank, i, j = left[1], right[0], self.rank, 0, 0
        while True:
            (x, made_x, taken_x), (y, made_y, taken_y) = ends[i], starts[j]
            r = rank.get(x + y)
            # Of two equal merges the left one is done first.
            if r is not None and r < taken_x and r <= taken_y:
                return False
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i += 1
            else:
                j += 1

    # -- composition and shortest path ---------------------------------------------------------------------------

    def path(self, part: str) -> list[int]:
        """Ids on the shortest path of a part of the normalised text."""
        root, rows, least, longest, n = self.root, self.rows, self.least, self.longest, len(part)
        weight, last, begin = [0.0] + [INFINITE] * n, [REST] * (n + 1), [0] * (n + 1)
        for start in range(n):
            here, end, state = weight[start], start, root
            if here == INFINITE:
                continue
            row, bound = rows[last[start]], here + least
            for char in part[start : start + longest]:
                arc = state.get(char)
                if arc is None:
                    break
                state, piece = arc
                end += 1
                if piece >= 0 and bound < weight[end] and (w := here + row[piece]) < weight[end]:
                    weight[end], last[end], begin[end] = w, piece, start
            # The rest arc is for a character that is no piece.
            if root.get(part[start], NO_ARC)[1] == REST and here + row[REST] < weight[start + 1]:
                weight[start + 1], last[start + 1], begin[start + 1] = here + row[REST], REST, start
        path, end = [], n
        while end:
            start, piece = begin[end], last[end]
            path.append((piece,) if piece != REST else [self.bytes[b] for b in part[start:end].encode()])
            end = start
        return [i for ids in reversed(path) for i in ids]

    def normalised(self, text: str) -> str:
        text = text.translate(self.marks)
        return MARK + text if self.prefix and text else text

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence of ids."""
        return self.decoded(pa.array([0, len(ids)], pa.int32()), np.asarray(ids, "<i4"))[0].as_py()

    def decoded(self, ends: pa.Array, ids: np.ndarray) -> pa.Array:
        """The texts of many sequences, which lie one after the other in `ids` and end at `ends`, by one look-up of all ids."""
        if self.table is None:
            # Pieces as they stand, and again as they begin a text, without the blank that the normaliser has put there.
            first = [o[1:] if self.prefix and o.startswith(b" ") else o for o in self.out]
            self.table = pa.array(self.out + first, pa.large_binary())
        ends = np.asarray(ends)
        starts = ends[:-1][ends[:-1] < ends[1:]]
        places = ids.copy()
        places[starts] += len(self.out)
        flat = self.table.take(pa.array(places))
        _, offsets, data = flat.buffers()
        offsets = np.frombuffer(offsets, "<i8", len(ids) + 1, flat.offset * 8) if len(ids) else np.zeros(1, "<i8")
        data = data or pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets[ends].tobytes()), data])
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:  # ids of bytes that make no characters, which no text gives
            return pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.large_string())


class _Rows(dict):
    """The rows of a BPE model's grammar, made when first asked for; they start anew when their arcs are too many."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.known = machine, 0

    def __missing__(self, last: int) -> _Row:
        if self.known >= 2_000_000:
            self.clear()
            self.known = 0
        self[last] = row = _Row(self, last)
        return row


class _Row(dict):
    """Weight of the arc for each further piece after one last piece."""

    def __init__(self, rows: _Rows, last: int):
        super().__init__()
        self.rows, self.last = rows, last

    def __missing__(self, piece: int) -> float:
        self.rows.known += 1
        self[piece] = weight = 0.0 if self.rows.machine.may_follow(self.last, piece) else INFINITE
        return weight


class _Paths(dict):
    """Ids of a word as the bytes of 32-bit integers. When full, words not asked for since it was last full go."""

    FULL = 300_000

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.older = machine, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("i", self.machine.path(part)).tobytes()
        if len(part) <= 64:
            if len(self) >= self.FULL:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


def _run(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = kept_in_worker(f"paths-{zlib.crc32(model)}", lambda: _Paths(Transducer(model)))
        machine = paths.machine
        for batch in batches:
            ids, ends = [], [0]
            for text in batch.column("text").to_pylist():
                own = b"".join(map(paths.__getitem__, machine.parts.findall(machine.normalised(text or ""))))
                ids.append(own), ends.append(ends[-1] + len(own) // 4)
            flat, ends = np.frombuffer(b"".join(ids), "<i4"), pa.array(ends, pa.int32())
            texts = machine.decoded(ends, flat).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), texts], ["row", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, model_file: str, carry: list[str], text: str = "text") -> DataFrame:
    """row (the columns `carry`), ids (array of int), decoded (the text that the ids give back)."""
    with open(model_file, "rb") as f:  # the driver's file; it travels to the tasks with the job
        model = f.read()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_run(model), f"row {row}, ids array<int>, decoded string")
