"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are dealt by ranges of doc_id and sorted, so the files, in the order of (partition, number), hold all ids in
ascending doc_id order. A file is self-contained and bounded (`FILE_TOKENS`): it ranks the ids it holds by frequency,
writes the table from rank to id, then a control byte for every four ranks (two bits each: the rank's bytes less one),
then the ranks' bytes without leading zeros. Decoding looks the control bytes up in a table of byte masks.

Texts are cut at line ends and before the blanks at which the tokenizer's own pattern cuts too, so that equal pieces are
encoded once; the ids are those of encoding the whole text.

Edge cases: a null or empty text has only the end id; a null doc_id sorts first; rows that share a doc_id stand side by
side in the order of their texts; special-token strings in a text are ordinary text; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import a_task_each, kept_in_worker, new_folder, staged
from turnstile.llm.warc import file_system

MAGIC, HEAD = b"TKF1", "<4sQQQQ"
#: Ids in a file before the next is begun; the id that ends a document.
FILE_TOKENS, END_ID = 8_000_000, 0
#: Characters of texts whose different words are looked up together; a text of more stands alone or ends its group.
TOGETHER_CHARS = 6_000_000
#: White space as the tokenizer's pattern knows it, and the pieces into which a text may be cut.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: By control byte: which of 16 bytes are there, of four ranks with four bytes each.
MASKS = np.array([[byte <= (control >> 2 * k & 3) for k in range(4) for byte in range(4)] for control in range(256)], dtype=bool)


class TokenFileError(ValueError):
    """A token file does not keep to the format."""


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    wide = np.zeros((len(ranks) + 3) // 4 * 4, "<u4")
    wide[: len(ranks)] = ranks
    size = (wide > 0xFF).astype(np.uint8) + (wide > 0xFFFF) + (wide > 0xFFFFFF)
    control = (size.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    there = MASKS[control].reshape(-1, 4)[: len(ranks)]
    return control.tobytes(), wide.view(np.uint8).reshape(-1, 4)[: len(ranks)][there].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks; a chunk of control bytes at a time."""
    out, at = np.empty(count, "<u4"), 0
    for first in range(0, count, 1 << 20):
        n = min(1 << 20, count - first)
        there = MASKS[control[first // 4 : (first + n + 3) // 4]].reshape(-1, 4)[:n]
        size = int(there.sum())
        if at + size > len(data):
            raise TokenFileError("data bytes are missing")
        full = np.zeros((n, 4), np.uint8)
        full[there] = data[at : at + size]
        out[first : first + n] = full.view("<u4").ravel()
        at += size
    if at != len(data):
        raise TokenFileError("data bytes are left over")
    return out


def file_bytes(docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A whole file: head, null marks, doc ids, token counts, table of ids by rank, control bytes, data bytes, checksum."""
    frequency = np.bincount(ids)
    used = np.flatnonzero(frequency)
    table = used[np.lexsort((used, -frequency[used]))].astype("<u4")
    rank = np.zeros(len(frequency), "<u4")
    rank[table] = np.arange(len(table))
    control, data = pack(rank[ids])
    body = b"".join([
        struct.pack(HEAD, MAGIC, len(docs), len(ids), len(table), len(data)), bytes(d is None for d in docs), np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array(counts, "<u8").tobytes(), table.tobytes(), control, data,
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def parse(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, token counts, all ids) of a file."""
    if len(raw) < struct.calcsize(HEAD) + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise TokenFileError("cut off or damaged")
    magic, n_docs, n_ids, n_table, n_data = struct.unpack_from(HEAD, raw)
    sizes = [struct.calcsize(HEAD), n_docs, 8 * n_docs, 8 * n_docs, 4 * n_table, (n_ids + 3) // 4, n_data]
    if magic != MAGIC or sum(sizes) + 4 != len(raw):
        raise TokenFileError("head and length do not agree")
    at = np.cumsum(sizes)
    part = lambda k, kind: np.frombuffer(raw[at[k] : at[k + 1]], kind)
    docs = [None if null else d for null, d in zip(part(0, np.uint8).tolist(), part(1, "<i8").tolist(), strict=True)]
    counts, table = part(2, "<u8").astype(np.int64), part(3, "<u4")
    if counts.sum() != n_ids:
        raise TokenFileError("token counts do not add up")
    return docs, counts, table[unpack(part(4, np.uint8), part(5, np.uint8), n_ids)]


#: Two white-space characters in a row: such a text is cut by the pattern, any other at line ends and blanks.
RUN = re.compile(f"[{_S}][{_S}]")
#: A piece whose only white space is the blank or line end it begins with: the tokenizer's pattern cuts before it, whatever goes before.
LED = re.compile(f"[ \n][^{_S}]+")
#: A piece that ends in punctuation after a letter or digit, between which the pattern cuts too.
ENDED = re.compile("(.*[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([.,;:!?]+)", re.DOTALL)


class _Pieces:
    """Ids of the pieces met so far, as bytes of 32-bit integers: as they are, and by what follows a leading blank (a line
    end stays in front). Full, it keeps no more."""

    MOST, TOGETHER = 700_000, 64

    def __init__(self) -> None:
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.sizes: np.ndarray | None = None

    def learn(self, tokenizer, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: many to one call where the pattern cuts between them, told apart by the bytes that each token stands for."""
        if self.sizes is None:
            vocab = tokenizer.get_vocab()
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.sizes[list(vocab.values())] = [len(t) for t in vocab]  # a character for each byte
        found: dict[str, bytes] = {}
        led = list(filter(LED.fullmatch, pieces))
        groups = [led[i : i + self.TOGETHER] for i in range(0, len(led), self.TOGETHER)]
        for some, e in zip(groups, tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids, ends = np.array(e.ids, "<u4"), np.cumsum([len(p.encode()) for p in some])
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if cuts[-1] == len(ids) - 1 and (reached[cuts] == ends).all():
                raw, to = ids.tobytes(), ((cuts + 1) * 4).tolist()
                found.update(zip(some, map(raw.__getitem__, map(slice, [0, *to], to)), strict=False))
        rest = [p for p in pieces if p not in found]
        for p, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[p] = np.array(e.ids, "<u4").tobytes()
        return [found[p] for p in pieces]

    def add(self, tokenizer, known: dict[str, bytes], keys: list[str], led) -> list[str]:
        """Adds the keys that are not known and tells what was added; `led`: the piece that a key stands for."""
        new = set(filterfalse(known.__contains__, keys))
        ended = {k: m.groups() for k in new if (m := ENDED.fullmatch(k))}
        marks = sorted({tail for _, tail in ended.values()})
        after = dict(zip(marks, self.learn(tokenizer, marks), strict=True))
        whole = sorted(new.difference(ended).union(stem for stem, _ in ended.values() if stem not in known))
        known.update(zip(whole, self.learn(tokenizer, [led(k) for k in whole]), strict=True))
        known.update({k: known[stem] + after[tail] for k, (stem, tail) in ended.items()})
        return [*whole, *ended]

    def joined(self, tokenizer, known: dict[str, bytes], cut: pa.ListArray, led) -> list[bytes]:
        """Ids of the texts that are cut into keys: each different key is looked up once."""
        words = cut.flatten().dictionary_encode()
        keys, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        new = self.add(tokenizer, known, keys, led)
        found = list(map(known.__getitem__, keys))
        if len(self.plain) + len(self.spaced) > self.MOST:
            for k in new:
                del known[k]
        ids, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = ids[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[at] - ends[:-1], n)].tobytes()
        bounds = (4 * ends[cut.offsets.to_numpy()]).tolist()
        return list(map(raw.__getitem__, map(slice, bounds, bounds[1:])))

    def encode(self, tokenizer, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as bytes of 32-bit integers."""
        by_pattern = [bool(RUN.search(t)) for t in texts]
        # Keys: a line end and what follows it, or what follows a blank; the text's own beginning counts as a line's.
        led = [f"\n{t}".replace("\n", " \n")[1:] for t, r in zip(texts, by_pattern, strict=True) if not r]
        pieces = [PIECE.findall(t) for t, r in zip(texts, by_pattern, strict=True) if r]
        by_blanks = self.joined(tokenizer, self.spaced, pc.split_pattern(pa.array(led, pa.large_string()), " "), lambda k: k if k.startswith("\n") else f" {k}")
        others, end = iter(self.joined(tokenizer, self.plain, pa.array(pieces, pa.list_(pa.large_string())), str)), len(self.learn(tokenizer, ["\n"])[0])
        rest = iter(by_blanks)
        return [next(others) if r else next(rest)[end:] for r in by_pattern]


def _writer(folder: str, tokenizer_json: str, key: str, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.encode_special_tokens = True
        known, end = kept_in_worker(f"pieces-{key}", _Pieces), struct.pack("<I", END_ID)
        fs, path = file_system(folder)
        partition, done = TaskContext.get().partitionId(), []
        docs: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []
        held = 0

        def finish() -> None:
            nonlocal held
            name = f"{partition:08d}-{len(done):05d}-{uuid.uuid4().hex}.tkf"
            with fs.open_output_stream(f"{path}/{name}.part", compression=None) as out:
                out.write(file_bytes(docs, counts, np.frombuffer(b"".join(parts), "<u4")))
            fs.move(f"{path}/{name}.part", f"{path}/{name}")
            done.append((partition, len(done), f"{folder}/{name}", len(docs), held))
            docs.clear(), counts.clear(), parts.clear()
            held = 0

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            group = np.cumsum([len(t) for t in texts]) // TOGETHER_CHARS
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]):
                for doc, raw in zip(ids[i:j], known.encode(tokenizer, texts[i:j]), strict=True):
                    docs.append(doc), counts.append(len(raw) // 4 + 1)
                    parts.extend((raw, end))
                    held += counts[-1]
                    if held >= file_tokens:
                        finish()
        if docs:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["part", "number", "path", "docs", "tokens"])

    return run


def write(docs: DataFrame, folder: str, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the token files; part, number, path, docs, tokens of each, in order of (part, number)."""
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's file; it travels to the tasks with the job
        tokenizer_json = f.read()
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = ordered.mapInArrow(_writer(folder, tokenizer_json, f"{zlib.crc32(tokenizer_json.encode())}", file_tokens), "part int, number int, path string, docs long, tokens long")
    return staged(files, "token-files")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
            folder, _, name = path.rpartition("/")
            fs, root = file_system(folder)
            with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                docs, counts, ids = parse(source.read())
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
            starts = ends - counts
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files listed."""
    # A row a file: the running sum is over the list of files, not over documents.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = staged(files.select("path", before.alias("first")), "token-file-starts")
    return a_task_each(listed).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str, **names) -> DataFrame:
    """Writes the documents' ids and reads them back from the files."""
    return read_files(write(docs, new_folder(docs.sparkSession, "tokens"), tokenizer_file, **names))
