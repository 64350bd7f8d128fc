"""Token counts: every distinct pre-token is counted once, and documents sum the counts of theirs; no ids are made.

1. Documents are put together into blocks of bounded size. A block holds its distinct pre-tokens, and for each document
   how often it has each of them (index and frequency).
2. The pre-tokens of all blocks are dealt out by hash, packed, a row for each block and bucket; equal ones meet in a bucket. The
   tokenizer sees each distinct one once, and its count is joined to every block that has it.
3. The counts come back to the blocks, where documents sum frequency x count.

A pre-token is dealt out at most once a block, so a frequent one is a vanishing part of what is dealt (one of all that the block
holds), no table grows with the number of its occurrences, and buckets, whose number follows the data, are even. Nothing is broadcast. Blocks are written once, so a lost
executor's work is done again from the same blocks.

Texts are first cut at white space, where the pre-tokenizer cuts too; its own rule then cuts each distinct part of a block.
Strings of special tokens inside a text are one token each, the library's default; they are cut out before anything else.

Edge cases: a null or empty text has no bytes and no tokens; a null doc_id is kept; repeated rows give a row each, as
equal rows have equal results there are no ties; an empty table gives an empty one; a word of any length is one or
more pre-tokens; a text above the block's size is a block by itself; the input's other columns are not read, those in
`keep` come back in the struct `row`, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import kept_in_worker, packed, staged, unpacked
from turnstile.llm.token_files import PIECE, RUN

#: UTF-8 bytes of text in a block; pre-tokens of all blocks in a bucket; pre-tokens that the tokenizer gets at once.
BLOCK_BYTES, BUCKET_TOKENS, BATCH = 8_000_000, 500_000, 2000


def byte_level(tokenizer_json: str) -> list[str]:
    """The special strings of a byte-level BPE file; other kinds of tokenizers are refused."""
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    odd = [t for t in spec.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE" or odd:
        raise ValueError("token counts need a byte-level BPE tokenizer without a normalizer")
    return sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)


class _Numbers(dict):
    """Numbers for keys, in the order in which they are met."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens))


def _strings(tokens: list[bytes]) -> bytes:
    return packed(np.fromiter(map(len, tokens), np.uint32, len(tokens)), np.frombuffer(b"".join(tokens), np.uint8))


def _array(raw: bytes) -> pa.Array:
    """The strings of _strings()."""
    lengths, data = unpacked(raw)
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data))


#: Numbers of the empty word and of the line end.
EMPTY, LINE_END = 0, 1


class _Block:
    """Documents whose texts are together about BLOCK_BYTES long.

    A text is words, each either with a blank before it or plain: part 2 * number of the word + 1 if plain.
    """

    def __init__(self) -> None:
        self.numbers, self.rows, self.n_bytes, self.fixed = _Numbers({"": EMPTY, "\n": LINE_END}), [], [], []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def _numbered(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def _cut(self, text: str) -> np.ndarray:
        """The parts of a text cut at white space: a blank goes with what follows it."""
        if RUN.search(text):
            parts = PIECE.findall(text)
            plain = np.fromiter((not p.startswith(" ") for p in parts), np.int64, len(parts))
            return 2 * self._numbered([p[1:] if p[0] == " " else p for p in parts]) + plain
        words = self._numbered(text.replace("\n", " \n ").split(" "))
        plain = words == LINE_END
        plain[1:] |= plain[:-1]
        plain[0] = True
        parts = 2 * words + plain
        return parts[parts != 2 * EMPTY + 1]

    def add(self, row: pa.Array, text: str, special: re.Pattern | None) -> None:
        segments = special.split(text) if special else [text]
        n = len(text.encode())
        self.rows.append(row), self.n_bytes.append(n), self.fixed.append(len(segments) - 1)
        self.parts.append(np.concatenate([self._cut(s) for s in segments]) if len(segments) > 1 else self._cut(text))
        self.size += n

    def batch(self, cut) -> pa.RecordBatch:
        known, numbered = np.unique(np.concatenate(self.parts), return_inverse=True)
        doc = np.repeat(np.arange(len(self.parts)), [len(p) for p in self.parts])
        cells, often = np.unique(doc * len(known) + numbered, return_counts=True)
        kinds = np.bincount(cells // max(1, len(known)), minlength=len(self.parts))
        # Differences of sorted numbers are small, which compression makes use of.
        column, first = cells % max(1, len(known)), np.cumsum(kinds)[:-1][kinds[1:] > 0]
        index = np.diff(column, prepend=0)
        index[first] = column[first]
        words, tokens = list(self.numbers), _Numbers()
        of_part = [[tokens[x] for x in cut(words[k >> 1] if k & 1 else " " + words[k >> 1])] for k in known.tolist()]
        lengths = np.fromiter(map(len, of_part), np.int64, len(of_part))
        raw = [x.encode() for x in tokens]
        order = np.argsort(_hashes(raw), kind="stable")
        place = np.empty(len(raw), np.int64)
        place[order] = np.arange(len(raw))
        flat = place[np.fromiter(chain.from_iterable(of_part), np.int64, int(lengths.sum()))]
        values = {
            "block": (uuid.uuid4().int >> 65, pa.int64()), "n_bytes": (self.n_bytes, pa.list_(pa.int64())), "fixed": (self.fixed, pa.list_(pa.int64())),
            "matrix": (packed(*(a.astype("<u4") for a in (kinds, index, often, lengths, flat))), pa.binary()), "n_tokens": (len(raw), pa.int64()), "tokens": (_strings([raw[k] for k in order.tolist()]), pa.binary()),
        }
        rows = pa.ListArray.from_arrays([0, len(self.rows)], pa.concat_arrays(self.rows))
        return pa.RecordBatch.from_arrays([rows, *[pa.array([v], t) for v, t in values.values()]], ["rows", *values])


def _blocks(tokenizer_json: str, specials: list[str], block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        pre = Tokenizer.from_str(tokenizer_json).pre_tokenizer
        cut = lambda part: [part[a:b] for _, (a, b) in pre.pre_tokenize_str(part)]
        found = re.compile("|".join(map(re.escape, specials))) if specials else None
        block = _Block()
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text")
            for k in range(len(texts)):
                block.add(rows.slice(k, 1), texts[k].as_py() or "", found)
                if block.size >= block_bytes:
                    yield block.batch(cut)
                    block = _Block()
        if block.rows:
            yield block.batch(cut)

    return run


def _dealer(buckets: int):
    """A block's pre-tokens, which stand in order of their hashes, in a row for each bucket of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = _array(raw).cast(pa.large_binary()).to_pylist()
                bucket = _hashes(tokens) * buckets >> 32
                edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(tokens)]
                if tokens:
                    parts = [(int(bucket[i]), block, i, _strings(tokens[i:j])) for i, j in zip(edges, edges[1:], strict=False)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), kinds, strict=True)], ["bucket", "block", "start", "tokens"])

    return run


def _counter(tokenizer_json: str):
    """The counts of a bucket's pre-tokens, of which all blocks' equal ones are in the same bucket."""

    def run(table: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = kept_in_worker(f"counter-{zlib.crc32(tokenizer_json.encode())}", lambda: Tokenizer.from_str(tokenizer_json))
        arrays = [_array(raw) for raw in table.column("tokens").to_pylist()]
        once = pa.concat_arrays(arrays).dictionary_encode()
        distinct = once.dictionary.to_pylist()
        n = np.array([len(e) for i in range(0, len(distinct), BATCH) for e in tokenizer.encode_batch_fast(distinct[i : i + BATCH], add_special_tokens=False)], np.uint32)
        counts, ends = n[once.indices.to_numpy()], np.cumsum([len(a) for a in arrays])
        out = [packed(x) for x in np.split(counts, ends[:-1])]
        return pa.table({"block": table.column("block"), "start": table.column("start"), "counts": pa.array(out, pa.binary())})

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    starts = lambda lengths: np.concatenate(([0], np.cumsum(lengths)))
    for batch in batches:
        for k in range(batch.num_rows):
            at = lambda name, k=k: batch.column(name)[k]
            kinds, index, often, lengths, flat = (a.astype(np.int64) for a in unpacked(at("matrix").as_py()))
            parts = sorted(at("found").as_py() or [], key=lambda x: x["start"])
            of_token = np.concatenate([np.zeros(0, np.int64), *[unpacked(x["counts"])[0].astype(np.int64) for x in parts]])
            of_part = np.diff(starts(of_token[flat])[np.cumsum(lengths)], prepend=0)
            to, run = starts(kinds), np.cumsum(index)
            # Differences begin anew with each document: take off what the sum held before it.
            number = run - np.repeat(np.concatenate(([0], run))[to[:-1]], kinds)
            n = np.diff(starts(of_part[number] * often)[to]) + np.array(at("fixed").values)
            yield pa.RecordBatch.from_arrays([at("rows").values, at("n_bytes").values, pa.array(n, pa.int64())], ["row", "n_bytes", "n_tokens"])


def counted(docs: DataFrame, tokenizer_file: str, keep: list[str], text: str = "text", limit: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (struct of the columns `keep`), n_bytes, n_tokens, over_limit of every document."""
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's file; it travels to the tasks with the job
        tokenizer_json = f.read()
    specials = byte_level(tokenizer_json)
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text].alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    schema = f"rows array<{row_type}>, block long, n_bytes array<long>, fixed array<long>, matrix binary, n_tokens long, tokens binary"
    blocks = staged(rows.mapInArrow(_blocks(tokenizer_json, specials, block_bytes), schema), "token-count-blocks")

    spark = docs.sparkSession
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_TOKENS + 1)
    dealt = blocks.select("block", "tokens").mapInArrow(_dealer(buckets), "bucket long, block long, start long, tokens binary")
    once = dealt.groupBy("bucket").applyInArrow(_counter(tokenizer_json), "block long, start long, counts binary")
    # A list a block: no more rows than the block has pre-tokens, whose number its bytes bound.
    found = once.groupBy("block").agg(F.collect_list(F.struct("start", "counts")).alias("found"))
    whole = blocks.drop("tokens", "n_tokens").join(found, "block", "left")
    summed = whole.select("rows", "n_bytes", "fixed", "matrix", "found").mapInArrow(_sums, f"row {row_type}, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
