"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

Words are lower-case runs of word characters. The benchmark is taken in blocks of bounded size (`BLOCK_WORDS`); one
block at a time is sent to the executors, and every document is read once against it:

1. A document and an item of m words match where the best local alignment scores `threshold` times m or more, and at
   least `n` or, for shorter items, m: one for an equal word, minus one for a replaced, extra or missing word. Half a
   score bears edits in one word of four.
2. Seeds are the item's pairs of neighbouring words. An alignment with M equal words and E edits has M - E or more of the
   score s and at most E + 1 runs of equal words, so it holds at least M - E - 1 >= s - 1 of the pairs, within 2 m - s
   words: every alignment that can reach the score has so many seeds, whatever other copies of the item there are.
3. Pairs that many items share (`COMMON_ITEMS`) are not looked up, up to half of the pairs asked for, and so many fewer
   are asked for. Where a document's stretch holds enough seeds of an item, it is aligned with the item.

Result: doc_id, item_id, score, start_word, end_word (word numbers in the document, end exclusive) of every pair found.

Edge cases: null, empty and wordless texts or items match nothing; items shorter than `n` words match only whole;
repeated documents give repeated rows, repeated items their own rows each; an empty benchmark gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import inner_name, maybe_in, staged

#: Least score of a match, and its least share of the item's words.
NGRAM, THRESHOLD = 4, 0.5
#: Items that may share a word pair before it counts as common.
COMMON_ITEMS = 16
#: Words of the benchmark held by an executor at a time, about 50 MB with the look-up tables.
BLOCK_WORDS = 500_000
WORD = re.compile(r"\w+")


class _WordHashes(dict):
    """64-bit hash of a word; the table starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, hashes: dict) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def grams_of(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    if len(w) < n:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : len(w) - n + 1 + i]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(n)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of an item with a stretch of words."""
    m = len(part)
    places = np.arange(m + 1)
    above, from_above = np.zeros(m + 1, np.int64), places.copy()
    best = (0, 0, 0)
    for word in item:
        fits = np.where(part == word, 1, -1)
        score, origin = np.zeros(m + 1, np.int64), places.copy()
        for value, start in ((above[:-1] + fits, from_above[:-1]), (above[1:] - 1, from_above[1:])):
            better = value > score[1:]
            score[1:] = np.where(better, value, score[1:])
            origin[1:] = np.where(better, start, origin[1:])
        # A run of extra words costs one each: the best start to the left, less the distance.
        reach = score + places
        left = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == left, places, 0))
        extended = left - places
        better = extended > score
        origin = np.where(better, origin[source], origin)
        score = np.where(better, extended, score)
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(origin[j]), j)
        above, from_above = score, origin
    return best


class Block:
    """Look-up tables of one block of items."""

    def __init__(self, items: list[tuple], n: int, threshold: float):
        hashes = _WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t or "", hashes) for _, t in items]
        m = np.array([len(w) for w in self.words], dtype=np.int64)
        #: Least score, words that an alignment of that score can span, and seeds that it must hold.
        self.least = np.array([max(math.ceil(threshold * k), min(n, k), 1) for k in m.tolist()], dtype=np.int64)
        self.span = np.maximum(2 * m - self.least, 1)
        self.need = np.maximum(self.least - 1, 1)
        grams, item = [], []
        for k, w in enumerate(self.words):
            g = grams_of(w, min(2, int(self.least[k])))
            grams.append(g), item.append(np.full(len(g), k))
        flat = np.concatenate(grams) if grams else np.empty(0, np.int64)
        item = np.concatenate(item) if item else np.empty(0, np.int64)
        self.sizes = sorted({min(2, int(s)) for s, k in zip(self.least, m, strict=True) if k})
        # How many items share each seed; the most shared ones of an item stay out.
        known, column = np.unique(flat, return_inverse=True)
        pairs = np.unique(np.stack([column, item]), axis=1) if len(flat) else np.empty((2, 0), np.int64)
        shared = np.bincount(pairs[0], minlength=len(known))[column]
        order = np.lexsort((-shared, item))
        rank = np.empty(len(flat), np.int64)
        rank[order] = np.arange(len(flat)) - np.searchsorted(item[order], item[order], "left")
        out = (shared > COMMON_ITEMS) & (rank < self.need[item] // 2)
        self.need -= np.bincount(item[out], minlength=len(m))
        flat, item = flat[~out], item[~out]
        order = np.argsort(flat, kind="stable")
        self.grams, self.item = flat[order], item[order]
        self.known = np.unique(self.grams)
        self.low = np.zeros(1 << 20, bool)
        self.low[self.known & 0xFFFFF] = True

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, seed) of every seed of the block in a text."""
        at, found = [], []
        for n in self.sizes:
            g = grams_of(w, n)
            p = np.flatnonzero(self.low[g & 0xFFFFF])
            k = np.searchsorted(self.known, g[p])
            p = p[(k < len(self.known)) & (self.known[np.minimum(k, len(self.known) - 1)] == g[p])]
            at.append(p), found.append(g[p])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.empty(0, int), np.empty(0, np.int64))

    def matches(self, w: np.ndarray) -> Iterator[tuple]:
        """(item number, score, start, end) of every item found in a text."""
        at, found = self.hits(w)
        if not len(at):
            return
        low, high = np.searchsorted(self.grams, found, "left"), np.searchsorted(self.grams, found, "right")
        # Every hit with every item that has the seed.
        times = high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        # Items are numbered so far apart that a span reaches no other item's places.
        apart = len(w) + int(self.span.max()) + 1
        key = np.sort(self.item[entry] * apart + np.repeat(at, times))
        item = key // apart
        enough = np.searchsorted(key, key + self.span[item], "left") - np.arange(len(key)) >= self.need[item]
        key, item = key[enough], item[enough]
        for own in np.split(np.arange(len(key)), np.flatnonzero(np.diff(item)) + 1) if len(key) else []:
            k = int(item[own[0]])
            place, span = key[own] - k * apart, int(self.span[k])
            best = (0, 0, 0)
            # Stretches that overlap are aligned as one.
            for stretch in np.split(place, np.flatnonzero(np.diff(place) > 2 * span) + 1):
                a = max(0, int(stretch[0]) - span)
                score, s, e = align(self.words[k], w[a : int(stretch[-1]) + span])
                if score > best[0]:
                    best = (score, a + s, a + e)
            if best[0] >= self.least[k]:
                yield (k, best[0] / len(self.words[k]), best[1], best[2])


def _aligned(block, n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = Block(block.value, n, threshold), _WordHashes()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for match in table.matches(word_hashes(text, hashes)):
                    rows.append(i), found.append(match)
            if rows:
                k, score, start, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array(k, pa.int32()), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    ["doc_id", "k", "score", "start_word", "end_word"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of every document that holds a benchmark item or an edited copy of it."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    size = items.agg(F.sum(F.size(F.split("text", r"\W+"))).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / BLOCK_WORDS))
    doc_type, item_type = corpus.schema["doc_id"].dataType, items.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type)]).add("score", "double").add("start_word", "long").add("end_word", "long"))
    for b in range(blocks):
        # A block's size is bounded by the number of blocks, which follows the benchmark's size.
        own = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
        if not own:
            continue
        sent = spark.sparkContext.broadcast(own)
        schema = T.StructType([T.StructField("doc_id", doc_type)]).add("k", "integer").add("score", "double").add("start_word", "long").add("end_word", "long")
        found = corpus.mapInArrow(_aligned(sent, n, threshold), schema)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(i for i, _ in own)], T.StructType().add("k", "integer").add(T.StructField("item_id", item_type)))
        out = out.unionByName(found.join(names, "k").select("doc_id", "item_id", "score", "start_word", "end_word"))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; all columns unchanged."""
    name = inner_name(docs, "_gone")
    gone = staged(contaminated(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(name)).distinct(), "leak-documents")
    key, other = F.xxhash64(F.col(doc_id)), F.xxhash64(name)
    kept = maybe_in(docs, key, gone, other, there=False)
    checked = maybe_in(docs, key, gone, other)
    return kept.unionByName(checked.join(gone, checked[doc_id].eqNullSafe(F.col(name)), "left_anti"))
