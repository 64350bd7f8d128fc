"""Phrase collocation mining with weighted acyclic automata.

1. Texts of a language are put together into blocks (shards) of bounded size: a block's distinct words, their counts, and
   the sequence of its words with a break at each separator.
2. Word counts are summed over blocks. A phrase with `min_count` occurrences has words with as many, so words below it
   become breaks; the others get numbers, which come back to the blocks by a join.
3. Each shard sorts its n-grams (the up to five words from each position to the next break) and builds an automaton from
   them, n-gram by n-gram: what one shares with the one before it is there already. It is cut by prefix range and dealt.
4. Of each range the shards' automata are united and the weights of equal paths added up. The sum over a prefix is the
   count of that phrase, whatever follows; a prefix whose n-grams lie in two ranges is added up over both.
5. The phrases counted are united by range into automata again; each cut of a candidate is composed with those that hold its
   two parts, which gives their counts.

Ranges are cut at quantiles of a sample of n-grams whose size is a parameter (`SAMPLE`, 4 for each range). The sample decides where rows go and nothing
else. A frequent phrase is one path a shard, so that copies and hot words do not load a range. Nothing is broadcast but the
bounds of the ranges, at most `MOST_RANGES`; no count or candidate is sampled or capped.

Edge cases: a null or empty text has no words; a null language is `und`; ties are broken by score, count and phrase in
byte order of UTF-8; an empty table gives an empty one; repeated rows count each; other columns are not read, whatever their
names; a text longer than a block is cut at a separator; control characters other than separators belong to words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import packed, staged, unpacked

#: Fixed values of the contract.
LONGEST, MIN_COUNT, FIRST, PER_MILLE, UNKNOWN = 5, 100, 2000, 1000, "und"
#: A-Z to a-z, separators of pieces to line feeds, blanks between words to spaces.
SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")

#: UTF-8 bytes of text in a block; n-grams in a range; ranges at most (their bounds travel with the job, 40 bytes each);
#: n-grams in the sample that bounds them, or so many for each range.
BLOCK_BYTES, RANGE_GRAMS, MOST_RANGES, SAMPLE, SAMPLE_RANGE = 8_000_000, 1_000_000, 1_000_000, 20_000, 4


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their weights; rows are labels from 1, filled up with 0."""
    if not len(paths):
        return paths, weights
    bits = max(1, int(paths.max()).bit_length())
    a_key = max(1, 63 // bits)
    keys = []
    for first in range(0, paths.shape[1], a_key):
        key = np.zeros(len(paths), np.int64)
        for column in paths[:, first : first + a_key].T:
            key = key << bits | column.astype(np.int64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(paths), bool)
    new[0] = True
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    starts = np.flatnonzero(new)
    return paths[order[starts]], np.add.reduceat(weights[order], starts)


class Automaton:
    """A deterministic acyclic automaton with a weight on each accepted path, built from sorted paths.

    `labels` are the sorted words it knows. On each level stand the arcs in order of their paths: the label's number (from 1),
    the arc of the level above from which it goes on, and the weight of the path that ends with it (0: none does).
    """

    def __init__(self, labels: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.labels, self.levels = labels, levels

    @classmethod
    def build(cls, labels: np.ndarray, paths: np.ndarray, weights: np.ndarray) -> Automaton:
        """paths: distinct rows in order. A row adds the arcs behind what it shares with the row before it."""
        levels, fresh, parent = [], np.zeros(len(paths), bool), np.zeros(len(paths), np.int64)
        fresh[:1] = True
        for depth in range(paths.shape[1]):
            column = paths[:, depth]
            fresh[1:] |= column[1:] != column[:-1]
            there = fresh & (column != 0)
            if not there.any():
                break
            arc = np.cumsum(there) - 1
            ends = column != 0
            if depth + 1 < paths.shape[1]:
                ends = ends & (paths[:, depth + 1] == 0)
            weight = np.zeros(int(there.sum()), np.int64)
            weight[arc[ends]] = weights[ends]
            levels.append((column[there].astype(np.int64), parent[there], weight))
            parent = arc
        return cls(labels, levels)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows of words filled up with -1, weights) of all accepted paths."""
        rows, weights, above = [], [], np.zeros((1, 0), np.int64)
        for label, parent, weight in self.levels:
            above = np.column_stack([above[parent], self.labels[label - 1]])
            ends = weight > 0
            rows.append(np.pad(above[ends], ((0, 0), (0, LONGEST - above.shape[1])), constant_values=-1))
            weights.append(weight[ends])
        return (np.concatenate(rows), np.concatenate(weights)) if rows else (np.zeros((0, LONGEST), np.int64), np.zeros(0, np.int64))

    def compose(self, queries: np.ndarray) -> np.ndarray:
        """The weights of paths, rows of words filled up with -1; 0 where a path is not accepted."""
        state, out, alive = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.ones(len(queries), bool)
        for depth, (label, parent, weight) in enumerate(self.levels):
            word = queries[:, depth]
            alive = alive & (word >= 0)
            at = np.minimum(np.searchsorted(self.labels, word), len(self.labels) - 1)
            alive = alive & (self.labels[at] == word)
            width = len(self.labels) + 1
            arcs, sought = parent * width + label, state * width + at + 1
            arc = np.minimum(np.searchsorted(arcs, sought), len(arcs) - 1)
            alive = alive & (arcs[arc] == sought)
            state = np.where(alive, arc, state)
            last = (queries[:, depth + 1] < 0) if depth + 1 < queries.shape[1] else np.ones(len(queries), bool)
            out = np.where(alive & last, weight[state * alive], out)
        return out

    def to_bytes(self) -> bytes:
        return packed(self.labels.astype("<u8"), *[a.astype("<u8" if k == 2 else "<u4") for level in self.levels for k, a in enumerate(level)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Automaton:
        labels, *arrays = (a.astype(np.int64) for a in unpacked(raw))
        return cls(labels, [tuple(arrays[k : k + 3]) for k in range(0, len(arrays), 3)])


def united(automata: list[Automaton]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, sorted paths as label numbers, weights) of the union; weights of equal paths are added up."""
    parts = [a.paths() for a in automata]
    rows, weights = np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])
    labels = np.unique(rows)
    labels = labels[labels >= 0]
    return labels, *summed(np.where(rows < 0, 0, np.searchsorted(labels, rows) + 1), weights)


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _block(lang: str, raw: bytes) -> dict:
    """Distinct words with counts, and the sequence: 0 at a break, else the word's place from 1."""
    numbers = _Numbers({b"": 0, b"\n": 1})
    words = raw.replace(b"\n", b" \n ").split(b" ")
    sequence = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    sequence = sequence[sequence > 0] - 1
    counts = np.bincount(sequence, minlength=len(numbers) - 1)[1:]
    return {"block": uuid.uuid4().hex, "lang": lang, "words": pa.array(list(numbers)[2:], pa.binary()).cast(pa.string()), "counts": counts, "n": int(counts.sum()), "sequence": packed(sequence.astype("<u4"))}


BLOCK = "block string, lang string, words array<string>, counts array<long>, n long, sequence binary"


def _blocks(block_bytes: int):
    def batch(b: dict) -> pa.RecordBatch:
        one = lambda values, kind: pa.ListArray.from_arrays([0, len(values)], pa.array(values, kind))
        columns = [pa.array([b["block"]]), pa.array([b["lang"]]), pa.ListArray.from_arrays([0, len(b["words"])], b["words"]), one(b["counts"], pa.int64()), pa.array([b["n"]]), pa.array([b["sequence"]], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for rows in batches:
            texts, langs = rows.column("text").cast(pa.large_binary()), rows.column("lang").to_pylist()
            for k, lang in enumerate(langs):
                raw, at = (texts[k].as_py() or b"").translate(SIGNS), 0
                while at < len(raw):  # long texts in parts that end at a separator
                    end = raw.rfind(b"\n", at, at + block_bytes) + 1 or raw.find(b"\n", at + block_bytes) + 1 or len(raw)
                    end = len(raw) if len(raw) - at <= block_bytes else end
                    held.setdefault(lang, []).append(raw[at:end])
                    size[lang] = size.get(lang, 0) + end - at
                    at = end
                    if size[lang] >= block_bytes or sum(size.values()) >= 4 * block_bytes:
                        full = max(size, key=size.get)
                        yield batch(_block(full, b"\n".join(held.pop(full))))
                        del size[full]
        for lang, parts in held.items():
            yield batch(_block(lang, b"\n".join(parts)))

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of the numbers that frequent words have in all blocks: labels, and label numbers with 0 at a break."""
    for batch in batches:
        for k in range(batch.num_rows):
            sequence, = unpacked(batch.column("sequence")[k].as_py())
            numbers, places = np.array(batch.column("numbers")[k].values, np.int64), np.array(batch.column("places")[k].values, np.int64)
            order = np.argsort(numbers)
            of_place = np.zeros(int(sequence.max(initial=0)) + 1, np.int64)
            of_place[places[order] + 1] = np.arange(1, len(order) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([packed(numbers[order].astype("<u8"), of_place[sequence].astype("<u4"))], pa.binary())], ["shard"])


def _grams(sequence: np.ndarray) -> np.ndarray:
    """The up to LONGEST words from each position to the next break; two at least."""
    long = np.concatenate([sequence, np.zeros(LONGEST, sequence.dtype)])
    out = np.empty((len(sequence), LONGEST), np.uint32)
    out[:, 0] = sequence
    for depth in range(1, LONGEST):
        out[:, depth] = np.where(out[:, depth - 1] == 0, 0, long[depth : depth + len(sequence)])
    return out[out[:, 1] != 0]


def _sampler(stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("shard").to_pylist():
                labels, sequence = (a.astype(np.int64) for a in unpacked(raw))
                grams = _grams(sequence)[::stride]
                rows = np.where(grams > 0, np.append(labels, -1)[grams.astype(np.int64) - 1], -1)
                yield pa.RecordBatch.from_arrays([pa.array([packed((rows + 1).ravel().astype("<u8"))], pa.binary())], ["grams"])

    return run


def _range_of(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range in which each row (words filled up with -1) lies: how many bounds are not above it."""
    both = np.concatenate([bounds, rows])
    order = np.lexsort((np.arange(len(both)), *both.T[::-1]))
    is_bound = order < len(bounds)
    found = np.empty(len(both), np.int64)
    found[order] = np.cumsum(is_bound)
    return found[len(bounds) :]


RANGED = "range long, automaton binary"


def _shards(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("shard").to_pylist():
                labels, sequence = (a.astype(np.int64) for a in unpacked(raw))
                grams = _grams(sequence)
                paths, weights = summed(grams, np.ones(len(grams), np.int64))
                edges = [0, *(_places(labels, paths, bounds) if len(paths) else []), len(paths)]
                out = [(r, Automaton.build(*_own_labels(labels, paths[a:b]), weights[a:b]).to_bytes()) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], ["range", "automaton"])

    return run


def _places(labels: np.ndarray, paths: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Where each bound would stand among the sorted paths: halved column by column."""
    columns = np.asfortranarray(paths)
    at = np.searchsorted(labels, bounds)
    known = (at < len(labels)) & (labels[np.minimum(at, len(labels) - 1)] == bounds)
    low, high = np.where(bounds < 0, 0, at + 1), np.where(bounds < 0, 0, np.where(known, at + 1, at))
    out = []
    for least, most in zip(low.tolist(), high.tolist(), strict=True):
        a, b = 0, len(paths)
        for depth in range(LONGEST):
            column = columns[a:b, depth]
            a, b = a + int(np.searchsorted(column, least[depth])), a + int(np.searchsorted(column, most[depth], "right"))
            if a >= b:
                break
        out.append(a)
    return out


def _own_labels(labels: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the labels that the paths hold."""
    used = np.unique(paths)
    used = used[used > 0].astype(np.int64)
    return labels[used - 1], np.where(paths > 0, np.searchsorted(used, paths) + 1, 0)


def _counter(min_count: int):
    def run(table: pa.Table) -> pa.Table:
        labels, paths, weights = united([Automaton.from_bytes(raw) for raw in table.column("automaton").to_pylist()])
        phrases, counts = [], []
        fresh = np.zeros(len(paths), bool)
        fresh[:1] = True
        for depth in range(LONGEST):
            fresh[1:] |= paths[1:, depth] != paths[:-1, depth]
            starts = np.flatnonzero(fresh)
            if depth == 0 or not len(starts):
                continue
            total, there = np.add.reduceat(weights, starts), paths[starts, depth] != 0
            # The first and the last prefix may go on in the ranges beside this one.
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            keep = there & ((total >= min_count) | edge)
            phrases += labels[paths[starts[keep], : depth + 1].astype(np.int64) - 1].tolist()
            counts += total[keep].tolist()
        return pa.table({"phrase": pa.array(phrases, pa.list_(pa.int64())), "a": pa.array(counts, pa.int64())})

    return run


def _filled(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of words as rows filled up with -1."""
    lists = column.to_pylist()
    return np.array([p + [-1] * (LONGEST - len(p)) for p in lists], np.int64).reshape(-1, LONGEST)


def _ranged(bounds: np.ndarray):
    """Adds the range of `phrase`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("range", pa.array(_range_of(_filled(batch.column("phrase")), bounds)))

    return run


def _compose(counted: pa.Table, asked: pa.Table) -> pa.Table:
    """The counts of the parts asked for, from the automaton of a range's counted phrases."""
    rows, weights = _filled(counted.column("phrase")), counted.column("a").to_numpy()
    labels = np.unique(rows)
    labels = labels[labels >= 0]
    paths, weights = summed(np.where(rows < 0, 0, np.searchsorted(labels, rows) + 1), weights)
    found = Automaton.build(labels, paths, weights).compose(_filled(asked.column("phrase")))
    return asked.drop_columns(["phrase", "range"]).append_column("part", pa.array(found))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, range_grams: int = RANGE_GRAMS) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """Frequent words (lang, word, number, a), words of each language (lang, n), frequent phrases (phrase, a), bounds of the ranges."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text].alias("text")).where("text <> ''")
    blocks = staged(rows.mapInArrow(_blocks(block_bytes), BLOCK), "collocation-blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    held = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "held")).select("block", "lang", "place", "held.words", "held.counts")
    frequent = held.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("a")).where(F.col("a") >= min_count)
    words = staged(frequent.withColumn("number", F.monotonically_increasing_id()), "collocation-words")
    # A list a block: as long as its distinct words, whose number its bytes bound.
    met = held.join(words.select("lang", F.col("word").alias("words"), "number"), ["lang", "words"], "left")
    back = met.groupBy("block").agg(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("place", "number"))).alias("back")).select("block", F.col("back.place").alias("places"), F.col("back.number").alias("numbers"))
    shards = staged(blocks.select("block", "sequence").join(back, "block").select("sequence", "places", "numbers").mapInArrow(_numbered, "shard binary"), "collocation-shards")

    # One row: how many words there are.
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    wished = int(min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_grams + 1)))
    sample = shards.mapInArrow(_sampler(size // max(SAMPLE, SAMPLE_RANGE * wished) + 1), "grams binary").collect()
    picked = np.concatenate([np.zeros(0, np.int64), *[unpacked(r["grams"])[0].astype(np.int64) - 1 for r in sample]]).reshape(-1, LONGEST)
    picked = picked[np.lexsort(picked.T[::-1])]
    bounds = picked[np.linspace(0, len(picked), wished, endpoint=False).astype(int)[1:]] if len(picked) else picked
    bounds = np.unique(bounds, axis=0)

    dealt = shards.mapInArrow(_shards(bounds), RANGED)
    # A range holds about range_grams n-grams at most, of which equal ones are one path a shard.
    counted = dealt.groupBy("range").applyInArrow(_counter(min_count), "phrase array<long>, a long")
    phrases = staged(counted.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count), "collocation-phrases")
    return words, totals, phrases, bounds


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, first: int = FIRST, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    words, totals, phrases, bounds = phrase_counts(docs, text, lang, min_count, **sizes)
    # A longer phrase as frequent as one inside it: one word more at either end is enough, as counts fall with length.
    longer = phrases.where(F.size("phrase") > 2).select("a", F.explode(F.array(F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase) - 1)"))).alias("phrase"))
    inside = longer.groupBy("phrase").agg(F.max("a").alias("most"))
    candidates = phrases.join(inside, "phrase", "left").where("most IS NULL OR 100 * most < 100 * a").select("phrase", "a")

    whole = phrases.select("phrase", "a").union(words.select(F.array("number").alias("phrase"), "a"))
    counted = whole.mapInArrow(_ranged(bounds), "phrase array<long>, a long, range long")
    cuts = candidates.select(F.col("phrase").alias("whole"), "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    parts = cuts.select("whole", "a", "k", F.posexplode(F.array(F.expr("slice(whole, 1, k)"), F.expr("slice(whole, k + 1, size(whole) - k)"))).alias("side", "phrase"))
    asked = parts.mapInArrow(_ranged(bounds), "whole array<long>, a long, k int, side int, phrase array<long>, range long")
    found = counted.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(_compose, "whole array<long>, a long, k int, side int, part long")
    weighed = found.groupBy("whole", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("part"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part"))).alias("r"))

    # Words of a phrase belong to one language, which its numbers tell.
    spelt = candidates.select("phrase", F.posexplode("phrase").alias("place", "number")).join(words.select("number", "word", "lang"), "number").groupBy("phrase").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("spelt"), F.first("lang").alias("lang"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = weighed.join(spelt, F.col("whole") == F.col("phrase")).join(totals, "lang").withColumn("score", F.call_function("div", F.lit(PER_MILLE).cast("decimal(38,0)") * wide("a") * wide("n"), wide("l") * wide("r")))
    lowest = scored.groupBy("lang", "spelt", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = lowest.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "spelt"))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("spelt").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
