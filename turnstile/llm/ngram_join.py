"""N-gram Jaccard join by MinHash banding.

The words of a text are its lower-case runs between white space; its n-gram set holds every run of `n` words (one run
of all words if it has fewer). Two documents are linked when the Jaccard similarity of their sets is `threshold` or
more; a class is what links hold together, named by its least document id.

1. Equal texts: one grouping by a 128-bit hash; the least id stands for all copies from here on.
2. MinHash: rows a band and number of bands follow from threshold and target recall (`choose_bands`).
3. Band hashes are shuffled. Inside a bucket every document is paired with the least one, so a bucket of any size
   gives one pair a document, and the distinct pairs are verified on the full n-gram sets.
4. Links so found make components. Where a bucket still holds several components, all its documents are compared across
   them on their n-gram sets, in blocks of bounded size by products of set matrices that give back the links only: no
   candidate pair is left out unless its two documents are in one class already, and none is written down unless it is a link.
5. Links of each representative: a class whose pairs are all links has them counted already; in the others every two
   members are compared by the same products, which give back a number for each document and no pairs.

Links are between representatives; copies are never expanded into pairs.

Result: doc_id, class_id, n_links: texts of the class, other than the document's own, that are similar enough to it, and
copies: documents with the same text.

Edge cases: null, empty and blank texts have no n-grams, are their own class and have no links; a null doc_id makes a
row of its own without links; rows that repeat an id with the same text count as copies; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import inner_name, maybe_in, staged
from turnstile.llm.components import components

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 256
#: N-grams and documents that are compared in one block.
BLOCK_GRAMS, BLOCK_DOCS = 400_000, 2_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest false candidates, at which a pair at the threshold shares a
    band with probability `recall` and bands times rows stays within `most`."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


class _WordHashes(dict):
    """64-bit hash of a word; the table starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    take = min(n, len(words))
    h = np.zeros(len(words) - take + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(take):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : len(words) - take + 1 + i]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(take)
    return np.unique(h ^ (h >> np.uint64(32)))


def band_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash a band over the least values of its rows' permutations."""
    x = (grams >> np.uint64(16)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            least = np.minimum(least, (x[i : i + 256, None] * a[None, :] + b[None, :]).min(axis=0))
        rows = least.reshape(bands, -1).astype(np.uint64)
        h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows.shape[1]):
            h = ((h ^ (h >> np.uint64(29))) + rows[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _banding(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        hashes = _WordHashes()
        for batch in batches:
            ids, keys, sizes = [], [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                grams = shingles(text, n, hashes)
                if len(grams):
                    ids.append(doc), sizes.append(len(grams)), keys.append(band_hashes(grams, a, b, bands))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ids, np.int64), bands)), pa.array(np.repeat(np.array(sizes, np.int32), bands)), pa.array(np.concatenate(keys))],
                    ["doc", "size", "band"],
                )

    return run


def _similar(n: int, threshold: float):
    """Keeps (a, b) whose whole n-gram sets are similar enough. The set of the text on the right is kept for the next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, other = _WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("a_text"), batch.column("b_text")
            kept = []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, other = b[i], shingles(right[i].as_py(), n, hashes)
                own = shingles(left[i].as_py(), n, hashes)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= threshold * (len(own) + len(other) - both):
                    kept.append(i)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], ["a", "b"])

    return run


def links_across(roots: list[int], grams: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of a block whose roots differ and whose sets are similar enough.

    The sets make a matrix, documents by n-grams; rows of all roots but the most frequent are multiplied with it.
    """
    n = len(roots)
    root, sizes = np.array(roots), np.array([len(g) for g in grams])
    values, counts = np.unique(root, return_counts=True)
    rest = np.flatnonzero(root != values[counts.argmax()])
    if not len(rest):
        return []
    known, column = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    # N-grams of one document only cannot be shared.
    shared = np.bincount(column, minlength=len(known)) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    both = np.zeros((len(rest), n), np.float32)
    for first in range(0, int(shared.sum()), 2048):
        here = (column >= first) & (column < first + 2048)
        part = np.zeros((n, 2048), np.float32)
        part[owner[here], column[here] - first] = 1
        both += part[rest] @ part.T
    total = sizes[rest, None] + sizes[None, :] - both
    i, j = np.nonzero((both >= threshold * total) & (root[rest, None] != root[None, :]))
    return [(int(rest[x]), int(y)) for x, y in zip(i, j, strict=True)]


def _blocks(n: int, threshold: float):
    """Rows sorted by (band, low, high): the links across roots in each such block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, docs, roots, grams = _WordHashes(), None, [], [], []

        def found() -> pa.RecordBatch:
            pairs = links_across(roots, grams, threshold)
            return pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in pairs], pa.int64()), pa.array([docs[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("band", "low", "high")), strict=True)
            texts = batch.column("text")
            for i, (own, doc, root) in enumerate(zip(keys, batch.column("doc").to_pylist(), batch.column("root").to_pylist(), strict=True)):
                if own != key:
                    if len(docs) > 1:
                        yield found()
                    key, docs, roots, grams = own, [], [], []
                docs.append(doc), roots.append(root), grams.append(shingles(texts[i].as_py(), n, hashes))
        if len(docs) > 1:
            yield found()

    return run


def counts_of_links(docs: list[int], sides: list[bool], grams: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block with links, and how many: those between its two sides or, where all are on one, among them."""
    side, sizes = np.array(sides), np.array([len(g) for g in grams])
    left, right = (np.flatnonzero(side), np.flatnonzero(~side)) if side.any() and not side.all() else (np.arange(len(docs)),) * 2
    known, column = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(len(docs)), sizes)
    shared = np.bincount(column, minlength=len(known)) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(shared.sum()), 2048):
        here = slice(*np.searchsorted(column, [first, first + 2048]))
        part = np.zeros((len(docs), 2048), np.float32)
        part[owner[here], column[here] - first] = 1
        both += part[left] @ part[right].T
    ids, number = np.unique(np.array(docs, np.int64), return_inverse=True)
    linked = (both >= threshold * (sizes[left, None] + sizes[None, right] - both)) & (number[left, None] != number[None, right])
    if len(ids) < len(docs):
        # Rows that repeat an id are one document.
        i, j = np.nonzero(linked)
        i, j = np.unique(np.stack([number[left[i]], number[right[j]]]), axis=1)
        counts = np.bincount(i, minlength=len(ids)) + (np.bincount(j, minlength=len(ids)) if left is not right else 0)
    else:
        counts = np.zeros(len(ids), np.int64)
        counts[number[left]] = linked.sum(axis=1)
        if left is not right:
            counts[number[right]] = linked.sum(axis=0)
    return ids[counts > 0], counts[counts > 0]


def _counted(n: int, threshold: float):
    """Rows sorted by (root, low, high): the links of each such block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, docs, sides, grams = _WordHashes(), None, [], [], []

        def found() -> pa.RecordBatch:
            ids, counts = counts_of_links(docs, sides, grams, threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts, pa.int64())], ["rep", "n_links"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high")), strict=True)
            texts = batch.column("text")
            for i, (block, doc, own) in enumerate(zip(keys, batch.column("doc").to_pylist(), batch.column("own").to_pylist(), strict=True)):
                if block != key:
                    if len(docs) > 1:
                        yield found()
                    key, docs, sides, grams = block, [], [], []
                docs.append(doc), sides.append(own == block[1]), grams.append(shingles(texts[i].as_py(), n, hashes))
        if len(docs) > 1:
            yield found()

    return run


def _shared(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of the keys under which at least two values stand."""
    groups = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low != high")
    groups = staged(groups, "ngram-shared")
    return maybe_in(rows, F.xxhash64(key), groups, F.xxhash64(key)).join(groups, key)


def _verified(pairs: DataFrame, worded: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, from the texts of both; only texts in pairs are shuffled."""
    pairs = staged(pairs.distinct(), "ngram-pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("m"))
    used = maybe_in(worded, F.xxhash64("doc"), members, F.xxhash64("m"))
    left = pairs.join(used.select(F.col("doc").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(used.select(F.col("doc").alias("b"), F.col("text").alias("b_text")), "b")
    return staged(both.select("a", "b", "a_text", "b_text").mapInArrow(_similar(n, threshold), "a long, b long"), "ngram-links")


#: A character that is no white space to str.split().
WORD = r"(?U)[^\s\x1c-\x1f]"


def _worded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").rlike(WORD))


def _parts(size: Column, rows: Column) -> Column:
    """Number of parts that blocks of bounded size ask for."""
    return F.ceil(F.greatest(size / BLOCK_GRAMS, rows / BLOCK_DOCS)).cast("int")


def _dealt(df: DataFrame) -> DataFrame:
    """Adds own, low and high: documents dealt out in `parts` parts, and every two parts meet once."""
    df = df.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return df.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})


def links_and_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """copies (doc, rep) of every document with words; links (a, b) between reps, enough for the classes (node, root) of
    linked reps; sizes (doc, size) of the n-gram sets of all in classes."""
    bands, rows = choose_bands(threshold, recall)
    worded = _worded(docs, doc_id, text)
    hashed = staged(worded.select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")), "ngram-texts")
    least = hashed.groupBy("h1", "h2").agg(F.min("doc").alias("rep"))
    copies = staged(hashed.join(least, ["h1", "h2"]).select("doc", "rep").distinct(), "ngram-copies")

    # All documents but those that only repeat an earlier one.
    later = copies.where("doc != rep").select("doc").join(copies.where("doc = rep").select("doc"), "doc", "left_anti")
    first = maybe_in(worded, F.xxhash64("doc"), later, F.xxhash64("doc"), there=False)
    first = first.unionByName(maybe_in(worded, F.xxhash64("doc"), later, F.xxhash64("doc")).join(later, "doc", "left_anti"))
    buckets = staged(first.mapInArrow(_banding(n, bands, rows), "doc long, size int, band long"), "ngram-bands")

    met = staged(_shared(buckets, "band", "doc"), "ngram-buckets")
    links = _verified(met.where("doc != low").select(F.col("doc").alias("a"), F.col("low").alias("b")), worded, n, threshold)
    classes = staged(components(links), "ngram-classes")

    rooted = met.drop("low", "high").join(classes.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    open_ = staged(_shared(rooted, "band", "root").drop("low", "high"), "ngram-open")
    parts = open_.groupBy("band").agg(_parts(F.sum("size"), F.count("*")).alias("parts"))
    dealt = _dealt(open_.join(parts, "band")).select("band", "doc", "root", "low", "high")
    used = maybe_in(worded, F.xxhash64("doc"), open_, F.xxhash64("doc"))
    filled = dealt.join(used, "doc").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "doc")
    more = staged(filled.select("band", "low", "high", "doc", "root", "text").mapInArrow(_blocks(n, threshold), "a long, b long"), "ngram-links")
    links = links.unionByName(more).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = staged(links, "ngram-all-links")
    return copies, links, staged(components(links), "ngram-classes"), met.groupBy("doc").agg(F.max("size").alias("size"))


def link_counts(worded: DataFrame, links: DataFrame, classes: DataFrame, sizes: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """rep, n_links: how many members of its class are similar enough to each."""
    joined = links.join(classes.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.count("*").alias("known"))
    members = staged(classes.withColumnRenamed("node", "doc").join(sizes, "doc"), "ngram-members")
    totals = members.groupBy("root").agg(F.count("*").alias("n"), _parts(F.sum("size"), F.count("*")).alias("parts"))
    each = staged(members.join(totals.join(joined, "root"), "root"), "ngram-totals")
    whole = F.col("known") == F.expr("n * (n - 1) div 2")
    open_ = each.where(~whole).select("root", "doc", "parts")
    used = maybe_in(worded, F.xxhash64("doc"), open_, F.xxhash64("doc"))
    filled = _dealt(open_).join(used, "doc").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "doc")
    counted = filled.select("root", "low", "high", "own", "doc", "text").mapInArrow(_counted(n, threshold), "rep long, n_links long")
    counted = counted.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    return staged(counted.unionByName(each.where(whole).select(F.col("doc").alias("rep"), (F.col("n") - 1).alias("n_links"))), "ngram-counts")


def _class_of(copies: DataFrame, classes: DataFrame) -> DataFrame:
    """doc, rep and root, the least id of the class, for every row of copies."""
    return copies.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "rep", F.coalesce("root", "rep").alias("root"))


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copies: a row for each row of docs."""
    copies, links, classes, sizes = links_and_classes(docs, doc_id, text, n, threshold, recall)
    degree = link_counts(_worded(docs, doc_id, text), links, classes, sizes, n, threshold)
    size = copies.groupBy("rep").agg(F.count("*").alias("copies"))
    known = _class_of(copies, classes).join(size, "rep").join(degree, "rep", "left")
    known = known.groupBy("doc").agg(F.min("root").alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"), F.max("copies").alias("copies"))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    out = ids.join(known, F.col("doc_id") == F.col("doc"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents but for those whose class has a document with a lesser id; all columns unchanged."""
    copies, _, classes, _ = links_and_classes(docs, doc_id, text)
    least = _class_of(copies, classes).groupBy(F.col("doc").alias("doc_id")).agg(F.min("root").alias("class_id"))
    gone = staged(least.where("doc_id != class_id").select("doc_id"), "ngram-gone")
    key, other = F.xxhash64(F.col(doc_id).cast("long")), F.xxhash64("doc_id")
    kept = maybe_in(docs, key, gone, other, there=False)
    checked = maybe_in(docs, key, gone, other)
    name = inner_name(docs, "_gone")
    return kept.unionByName(checked.join(gone.withColumnRenamed("doc_id", name), checked[doc_id].cast("long") == F.col(name), "left_anti"))
