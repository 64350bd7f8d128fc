"""Line de-duplication by a deletion-neighbourhood join.

A line is what "\\n" parts. A line that is not blank goes when an earlier line of the corpus, in the order (doc_id, line
number), equals it, or is as many units or one more or less and one edit away (one unit put in, taken out or replaced).
Units are the words, parted by ASCII white space; in a line without white space that holds more than ASCII, as in scripts
that part no words, its characters. An edit of a short line makes another line: edited ones go only where both lines have
at least `min_words` words or `min_chars` characters. The earliest stays.

1. Equal lines: one grouping by a 128-bit hash finds the earliest place of every distinct line. Only those go on.
2. Screening. One edit leaves the first or the last half of a line untouched, so two neighbours share the hash of a
   half. Halves seen on one line only are dropped; grouping keeps least and greatest line of a half, never a list.
3. Deletion neighbourhood. Each line left emits hashed keys of its variants with one unit deleted, for the half that may
   hold the edit: with the slot, for a replaced unit (all lines with such a key are neighbours of each other, so the
   earliest is a witness for all), and without the slot, to meet whole lines that are one unit shorter. Groups are
   reduced to their earliest places before anything is paired: the work is linear in a group of any size.
4. Each line and its earlier witness are compared unit by unit; hashes alone remove no edited line.

Fixed-size bitmaps (`common.maybe_in`) keep rows that cannot match out of the shuffles.

Edge cases: blank lines stay, so a null, empty or blank text stays as it is; lines of ASCII without white space (addresses,
hashes) go only if equal, and a line of words is no edit of one of characters; rows that share a doc_id count as one document,
so equal lines at the same place do not remove each other; a null doc_id sorts first; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import maybe_in, staged

#: Units that lines need to be compared by edits. Equal lines of any length are found.
MIN_WORDS, MIN_CHARS = 5, 20
#: Told apart from words in hashes: lines of characters count so many units more.
_BY_CHARS = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_BLANKS = "\t\n\x0b\x0c\r "

#: What a line has to emit: variants with the edit in the last or first half, to meet lines as long or lines one unit
#: shorter, and the whole line, to meet longer ones.
SAME_LAST, SAME_FIRST, LONGER_LAST, LONGER_FIRST, WHOLE = 1, 2, 4, 8, 16


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, line_no, line of every line that is not blank."""
    parted = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return parted.where(F.btrim("line", F.lit(_BLANKS)) != "")


def _in_units(lines: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """The lines with their units, as `units_of` has them, what these add to their number, and whether edits count."""
    plain = F.when(F.col("line").rlike(r"[\x09-\x0D]"), F.translate("line", _BLANKS, " " * len(_BLANKS))).otherwise(F.col("line"))
    words = lines.withColumn("words", F.split(plain, " "))
    words = words.withColumn("words", F.when(F.array_contains("words", ""), F.array_remove("words", "")).otherwise(F.col("words")))
    by_chars = (F.size("words") == 1) & (F.octet_length("line") > F.char_length("line"))
    units = words.withColumn("more", F.when(by_chars, _BY_CHARS).otherwise(0)).withColumn("units", F.when(F.col("more") > 0, F.split(F.get("words", F.lit(0)), "")).otherwise(F.col("words")))
    return units.withColumn("edits", F.size("units") >= F.when(F.col("more") > 0, min_chars).otherwise(min_words)).drop("words")


def units_of(line: str) -> list:
    """Words of a line as bytes; characters of a line without white space that holds more than ASCII."""
    words = line.encode().split()
    return list(words[0].decode()) if len(words) == 1 and not line.isascii() else words


def _line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def line_keys(docs: DataFrame, doc_id: str, text: str, min_words: int, min_chars: int) -> DataFrame:
    """at, h1, h2 of every line that is not blank, and the keys of its halves; null: too short for edits.

    p, s: first and last half, for partners of the same length; pl, sl: the same without one unit of the line's length,
    for partners one unit shorter. A key holds the length it stands for.
    """
    n = F.size("units")

    def half(shorter: int, side: int) -> Column:
        size = n - shorter
        first, last = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")
        part = F.slice("units", F.lit(1), first) if side == 0 else F.slice("units", n - last + 1, last)
        return F.when(F.col("edits"), F.xxhash64(F.lit(side), size + F.col("more"), part))

    return _in_units(_lines(docs, doc_id, text), min_words, min_chars).select(
        F.struct("doc", "line_no").alias("at"), *_line_hashes(F.col("line")),
        half(0, 0).alias("p"), half(0, 1).alias("s"), half(1, 0).alias("pl"), half(1, 1).alias("sl"),
    )


def _needs(keys: DataFrame) -> DataFrame:
    """h1, needs: hashes of the lines that share a half with another line, and what these must emit."""
    half_of_hash = F.shiftrightunsigned("h1", 1)
    # The sign tells the longer lines of a key from those as long as it says; the other 63 bits tell lines apart.
    short, longer = half_of_hash, half_of_hash.bitwiseOR(F.lit(-(1 << 63)).cast("long"))
    each = F.array(
        *[
            F.struct(F.col(c).alias("key"), who.alias("who"), F.lit(need).alias("need"))
            for c, who, need in (("p", short, SAME_LAST | WHOLE), ("s", short, SAME_FIRST | WHOLE), ("pl", longer, LONGER_LAST), ("sl", longer, LONGER_FIRST))
        ]
    )
    rows = keys.where("p is not null").select("h1", F.explode(each).alias("k")).select("h1", "k.*")
    groups = rows.groupBy("key").agg(F.min("who").alias("low"), F.max("who").alias("high"))
    # Two longer lines are no pair of this key: they meet under their own length.
    shared = staged(groups.where("low != high and high >= 0"), "line-shared")
    met = maybe_in(rows, F.col("key"), shared, F.col("key")).join(shared, "key")
    need = F.when((F.col("who") >= 0) & (F.col("low") >= 0), F.col("need").bitwiseAND(F.lit(~WHOLE))).otherwise(F.col("need"))
    return met.select("h1", need.alias("need")).groupBy("h1").agg(F.bit_or("need").alias("needs"))


class _UnitHashes(dict):
    """64-bit hash of a unit; the table starts anew when it is full."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def variant_keys(units: list, needs: int, hashes: dict) -> list[tuple[int, np.ndarray]]:
    """(kind, keys): kind 0 a replaced unit, 1 a unit deleted, 2 the whole line.

    A polynomial over the units' hashes gives each variant's hash from the sums before and after the deleted slot.
    """
    n = len(units)
    more = _BY_CHARS if isinstance(units[0], str) else 0
    with np.errstate(over="ignore"):
        w = np.array([hashes[x] for x in units], dtype=np.uint64)
        powers = np.full(n, _ODD, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        terms = w * powers
        sums = np.add.accumulate(terms)
        moved = w[1:] * powers[:-1]  # units after the slot come one place to the front
        after = np.concatenate([np.add.accumulate(moved[::-1])[::-1], np.zeros(1, np.uint64)])
        variants = sums - terms + after
        slots = np.arange(1, n + 1, dtype=np.uint64)

        def mixed(h: np.ndarray, size: int, extra: np.ndarray | int) -> np.ndarray:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) + np.uint64(size + more) * np.uint64(_ODD)
            return ((h + np.asarray(extra, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)) ^ (h >> np.uint64(32))).view(np.int64)

        out = []
        if needs & (SAME_LAST | SAME_FIRST):
            low, high = 0 if needs & SAME_FIRST else n // 2, n if needs & SAME_LAST else n - (n + 1) // 2
            out.append((0, mixed(variants, n, slots)[low:high]))
        if needs & (LONGER_LAST | LONGER_FIRST):
            low, high = 0 if needs & LONGER_FIRST else (n - 1) // 2, n if needs & LONGER_LAST else n - n // 2
            out.append((1, mixed(variants, n - 1, 0)[low:high]))
        if needs & WHOLE:
            out.append((2, mixed(sums[-1:], n, 0)))
    return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _UnitHashes()

    def packed(at: pa.Array, rows: list[int], kinds: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays(
            [at.take(pa.array(np.repeat(rows, sizes))), pa.array(np.repeat(kinds, sizes).astype(np.int32)), pa.array(np.concatenate(keys))], ["at", "kind", "key"]
        )

    for batch in batches:
        at, rows, kinds, keys, held = batch.column("at"), [], [], [], 0
        for i, (line, needs) in enumerate(zip(batch.column("line").to_pylist(), batch.column("needs").to_pylist(), strict=True)):
            for kind, part in variant_keys(units_of(line), needs, hashes):
                rows.append(i), kinds.append(kind), keys.append(part)
                held += len(part)
            if held >= 50_000:
                yield packed(at, rows, kinds, keys)
                rows, kinds, keys, held = [], [], [], 0
        if rows:
            yield packed(at, rows, kinds, keys)


def within_one_edit(a: list, b: list) -> bool:
    """One unit put in, taken out or replaced, at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("line").to_pylist(), batch.column("other_line").to_pylist(), strict=True)
        near = pa.array([within_one_edit(units_of(a), units_of(b)) for a, b in pairs], pa.bool_())
        yield batch.select(["at", "h1"]).filter(near)


def _edited(docs: DataFrame, needs: DataFrame, firsts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """at, h1 of the distinct lines with an earlier neighbour."""
    wanted = staged(needs.join(firsts, "h1").select("first", "h1", "h2", "needs"), "line-wanted")
    lines = _lines(docs, doc_id, text).select(F.struct("doc", "line_no").alias("at"), "line", *_line_hashes(F.col("line")))
    near = maybe_in(lines, F.col("h1"), wanted, F.col("h1"))
    found = near.join(wanted, ["h1", "h2"]).where(F.col("at") == F.col("first")).select("at", "h1", "line", "needs")
    found = staged(found.dropDuplicates(["at", "h1"]), "line-candidates")

    at_type = found.schema["at"].dataType.simpleString()
    variants = staged(found.select("at", "line", "needs").mapInArrow(_emit, f"at {at_type}, kind int, key long"), "line-variants")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    groups = variants.groupBy("key").agg(least(0).alias("same"), F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("last"), least(1).alias("cut"), least(2).alias("whole"))
    groups = staged(groups.where("same != last or (cut is not null and whole is not null)").drop("last"), "line-neighbours")
    witness = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("cut"))
    pairs = maybe_in(variants, F.col("key"), groups, F.col("key")).join(groups, "key").select("at", witness.alias("other")).where("other < at").distinct()
    text = found.select("at", "h1", "line")
    both = pairs.join(text, "at").join(text.select(F.col("at").alias("other"), F.col("line").alias("other_line")), "other")
    return both.select("at", "h1", "line", "other_line").mapInArrow(_verified, f"at {at_type}, h1 long").distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, gone: for each document with lines to remove, their number and hash as "number:hash"."""
    keys = staged(line_keys(docs, doc_id, text, min_words, min_chars), "line-keys")
    firsts = staged(keys.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("copies")), "line-firsts")
    again = firsts.where("copies > 1").select("h1", "h2", "first")
    copies = maybe_in(keys.select("at", "h1", "h2"), F.col("h1"), again, F.col("h1")).join(again, ["h1", "h2"]).where("at > first").select("at", "h1")
    gone = copies.unionByName(_edited(docs, _needs(keys), firsts.drop("copies"), doc_id, text))
    return gone.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_set(F.concat_ws(":", "at.line_no", "h1")).alias("gone"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (all columns of docs), kept_text, n_lines, n_removed; text is unchanged where nothing was removed."""
    gone = staged(removed_lines(docs, doc_id, text, min_words, min_chars), "line-removed")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    hashed = F.xxhash64(F.lit("doc"), "doc")
    members = gone.select(hashed.alias("h"))
    touched = maybe_in(packed.withColumn("_h", hashed), F.col("_h"), members, F.col("h")).drop("_h")
    rest = maybe_in(packed.withColumn("_h", hashed), F.col("_h"), members, F.col("h"), there=False).drop("_h")
    touched = touched.join(gone.withColumnRenamed("doc", "of"), F.col("doc").eqNullSafe(F.col("of")), "left").withColumn("lines", F.split("text", "\n"))
    named = F.transform("lines", lambda x, i: F.concat_ws(":", i, F.xxhash64(x)))
    touched = touched.withColumn("named", named).withColumn("kept", F.array_except("named", F.coalesce("gone", F.array().cast("array<string>"))))
    kept_lines = F.transform("kept", lambda x: F.get(F.col("lines"), F.substring_index(x, ":", 1).cast("int")))
    changed = touched.select(
        "row", F.when(F.size("kept") < F.size("lines"), F.array_join(kept_lines, "\n")).otherwise(F.col("text")).alias("kept_text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
    )
    same = rest.select("row", F.col("text").alias("kept_text"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return changed.unionByName(same)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their texts reduced; those left without a word go. `length` is brought up to date if there."""
    out = deduplicated(docs, doc_id, text, min_words, min_chars).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("kept_text").alias(c)
        if c == length:
            return F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[column(c) for c in docs.columns])
