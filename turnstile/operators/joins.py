"""Joins that stock planning turns into nested loops, or whose null rules need care.

No join here carries a broadcast hint: Spark broadcasts a side when its measured size is under
spark.sql.autoBroadcastJoinThreshold and shuffles it otherwise, and AQE splits hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def _on(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _slot(date: Column, days: int) -> Column:
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / F.lit(days))


def band_join(left: DataFrame, right: DataFrame, value: str, band_start: str, width, on=()) -> DataFrame:
    """Left rows whose value lies in [band_start, band_start + width) of a right row.

    Every value is filed under floor(value / width); a band touches at most two such slots, so the
    band rows are written twice and the join becomes an equi-join with a residual test.
    """
    slot = "__slot"
    lefts = left.withColumn(slot, F.floor(F.col(value) / F.lit(width)).cast("long"))
    first = F.floor(F.col(band_start) / F.lit(width)).cast("long")
    last = F.ceil((F.col(band_start) + F.lit(width)) / F.lit(width)).cast("long") - F.lit(1)
    rights = right.withColumn(slot, F.explode(F.sequence(first, last)))
    joined = lefts.join(rights, [*_on(on), slot])
    return joined.filter(
        (F.col(value) >= F.col(band_start)) & (F.col(value) < F.col(band_start) + F.lit(width))
    ).drop(slot)


def _by_slot(intervals: DataFrame, start: str, end: str, dates: DataFrame, date: str, days: int, slot: str) -> DataFrame:
    """Each interval once per calendar slot it shares with the span of the dates, so that open ends cost nothing."""
    span = dates.agg(F.min(F.to_date(date)).alias("low"), F.max(F.to_date(date)).alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    met = intervals.filter((F.col(start) <= F.col(end)) & (F.to_date(start) <= high) & (F.to_date(end) >= low))
    first, last = F.greatest(F.to_date(start), low), F.least(F.to_date(end), high)
    return met.withColumn(slot, F.explode(F.sequence(_slot(first, days), _slot(last, days))))


def interval_join(left: DataFrame, right: DataFrame, date: str, start: str, end: str, on, days: int = 32, dates: DataFrame | None = None) -> DataFrame:
    """Left rows whose date lies in a right row's closed interval, by key and calendar slot.

    Both ends of the interval must be known. Only intervals that share the slot of the date are met.
    `dates`: a frame with the column `date` that spans the left rows' dates and is cheaper to read than they are.
    """
    slot = "__slot"
    lefts = left.withColumn(slot, _slot(F.col(date), days))
    rights = _by_slot(right, start, end, left if dates is None else dates, date, days, slot)
    return lefts.join(rights, [*_on(on), slot]).filter(F.col(date).between(F.col(start), F.col(end))).drop(slot)


def not_in_interval(left: DataFrame, blackout: DataFrame, date: str, start: str, end: str, on, days: int = 32, dates: DataFrame | None = None) -> DataFrame:
    """Left rows with no closed interval of the same key around their date.

    Both sides carry the calendar slot of the date, so that a key with many rows and many intervals is
    still compared slot by slot. Intervals of days are cut at their slot's ends and repeats dropped: however
    many overlap, a key and slot keeps at most one per pair of days. `dates` as in `interval_join`.
    """
    keys = _on(on)
    off = blackout.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.col(start).alias("__s"), F.col(end).alias("__e"))
    spanned = left if dates is None else dates
    b = _by_slot(off, "__s", "__e", spanned, date, days, "__b_slot")
    if all(isinstance(f.dataType, DateType) for f in (b.schema["__s"], b.schema["__e"], left.schema[date])):
        slot_start = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("__b_slot") * days).cast("int"))
        b = b.withColumns({"__s": F.greatest("__s", slot_start), "__e": F.least("__e", F.date_add(slot_start, days - 1))})
    b = b.distinct()
    lefts = left.withColumn("__slot", _slot(F.col(date), days))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__b_{k}") for k in keys])
    return lefts.join(b, same & (F.col("__slot") == F.col("__b_slot")) & F.col(date).between(F.col("__s"), F.col("__e")), "left_anti").drop("__slot")


def product_join(left: DataFrame, right: DataFrame, on, rows: int = 4_000_000, weight: Column | None = None) -> DataFrame:
    """Equi-join of few keys, each with many rows on both sides, in tasks that put out about `rows` rows each.

    Both sides may be small while their product is not, so that neither bytes nor keys tell how many tasks it takes. The product of a
    key is cut into tiles, as square as the sides allow: left rows are dealt to shares and repeated for each strip, right rows are dealt
    to strips and repeated for each share, so that neither side is repeated as often as there are tiles. `weight`: what a
    right row counts for, if more than one. Both sides are read twice.
    """
    keys = _on(on)
    counted = F.lit(1) if weight is None else F.coalesce(weight, F.lit(1))
    n = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    m = right.groupBy(*keys).agg(F.sum(counted).alias("__m"), F.count("*").alias("__rows"))
    product = F.col("__n") * F.col("__m")
    tiles = F.greatest(F.ceil(product / F.lit(rows)), F.lit(1))
    strips = F.greatest(F.least(F.ceil(F.col("__m") / F.lit(rows**0.5)), tiles, "__rows"), F.lit(1)).cast("int")
    sizes = n.join(m, keys).select(*keys, "__n", product.alias("__product"), tiles.alias("__tiles"), strips.alias("__strips"))
    sizes = sizes.select(*keys, "__product", "__strips", F.least(F.ceil(F.col("__tiles") / F.col("__strips")), "__n").cast("int").alias("__shares"))
    tasks = 1 + int(sizes.agg(F.coalesce(F.sum(F.col("__product").cast("double")), F.lit(0.0))).first()[0] // rows)
    sizes = sizes.drop("__product")
    mark = lambda df, count: F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - F.lit(1)))
    dealt = left.join(sizes, keys).withColumn("__share", mark(left, "__shares")).withColumn("__strip", each("__strips")).drop("__shares", "__strips")
    repeated = right.join(sizes, keys).withColumn("__strip", mark(right, "__strips")).withColumn("__share", each("__shares")).drop("__shares", "__strips")
    # A number of partitions that is asked for is not joined up again by size in bytes. Both sides ask, as either may be the one that is not broadcast.
    deal = lambda df: df.repartition(min(2 * tasks, 20_000), *keys, "__share", "__strip")
    return deal(dealt).join(deal(repeated), [*keys, "__share", "__strip"]).drop("__share", "__strip")


def any_key_join(target: DataFrame, source: DataFrame, keys: list[str], target_id: str, source_id: str, on=()) -> DataFrame:
    """Pairs (target_id, source_id) that agree on at least one of several keys.

    A union of equi-joins in place of an OR condition; null keys never match.
    """
    scope = _on(on)
    pairs = [
        target.filter(F.col(k).isNotNull()).select(target_id, *scope, k)
        .join(source.filter(F.col(k).isNotNull()).select(source_id, *scope, k), [*scope, k])
        .select(target_id, source_id)
        for k in keys
    ]
    return reduce(DataFrame.unionByName, pairs).distinct()


def fallback_key_join(left: DataFrame, right: DataFrame, keys: list[str], pair: tuple[str, str], keep: list[str]) -> DataFrame:
    """Match on the first key, then on the second for pairs the first did not find.

    `pair` names the left and the right id; `keep` the columns of the result besides them.
    """
    wanted = [*pair, *keep]

    def match(key):
        drop = [k for k in keys if k != key]
        r = right.filter(F.col(key).isNotNull()).drop(*drop)
        return left.filter(F.col(key).isNotNull()).join(r, key).select(*wanted)

    found = match(keys[0])
    for key in keys[1:]:
        more = match(key).join(found.select(*pair).distinct(), list(pair), "left_anti")
        found = found.unionByName(more)
    return found


def left_lookup(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left join of which the left rows without a key, as they match nothing, are not shuffled."""
    keys = _on(on)
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    found = left.filter(known).join(right, keys, "left")
    return found.unionByName(left.filter(~known).select(*keys, *[c for c in left.columns if c not in keys]), allowMissingColumns=True)


def apply_agg(outer: DataFrame, inner: DataFrame, on, aggs: dict[str, Column], zero: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate of the matching inner rows next to every outer row.

    Aggregates named in `zero` (counts) read 0 where nothing matches; sums stay null.
    """
    keys = _on(on)
    totals = inner.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    joined = outer.join(totals, keys, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in zero}) if zero else joined


def apply_top1(outer: DataFrame, inner: DataFrame, on, order: list[Column]) -> DataFrame:
    """First inner row in a total order next to every outer row."""
    from turnstile.operators.windows import keep_first

    keys = _on(on)
    return outer.join(keep_first(inner, keys, order), keys, "left")


def full_coalesce(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Full join in which the left side's values win."""
    renamed = b.select(*on, *[F.col(v).alias(f"__r_{v}") for v in values])
    joined = a.select(*on, *values).join(renamed, on, "full")
    return joined.select(*on, *[F.coalesce(F.col(v), F.col(f"__r_{v}")).alias(v) for v in values])


def hashed_lookup(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows whose long text equals a looked-up text, found by fingerprint and then re-checked."""
    from turnstile.functions.scalars import fingerprint

    wanted = keys.select(F.col(col).alias("__text"), fingerprint(col).alias("__print")).distinct()
    return (
        rows.withColumn("__print", fingerprint(col))
        .join(wanted, "__print")
        .filter(F.col(col) == F.col("__text"))
        .drop("__print", "__text")
    )


def fully_allocated(base: DataFrame, mods: DataFrame, key, value: str, total=100) -> DataFrame:
    """Keys whose base share plus the sum of their modifiers is exactly the total."""
    keys = _on(key)
    extra = mods.groupBy(*keys).agg(F.sum(value).alias("__extra"))
    return (
        base.join(extra, keys, "left")
        .filter(F.col(value) + F.coalesce(F.col("__extra"), F.lit(0)) == total)
        .select(*keys)
        .distinct()
    )
