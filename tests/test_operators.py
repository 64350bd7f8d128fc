"""Operators against brute force, with one key holding most rows."""

import datetime as dt
import random

from frames import values
from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import documents as doc
from turnstile.operators import joins as jn
from turnstile.operators import merge as mg
from turnstile.operators import sets
from turnstile.operators import windows as win
from turnstile.sources import sinks

R = random.Random(7)
SKEWED = [(0 if R.random() < 0.5 else R.randrange(20), R.randrange(1000) / 10, i) for i in range(3000)]


def skewed(spark):
    return spark.createDataFrame(SKEWED, "k int, v double, id int")


def test_keep_first_limits_groups_before_the_shuffle(spark):
    out = win.keep_first(skewed(spark), "k", [F.col("v"), F.col("id")])
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    best = {}
    for k, v, i in SKEWED:
        best[k] = min(best.get(k, (v, i)), (v, i))
    assert values(out) == sorted(((k, *b) for k, b in best.items()), key=repr)


def test_group_minimum_and_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5), ("a", 5)], "g string, v int")
    assert values(win.keep_group_min(df, "g", "v")) == [("a", 5), ("a", 5), (None, 1)]


def test_band_join_edges(spark):
    left = spark.createDataFrame([(h / 4,) for h in range(100)], "h double")
    right = spark.createDataFrame([(s / 4, s) for s in range(0, 96, 3)], "s double, id int")
    got = {(r["h"], r["id"]) for r in jn.band_join(left, right, "h", "s", 1.0).collect()}
    assert got == {(h / 4, s) for h in range(100) for s in range(0, 96, 3) if s / 4 <= h / 4 < s / 4 + 1}


def test_interval_joins_on_a_hot_key(spark):
    day = lambda i: dt.date(2023, 11, 1) + dt.timedelta(days=i)
    dates = [(0 if i % 2 else i % 5, day(i % 200), i) for i in range(600)]
    spans = [(0 if j % 2 else j % 5, day(j * 7 % 190), day(j * 7 % 190 + j % 80), j) for j in range(60)] + [(0, None, None, 99), (0, day(9), day(3), 98)]
    left = spark.createDataFrame(dates, "k int, d date, id int")
    right = spark.createDataFrame(spans, "k int, s date, e date, span int")
    met = {(i, j) for k, d, i in dates for q, s, e, j in spans if k == q and s and s <= d <= e}
    assert {(r["id"], r["span"]) for r in jn.interval_join(left, right, "d", "s", "e", "k").collect()} == met
    free = {r["id"] for r in jn.not_in_interval(left, right, "d", "s", "e", "k").collect()}
    assert free == {i for _, _, i in dates} - {i for i, _ in met}


def test_open_intervals_make_no_more_slots_than_the_dates_span(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    left = spark.createDataFrame([(1, day(i), i) for i in range(0, 90, 3)], "k int, d date, id int")
    right = spark.createDataFrame([(1, day(30), dt.date(9999, 12, 31), 1), (1, dt.date(1900, 1, 1), day(2), 2), (1, day(400), day(500), 3)], "k int, s date, e date, span int")
    slots = jn._by_slot(right, "s", "e", left, "d", 32, "slot").groupBy("span").count()
    assert dict(values(slots)) == {1: 3, 2: 1}
    met = {(i, 1 if i >= 30 else 2) for i in range(0, 90, 3) if i >= 30 or i <= 2}
    assert {(r["id"], r["span"]) for r in jn.interval_join(left, right, "d", "s", "e", "k").collect()} == met
    assert {r["id"] for r in jn.not_in_interval(left, right, "d", "s", "e", "k").collect()} == set(range(3, 30, 3))
    assert jn.interval_join(left.limit(0), right, "d", "s", "e", "k").count() == 0


def test_overlapping_blackouts_meet_a_row_once_per_pair_of_days(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    left = spark.createDataFrame([(1, day(i), i) for i in range(60)], "k int, d date, id int")
    off = spark.range(3000).selectExpr("1 AS k", "date_add(date'2023-06-01', -cast(id AS int)) AS s", "date_add(date'2024-01-20', cast(id % 2 AS int)) AS e")
    free = jn.not_in_interval(left, off, "d", "s", "e", "k")
    assert {r["id"] for r in free.collect()} == set(range(21, 60))


def test_any_key_ignores_nulls_and_repeats(spark):
    target = spark.createDataFrame([(1, "a", None), (2, None, "y"), (3, "a", "y")], "id int, p string, q string")
    source = spark.createDataFrame([(10, "a", "y"), (11, None, None)], "cid int, p string, q string")
    assert values(jn.any_key_join(target, source, ["p", "q"], "id", "cid")) == [(1, 10), (2, 10), (3, 10)]


def test_fallback_key_without_repeats(spark):
    left = spark.createDataFrame([(1, "r1", "x1"), (2, None, "x2"), (3, "r3", "x3")], "p int, a string, b string")
    right = spark.createDataFrame([(7, "r1", "x1", "d"), (8, None, "x2", "e"), (9, "r3", "x1", "f")], "r int, a string, b string, v string")
    got = values(jn.fallback_key_join(left, right, ["a", "b"], ("p", "r"), ["v"]))
    assert got == [(1, 7, "d"), (1, 9, "f"), (2, 8, "e"), (3, 9, "f")]


def test_a_parent_has_one_row_with_every_child_once(spark):
    parent = spark.createDataFrame([(k,) for k in range(25)], "k int")
    out = {r["k"]: r["c"] for r in doc.collect_children(parent, skewed(spark), "k", ["id"], ["v", "id"], "c").collect()}
    assert len(out) == 25 and all(out[k] is None for k in range(20, 25))
    for k in range(20):
        assert [e["id"] for e in out[k] or []] == [i for _, i in sorted((v, i) for key, v, i in SKEWED if key == k)]


def test_a_parent_of_fifty_thousand_children(spark):
    child = spark.range(50_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    (row,) = doc.collect_children(spark.createDataFrame([(1,)], "k int"), child, "k", ["v"], ["v"], "c").collect()
    assert [e["v"] for e in row["c"]] == list(range(50_000))


def test_derived_ids_tell_keys_apart(spark):
    rows = [("1", None, "2"), ("1", "2", None), ("x|y", "z", ""), ("x", "y|z", ""), ("x", "y", "z"), ("xy", "", "z")]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(X.derived_uuid("a", "b", "c").alias("u"))
    assert df.distinct().count() == len(rows)


def test_ids_do_not_follow_the_partitions(spark):
    rows = spark.range(500).select(F.col("id").alias("n"))
    got = []
    for partitions in ("8", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got.append(values(mg.assign_ids(rows, ["n"], "new")))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1] and sorted(i for _, i in got[0]) == list(range(1, 501))



def test_upsert_is_idempotent_and_last_change_wins(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, n int")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, None, 9, 2), (3, "n", 3, 1)], "id int, v string, n int, seq int")
    once = mg.upsert(target, changes, ["id"], keep_when_null=["v", "n"], sequence="seq")
    assert values(once) == [(1, "a", 9), (2, "b", 2), (3, "n", 3)]
    assert values(mg.upsert(once, changes, ["id"], keep_when_null=["v", "n"], sequence="seq")) == values(once)


def test_assigned_ids_are_dense_and_repeatable(spark):
    df = skewed(spark).select("id")
    start = spark.createDataFrame([(500,)], "m int")
    first = mg.assign_ids(df, ["id"], "new", start, buckets=16)
    assert sorted(r["new"] for r in first.collect()) == list(range(501, 3501))
    assert values(first) == values(mg.assign_ids(df.repartition(5), ["id"], "new", 500, buckets=16))


def test_rowset_diff_sees_moved_nulls(spark):
    """Equal rows in any order give equal digests; a null that moves, also inside an array, does not."""
    schema = "k int, x string, y string, z array<int>"
    rows = [(i, None if i % 3 else "p", "q" if i % 2 else None, [1, None] if i % 5 else None) for i in range(200)]
    a = spark.createDataFrame(rows, schema)
    assert sets.differing_buckets(a, spark.createDataFrame(rows[::-1], schema).repartition(7)).count() == 0
    assert sets.rowset_diff(a, a.select("z", "y", "x", "k"), buckets=5).count() == 0
    moved = [(0, None, "p", None), *rows[1:6], (6, *rows[6][1:3], [None, 1]), *rows[7:], rows[7]]
    got = sets.rowset_diff(a, spark.createDataFrame(moved, schema), buckets=5)
    assert values(got, "k", "side", "copies") == [(0, "extra", 1), (0, "missing", 1), (6, "extra", 1), (6, "missing", 1), (7, "extra", 1)]
    assert sets.differing_buckets(a, spark.createDataFrame(moved, schema)).count() == 5


def test_rowset_diff_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    assert values(sets.rowset_diff(a, b)) == [(1, "missing", 1), (2, "missing", 1), (3, "extra", 1)]


def test_raise_only(spark):
    df = spark.createDataFrame([(None, 5), (3, 5), (5, 5), (7, 5), (1, None)], "t int, s int")
    assert [r["t"] for r in mg.raise_only(df, "t", "s").collect()] == [None, 5, 5, 7, 1]


def test_materialise_survives_in_the_checkpoint_folder(spark):
    kept = sinks.materialise(skewed(spark))
    assert kept.count() == len(SKEWED)
    assert "Scan ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()


def test_product_join_deals_a_hot_key_to_many_tasks(spark):
    """the number of tasks follows the rows put out, not the keys or the bytes."""
    left = spark.range(3000).select("id", F.when(F.col("id") % 50 != 0, F.lit(1)).alias("k"))
    right = spark.range(40).select(F.col("id").alias("other"), F.when(F.col("id") % 4 == 0, F.lit(2)).otherwise(F.lit(1)).alias("k"))
    out = jn.product_join(left, right, "k", rows=5000)
    want = left.join(right, "k")
    assert out.count() == want.count() and out.select("id", "k", "other").exceptAll(want.select("id", "k", "other")).isEmpty()
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < out.count() / 3


def test_product_join_repeats_neither_side_for_each_tile(spark):
    left, right = spark.range(900).selectExpr("cast(id % 2 as int) as k", "id as a"), spark.range(700).selectExpr("cast(id % 2 as int) as k", "id as b")
    odd = spark.createDataFrame([(None, 1), (7, 1)], "k int, a long")
    met = jn.product_join(left.unionByName(odd), right, "k", 1000)
    assert (met.count(), met.distinct().count(), met.filter("a % 2 <> b % 2").count()) == (900 * 350, 900 * 350, 0)
    # 158 tiles a key, each of about 32 rows a side: what is dealt out grows with the sides times the square root of the tiles.
    dealt = [int(n) for n in spread(met)]
    assert max(dealt) < 20_000


def spread(met):
    """Rows that each side deals out to the tiles of a product join."""
    plan, found = met._jdf.queryExecution().optimizedPlan(), []
    jvm = met.sparkSession.sparkContext._jvm
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "RepartitionByExpression":
            found.append(jvm.org.apache.spark.sql.classic.Dataset.ofRows(met.sparkSession._jsparkSession, node.child()).count())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found
