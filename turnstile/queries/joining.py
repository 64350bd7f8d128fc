"""Joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import joins as jn
from turnstile.operators import windows as win
from turnstile.queries.base import query
from turnstile.sources import rows as src


def _net():
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return price * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(4,2)"))


NET = "CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2)))"


@query("join_star_inner", f"""
SELECT r_name, CAST(sum({NET}) AS DOUBLE) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name
""")
def join_star_inner(t):
    # The fact is summed per order before it meets the dimensions.
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(_net()).alias("net"), F.count("*").alias("n"))
    return (
        per_order.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy("r_name")
        .agg(F.sum("net").cast("double").alias("revenue"), F.sum("n").alias("lines"))
    )


@query("join_left_enrich", """
SELECT o_orderstatus, count(*) AS rows_out, count(l_orderkey) AS with_line, count(*) - count(l_orderkey) AS without_line
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus
""")
def join_left_enrich(t):
    joined = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(
        F.count("*").alias("rows_out"), F.count("l_orderkey").alias("with_line"),
        (F.count("*") - F.count("l_orderkey")).alias("without_line"),
    )


@query("join_left_on_cond", """
SELECT o_orderkey, count(l_orderkey) AS returned FROM orders
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey
""")
def join_left_on_cond(t):
    condition = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_returnflag") == "R")
    return t.orders.join(t.lineitem, condition, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("returned"))


@query("join_left_then_filter", """
WITH seventh AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 END AS deleted FROM lineitem WHERE l_linenumber = 7)
SELECT o_orderkey, l_orderkey IS NOT NULL AS matched FROM orders LEFT JOIN seventh ON l_orderkey = o_orderkey WHERE deleted IS NULL
""")
def join_left_then_filter(t):
    # Unmatched rows have a null stamp as well and stay; only deleted matches go.
    seventh = t.lineitem.filter(F.col("l_linenumber") == 7).select(
        "l_orderkey", F.when(F.col("l_returnflag") == "R", 1).alias("deleted")
    ).distinct()
    joined = t.orders.join(seventh, F.col("l_orderkey") == F.col("o_orderkey"), "left").filter(F.col("deleted").isNull())
    return joined.select("o_orderkey", F.col("l_orderkey").isNotNull().alias("matched"))


@query("join_full_coalesce", """
WITH s AS (SELECT s_nationkey AS nation, s_suppkey % 7 AS grp, min(s_acctbal) AS amount FROM supplier GROUP BY 1, 2),
     c AS (SELECT c_nationkey AS nation, c_custkey % 11 AS grp, min(c_acctbal) AS amount FROM customer GROUP BY 1, 2)
SELECT coalesce(s.nation, c.nation) AS nation, coalesce(s.grp, c.grp) AS grp, coalesce(s.amount, c.amount) AS amount
FROM s FULL JOIN c ON s.nation = c.nation AND s.grp = c.grp
""")
def join_full_coalesce(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("grp")).agg(F.min("s_acctbal").alias("amount"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 11).alias("grp")).agg(F.min("c_acctbal").alias("amount"))
    return jn.full_coalesce(s, c, ["nation", "grp"], ["amount"])


SETTINGS = [(1, "on"), (2, "weekly"), (3, "usd"), (4, "none")]


@query("join_cross_settings", """
WITH settings(id, default_value) AS (VALUES (1, 'on'), (2, 'weekly'), (3, 'usd'), (4, 'none')),
     overrides AS (SELECT n_regionkey AS brand_id, n_nationkey % 4 + 1 AS setting_id, min(n_name) AS value FROM nation
                   WHERE n_nationkey % 3 = 0 GROUP BY 1, 2)
SELECT r.r_regionkey AS brand_id, s.id AS setting_id, coalesce(o.value, s.default_value) AS value
FROM region r CROSS JOIN settings s LEFT JOIN overrides o ON o.brand_id = r.r_regionkey AND o.setting_id = s.id
""")
def join_cross_settings(t):
    settings = src.literal_rows(t.spark, SETTINGS, "setting_id int, default_value string")
    overrides = t.nation.filter(F.col("n_nationkey") % 3 == 0).groupBy(
        F.col("n_regionkey").alias("brand_id"), (F.col("n_nationkey") % 4 + 1).alias("setting_id")
    ).agg(F.min("n_name").alias("value"))
    # Every brand carries the fixed list of settings: an explode of an array, not a cross join.
    defaults = F.array(*[F.struct(F.lit(i).alias("setting_id"), F.lit(v).alias("default_value")) for i, v in SETTINGS])
    grid = t.region.select(F.col("r_regionkey").alias("brand_id"), F.inline(defaults))
    known = settings.select("setting_id")
    return grid.join(known, "setting_id", "left_semi").join(overrides, ["brand_id", "setting_id"], "left").select(
        "brand_id", "setting_id", F.coalesce("value", "default_value").alias("value")
    )


@query("join_band_hour", """
WITH e AS (SELECT event_id, CAST(hour(ts) + minute(ts) / 60.0 AS DOUBLE) AS h FROM events),
     slots AS (SELECT s_suppkey AS slot_id, CAST(s_suppkey % 24 AS DOUBLE) + CASE WHEN s_suppkey % 5 = 0 THEN 0.5 ELSE 0 END AS start_hour FROM supplier)
SELECT slot_id, count(*) AS events FROM e JOIN slots ON h >= start_hour AND h < start_hour + 1 GROUP BY slot_id
""")
def join_band_hour(t):
    e = t.events.select("event_id", (F.hour("ts") + F.minute("ts") / F.lit(60.0)).cast("double").alias("h"))
    slots = t.supplier.select(
        F.col("s_suppkey").alias("slot_id"),
        ((F.col("s_suppkey") % 24).cast("double") + F.when(F.col("s_suppkey") % 5 == 0, 0.5).otherwise(0.0)).alias("start_hour"),
    )
    # Equal times of day are one row before they meet the slots.
    times = e.groupBy("h").agg(F.count("*").alias("n"))
    return jn.band_join(times, slots, "h", "start_hour", 1.0).groupBy("slot_id").agg(F.sum("n").alias("events"))


@query("join_interval_or_default", """
WITH tpl AS (SELECT n_nationkey AS park, n_nationkey * 10 + 1 AS template, DATE '1996-01-01' + CAST(n_nationkey * 20 AS INTEGER) AS s,
                    DATE '1996-01-01' + CAST(n_nationkey * 20 + 400 AS INTEGER) AS e FROM nation
             UNION ALL SELECT n_nationkey, n_nationkey * 10 + 2, NULL, NULL FROM nation),
     o AS (SELECT DISTINCT o_custkey % 25 AS park, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o.park, o.d AS date, tpl.template FROM o JOIN tpl ON tpl.park = o.park
 AND ((tpl.s <= o.d AND tpl.e >= o.d) OR (tpl.s IS NULL AND tpl.e IS NULL))
""")
def join_interval_or_default(t):
    dated = t.nation.select(
        F.col("n_nationkey").cast("long").alias("park"), (F.col("n_nationkey") * 10 + 1).alias("template"),
        F.date_add(X.day("1996-01-01"), F.col("n_nationkey") * 20).alias("s"),
        F.date_add(X.day("1996-01-01"), F.col("n_nationkey") * 20 + 400).alias("e"),
    )
    default = t.nation.select(F.col("n_nationkey").cast("long").alias("park"), (F.col("n_nationkey") * 10 + 2).alias("template"))
    days = t.orders.select((F.col("o_custkey") % 25).alias("park"), F.to_date("o_orderdate").alias("date")).distinct()
    # The two arms exclude each other, so no row needs removing after the union.
    in_time = jn.interval_join(days, dated, "date", "s", "e", "park").select("park", "date", "template")
    return in_time.unionByName(days.join(default, "park").select("park", "date", "template"))


@query("join_theta_ordinal", """
WITH levels AS (SELECT DISTINCT p_size AS ordinal FROM part WHERE p_size % 5 = 0),
     offers AS (SELECT p_brand, p_size, min(p_retailprice) AS price FROM part GROUP BY p_brand, p_size)
SELECT p_brand, ordinal, min(price) AS min_price FROM levels LEFT JOIN offers ON ordinal <= p_size GROUP BY p_brand, ordinal
""")
def join_theta_ordinal(t):
    levels = t.part.filter(F.col("p_size") % 5 == 0).select(F.col("p_size").alias("ordinal")).distinct()
    offers = t.part.groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("price"))
    # An offer serves every level up to its own, so it is written once per level and met by equality.
    reached = offers.select("p_brand", "price", F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("ordinal")).groupBy(
        "p_brand", "ordinal"
    ).agg(F.min("price").alias("min_price"))
    return levels.join(reached, "ordinal", "left").select("p_brand", "ordinal", "min_price")


@query("join_any_key", """
WITH k AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN user_id * 3 END AS seen, user_id AS change_id FROM events),
e AS (SELECT event_id, user_id, event_id AS seen FROM events)
SELECT event_id, change_id FROM e JOIN k USING (user_id) UNION SELECT event_id, change_id FROM e JOIN k USING (seen)
""")
def join_any_key(t):
    keys = t.events.select("user_id").distinct().select(
        "user_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id") * 3).alias("seen"), F.col("user_id").alias("change_id")
    )
    events = t.events.select("event_id", "user_id", F.col("event_id").alias("seen"))
    return jn.any_key_join(events, keys, ["user_id", "seen"], "event_id", "change_id")


@query("join_self_related", """
SELECT a.l_orderkey, count(*) AS pairs, CAST(sum(CAST(b.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS related_price
FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey WHERE a.l_linenumber <> 1 AND b.l_linenumber = 1 GROUP BY a.l_orderkey
""")
def join_self_related(t):
    # Both sides of the self-join are reduced to one row per order before they meet.
    line = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    others = line.filter(F.col("l_linenumber") != 1).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    ones = line.filter(F.col("l_linenumber") == 1).groupBy("l_orderkey").agg(F.count("*").alias("n1"), F.sum("price").alias("p1"))
    return others.join(ones, "l_orderkey").select(
        "l_orderkey", (F.col("n") * F.col("n1")).alias("pairs"), (F.col("p1") * F.col("n")).cast("double").alias("related_price")
    )


@query("join_cast_key", """
WITH texts AS (SELECT CAST(l_orderkey AS VARCHAR) AS key_text, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, lines FROM orders JOIN texts ON CAST(o_orderkey AS VARCHAR) = key_text
""")
def join_cast_key(t):
    texts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines")).select(
        F.col("l_orderkey").cast("string").alias("key_text"), "lines"
    )
    keyed = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("key_text"))
    return keyed.join(texts, "key_text").select("o_orderkey", "lines")


@query("join_fallback_key", """
WITH pay AS (SELECT o_orderkey AS payment_id, CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_orderkey END AS request_id, 'x' || o_custkey AS external_id FROM orders),
     rec AS (SELECT o_orderkey AS recon_id, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey END AS request_id,
                    CASE WHEN o_orderkey % 5 <> 1 THEN 'x' || o_custkey END AS external_id FROM orders WHERE o_orderkey % 4 <> 3),
     first AS (SELECT payment_id, recon_id FROM pay JOIN rec USING (request_id)),
     second AS (SELECT payment_id, recon_id FROM pay JOIN rec USING (external_id))
SELECT payment_id, recon_id FROM first
UNION ALL SELECT payment_id, recon_id FROM second s WHERE NOT EXISTS (
  SELECT 1 FROM first f WHERE f.payment_id = s.payment_id AND f.recon_id = s.recon_id)
""")
def join_fallback_key(t):
    o = t.orders
    tag = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    pay = o.select(
        F.col("o_orderkey").alias("payment_id"), F.when(F.col("o_orderkey") % 3 == 0, tag("r", "o_orderkey")).alias("request_id"),
        tag("x", "o_custkey").alias("external_id"),
    )
    rec = o.filter(F.col("o_orderkey") % 4 != 3).select(
        F.col("o_orderkey").alias("recon_id"), F.when(F.col("o_orderkey") % 2 == 0, tag("r", "o_orderkey")).alias("request_id"),
        F.when(F.col("o_orderkey") % 5 != 1, tag("x", "o_custkey")).alias("external_id"),
    )
    return jn.fallback_key_join(pay, rec, ["request_id", "external_id"], ("payment_id", "recon_id"), [])


@query("join_semi", """
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def join_semi(t):
    returned = t.lineitem.filter(F.col("l_returnflag") == "R")
    return t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("join_anti", """
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def join_anti(t):
    returned = t.lineitem.filter(F.col("l_returnflag") == "R")
    return t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("join_not_in", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def join_not_in(t):
    poor = t.supplier.filter(F.col("s_acctbal") < 0).select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return t.nation.join(poor, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("join_anti_blackout", """
WITH b AS (SELECT s_suppkey, s_nationkey AS nation, DATE '1995-06-01' + CAST(s_suppkey * 13 % 2000 AS INTEGER) AS s,
                  DATE '1995-06-01' + CAST(s_suppkey * 13 % 2000 + 45 AS INTEGER) AS e FROM supplier),
     o AS (SELECT o_orderkey, c_nationkey AS nation, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.nation = o.nation AND o.d BETWEEN b.s AND b.e)
""")
def join_anti_blackout(t):
    blackout = t.supplier.select(
        F.col("s_nationkey").alias("nation"),
        F.date_add(X.day("1995-06-01"), (F.col("s_suppkey") * 13 % 2000).cast("int")).alias("s"),
        F.date_add(X.day("1995-06-01"), (F.col("s_suppkey") * 13 % 2000 + 45).cast("int")).alias("e"),
    )
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("d")
    )
    return jn.not_in_interval(o, blackout, "d", "s", "e", "nation").select("o_orderkey")


@query("join_semi_reduce", f"""
SELECT l_orderkey, CAST(sum({NET}) AS DOUBLE) AS net FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01')
GROUP BY l_orderkey
""")
def join_semi_reduce(t):
    wanted = t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= X.clock("2000-01-01"))).select(
        F.col("o_orderkey").alias("l_orderkey")
    )
    return t.lineitem.join(wanted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sum(_net()).cast("double").alias("net"))


@query("join_hash_prefilter", """
SELECT c_custkey, c_name FROM customer WHERE c_name IN (SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
""")
def join_hash_prefilter(t):
    wanted = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_name")
    return jn.hashed_lookup(t.customer, wanted, "c_name").select("c_custkey", "c_name")


@query("apply_count", """
SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders
""")
def apply_count(t):
    inner = t.lineitem.filter(F.col("l_returnflag") == "R").withColumnRenamed("l_orderkey", "o_orderkey")
    return jn.apply_agg(t.orders.select("o_orderkey"), inner, "o_orderkey", {"returned": F.count("*")}, zero=("returned",))


@query("apply_sum", """
SELECT o_orderkey, CAST((SELECT sum(CAST(l_extendedprice AS DECIMAL(12,2))) FROM lineitem
                         WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS DOUBLE) AS returned_price FROM orders
""")
def apply_sum(t):
    inner = t.lineitem.filter(F.col("l_returnflag") == "R").withColumnRenamed("l_orderkey", "o_orderkey")
    total = F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double")
    return jn.apply_agg(t.orders.select("o_orderkey"), inner, "o_orderkey", {"returned_price": total})


@query("apply_top1", """
SELECT o_orderkey, l_extendedprice AS dearest_price, l_linenumber AS dearest_line, l_partkey AS dearest_part FROM orders
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem) x
ON l_orderkey = o_orderkey AND rn = 1
""")
def apply_top1(t):
    inner = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_linenumber", "l_partkey")
    order = [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey")]
    return jn.apply_top1(t.orders.select("o_orderkey"), inner, "o_orderkey", order).select(
        "o_orderkey", F.col("l_extendedprice").alias("dearest_price"), F.col("l_linenumber").alias("dearest_line"),
        F.col("l_partkey").alias("dearest_part"),
    )


@query("win_rank_keep_one", """
WITH g AS (SELECT p_brand, p_size, p_type, min(p_retailprice) AS min_price, min(p_partkey) AS part_key FROM part GROUP BY 1, 2, 3),
     r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END DESC, min_price, part_key) AS rn FROM g)
SELECT p_brand, p_size, p_type, min_price, part_key FROM r WHERE rn = 1
""")
def win_rank_keep_one(t):
    grouped = t.part.groupBy("p_brand", "p_size", "p_type").agg(F.min("p_retailprice").alias("min_price"), F.min("p_partkey").alias("part_key"))
    order = [(F.col("p_type") == "PROMO").desc(), F.col("min_price"), F.col("part_key")]
    return win.keep_first(grouped, ["p_brand", "p_size"], order)


@query("win_min_keep", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, min(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) x
WHERE l_returnflag <> 'N' OR l_extendedprice = m
""")
def win_min_keep(t):
    kept = win.keep_group_min(t.lineitem, "l_orderkey", "l_extendedprice", when=F.col("l_returnflag") == "N")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("win_any_flag", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any_returned FROM lineitem
""")
def win_any_flag(t):
    marked = win.with_any(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R", "any_returned")
    return marked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "any_returned")


@query("win_latest", """
SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1
""")
def win_latest(t):
    newest = win.keep_first(t.events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()])
    return newest.select("user_id", "event_id", "ts", "event_type")


@query("alloc_fully", """
WITH share AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS base FROM lineitem GROUP BY l_orderkey),
     mods AS (SELECT o_orderkey, CAST(o_custkey % 60 AS BIGINT) AS extra FROM orders WHERE o_orderkey % 2 = 0)
SELECT l_orderkey FROM share LEFT JOIN mods ON o_orderkey = l_orderkey WHERE base + coalesce(extra, 0) = 100
""")
def alloc_fully(t):
    base = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("share"))
    mods = t.orders.filter(F.col("o_orderkey") % 2 == 0).select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 60).alias("share"))
    return jn.fully_allocated(base, mods, "l_orderkey", "share")
