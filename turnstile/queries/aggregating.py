"""Aggregates, sorts and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import merge as mg
from turnstile.operators import sets
from turnstile.queries.base import query
from turnstile.queries.joining import NET, _net


@query("agg_sum_key", "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS gross FROM lineitem GROUP BY l_orderkey")
def agg_sum_key(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("gross"))


@query("agg_sum_expr", f"SELECT l_returnflag, l_linestatus, CAST(sum({NET}) AS DOUBLE) AS net FROM lineitem GROUP BY ALL")
def agg_sum_expr(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum(_net()).cast("double").alias("net"))


@query("agg_count_key", "SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def agg_count_key(t):
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("agg_min_key", "SELECT p_brand, p_type, min(p_retailprice) AS min_price FROM part GROUP BY p_brand, p_type")
def agg_min_key(t):
    return t.part.groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("min_price"))


@query("agg_max_watermark", """
SELECT coalesce(max(CASE WHEN event_type = 'signup' THEN ts END), TIMESTAMP '2018-01-01') AS signup_mark,
       coalesce(max(CASE WHEN event_type = 'absent' THEN ts END), TIMESTAMP '2018-01-01') AS absent_mark FROM events
""")
def agg_max_watermark(t):
    start = X.clock("2018-01-01")
    mark = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("ts"))), start)
    return t.events.agg(mark("signup").alias("signup_mark"), mark("absent").alias("absent_mark"))


@query("agg_coalesce_min", """
SELECT o_custkey, CASE WHEN min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) IS NOT NULL
  THEN min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) ELSE min(o_totalprice) END AS price FROM orders GROUP BY o_custkey
""")
def agg_coalesce_min(t):
    booked = F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return t.orders.groupBy("o_custkey").agg(F.coalesce(booked, F.min("o_totalprice")).alias("price"))


@query("agg_having", "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey HAVING sum(l_linenumber) = 10")
def agg_having(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("total")).filter(F.col("total") == 10)


@query("agg_group_dedup", "SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL")
def agg_group_dedup(t):
    return t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus").distinct()


@query("agg_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def agg_distinct(t):
    return t.events.select("user_id", "event_type").distinct()


@query("alloc_prorate", """
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                  sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / total AS part_of_order, (l_quantity / total) * l_extendedprice AS share FROM q
""")
def alloc_prorate(t):
    totals = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    part = F.col("l_quantity") / F.col("total")
    return t.lineitem.join(totals, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", part.alias("part_of_order"),
        (part * F.col("l_extendedprice")).alias("share"),
    )


@query("avail_two_level", """
WITH sold AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
     held AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A' GROUP BY 1),
     brand AS (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS capacity FROM part GROUP BY 1),
     brand_sold AS (SELECT p_brand, CAST(sum(n) AS BIGINT) AS n FROM sold JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT p_partkey, p.p_brand, p_size - coalesce(s.n, 0) - coalesce(h.n, 0) AS part_left, b.capacity - coalesce(bs.n, 0) AS brand_left
FROM part p JOIN brand b USING (p_brand) LEFT JOIN sold s ON s.l_partkey = p_partkey LEFT JOIN held h ON h.l_partkey = p_partkey
LEFT JOIN brand_sold bs ON bs.p_brand = p.p_brand
WHERE p_size - coalesce(s.n, 0) - coalesce(h.n, 0) > 0 AND b.capacity - coalesce(bs.n, 0) > 0
""")
def avail_two_level(t):
    # Both counts of the fact come from one pass.
    used = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count_if(F.col("l_linestatus") == "F").alias("sold"),
        F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")).alias("held"),
    )
    parts = t.part.select("p_partkey", "p_brand", "p_size").join(used, "p_partkey", "left")
    brands = parts.groupBy("p_brand").agg((F.sum("p_size") - F.sum(F.coalesce("sold", F.lit(0)))).alias("brand_left"))
    left = F.col("p_size") - F.coalesce("sold", F.lit(0)) - F.coalesce("held", F.lit(0))
    return (
        parts.join(brands, "p_brand").withColumn("part_left", left)
        .filter((F.col("part_left") > 0) & (F.col("brand_left") > 0))
        .select("p_partkey", "p_brand", "part_left", "brand_left")
    )


@query("avail_capacity", """
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, CAST(floor(abs(s_acctbal) - 12.5) AS INTEGER) - coalesce(n, 0) AS available_capacity
FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey
""")
def avail_capacity(t):
    taken = t.lineitem.filter(F.col("l_returnflag") == "R").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t.supplier.join(taken, "s_suppkey", "left").select(
        "s_suppkey", (F.floor(F.abs("s_acctbal") - 12.5).cast("int") - F.coalesce("n", F.lit(0))).alias("available_capacity")
    )


@query("fee_reconcile", f"""
WITH x AS (SELECT l_orderkey, round(sum({NET}), 2) AS net FROM lineitem GROUP BY 1),
     o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,6)) END AS total FROM orders)
SELECT o_orderkey, CAST(CASE WHEN total < net THEN net ELSE total END AS DOUBLE) AS total FROM o JOIN x ON l_orderkey = o_orderkey
""")
def fee_reconcile(t):
    net = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(X.money(F.round(F.sum(_net()), 2)).alias("net"))
    stored = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, X.money(F.col("o_totalprice"))).alias("total"))
    return mg.raise_only(stored.join(net, "o_orderkey"), "total", "net").select("o_orderkey", F.col("total").cast("double").alias("total"))


@query("math_row_total", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + CASE WHEN l_linenumber <> 5 THEN CAST(l_quantity AS DECIMAL(12,2)) END + CAST(l_tax AS DECIMAL(12,2)) AS DOUBLE) AS total
FROM lineitem
""")
def math_row_total(t):
    part = lambda c: F.col(c).cast("decimal(12,2)")
    total = part("l_extendedprice") + F.when(F.col("l_linenumber") != 5, part("l_quantity")) + part("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", total.cast("double").alias("total"))


@query("math_round", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(-1 * {NET}, 2) AS DOUBLE) AS net FROM lineitem")
def math_round(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(_net() * F.lit(-1), 2).cast("double").alias("net"))


@query("math_abs", "SELECT c_custkey, abs(c_acctbal) AS size, abs(c_acctbal) = c_acctbal AS not_negative FROM customer")
def math_abs(t):
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("size"), (F.abs("c_acctbal") == F.col("c_acctbal")).alias("not_negative"))


@query("math_floor", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS whole FROM customer")
def math_floor(t):
    return t.customer.select("c_custkey", F.floor("c_acctbal").alias("whole"))


@query("math_decimal", """
SELECT o_orderkey, CAST(-1 * CAST(o_totalprice AS DECIMAL(18,6)) AS DOUBLE) AS negated,
       CAST(CAST(CAST(o_totalprice AS DECIMAL(18,6)) * 3 AS DECIMAL(18,6)) AS DOUBLE) AS tripled,
       o_totalprice / 4 * 3 AS prorated, CAST(o_orderkey AS DOUBLE) / 2 AS half_key FROM orders
""")
def math_decimal(t):
    price = X.money(F.col("o_totalprice"))
    return t.orders.select(
        "o_orderkey", (price * F.lit(-1)).cast("double").alias("negated"), X.money(price * F.lit(3)).cast("double").alias("tripled"),
        (F.col("o_totalprice") / 4 * 3).alias("prorated"), (F.col("o_orderkey").cast("double") / 2).alias("half_key"),
    )


@query("sort_report", """
SELECT CAST(o_orderdate AS DATE) AS transaction_date, o_orderkey AS invoice_number, o_totalprice AS price FROM orders
ORDER BY 1, 2
""")
def sort_report(t):
    return t.orders.select(
        F.to_date("o_orderdate").alias("transaction_date"), F.col("o_orderkey").alias("invoice_number"), F.col("o_totalprice").alias("price")
    ).orderBy("transaction_date", "invoice_number")


@query("set_union_all", """
SELECT 'sale' AS kind, l_orderkey, l_extendedprice AS amount FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT 'return', l_orderkey, -l_extendedprice FROM lineitem WHERE l_returnflag = 'R'
""")
def set_union_all(t):
    # Branches over one table and disjoint filters are one scan with a conditional projection.
    returned = F.col("l_returnflag") == "R"
    return t.lineitem.select(
        F.when(returned, "return").otherwise("sale").alias("kind"), "l_orderkey",
        F.when(returned, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("amount"),
    )


@query("set_union_distinct", "SELECT s_nationkey AS nation, s_suppkey % 10 AS grp FROM supplier UNION SELECT c_nationkey, c_custkey % 10 FROM customer")
def set_union_distinct(t):
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("grp")).distinct()
    c = t.customer.select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("grp")).distinct()
    return s.unionByName(c).distinct()


@query("set_rowset_diff", """
WITH a AS (SELECT l_orderkey, l_returnflag FROM lineitem), b AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem),
     ab AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), ba AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT l_orderkey, l_returnflag, 'missing' AS side, count(*) AS copies FROM ab GROUP BY 1, 2
UNION ALL SELECT l_orderkey, l_returnflag, 'extra', count(*) FROM ba GROUP BY 1, 2
""")
def set_rowset_diff(t):
    a = t.lineitem.select("l_orderkey", "l_returnflag")
    b = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") == 7, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    return sets.rowset_diff(a, b)
