"""Row changes as new table versions, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import filters as flt
from turnstile.operators import joins as jn
from turnstile.operators import merge as mg
from turnstile.operators import windows as win
from turnstile.queries.base import AS_OF, query
from turnstile.session import ensure_checkpoint_dir
from turnstile.sources import sinks


def _price(col="o_totalprice"):
    return F.col(col).cast("decimal(12,2)")


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(1).alias("status"))


CHANGES = """ch AS (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END AS o_orderkey,
   CASE WHEN o_orderkey % 2 = 0 THEN 'Z' END AS o_orderstatus, o_custkey + 1 AS o_custkey FROM orders WHERE o_orderkey % 5 = 0)"""


def _changes(t):
    key = F.col("o_orderkey")
    return t.orders.filter(key % 5 == 0).select(
        (key + F.when(key % 3 == 0, 10000000).otherwise(0)).alias("o_orderkey"),
        F.when(key % 2 == 0, "Z").alias("o_orderstatus"), (F.col("o_custkey") + 1).alias("o_custkey"),
    )


@query("upsert_coalesce", f"""
WITH {CHANGES}
SELECT coalesce(o.o_orderkey, ch.o_orderkey) AS o_orderkey, coalesce(ch.o_custkey, o.o_custkey) AS o_custkey,
       coalesce(ch.o_orderstatus, o.o_orderstatus) AS o_orderstatus, 1 AS status FROM orders o FULL JOIN ch ON ch.o_orderkey = o.o_orderkey
""")
def upsert_coalesce(t):
    return mg.upsert(
        _orders(t), _changes(t), ["o_orderkey"], keep_when_null=["o_custkey", "o_orderstatus"], insert_defaults={"status": F.lit(1)}
    )


@query("upsert_overwrite", f"""
WITH {CHANGES}
SELECT o.o_orderkey, CASE WHEN ch.o_orderkey IS NOT NULL THEN ch.o_custkey ELSE o.o_custkey END AS o_custkey,
       CASE WHEN ch.o_orderkey IS NOT NULL THEN ch.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, 1 AS status
FROM orders o LEFT JOIN ch ON ch.o_orderkey = o.o_orderkey
""")
def upsert_overwrite(t):
    return mg.upsert(_orders(t), _changes(t), ["o_orderkey"], overwrite=["o_custkey", "o_orderstatus"], insert=False)


@query("insert_if_absent", f"""
WITH {CHANGES}
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM ch WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)
""")
def insert_if_absent(t):
    return mg.insert_if_absent(_orders(t).drop("status"), _changes(t), ["o_orderkey"])


@query("void_without_active_child", """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') THEN 1 ELSE 2 END AS status FROM orders
""")
def void_without_active_child(t):
    target = _orders(t)
    live = t.lineitem.filter(F.col("l_returnflag") != "R").select(F.col("l_orderkey").alias("o_orderkey"))
    childless = target.join(live, "o_orderkey", "left_anti").select("o_orderkey")
    return mg.void(target, childless, "o_orderkey", "status", X.clock(AS_OF), "batch")


@query("cascade_void", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 2 ELSE 1 END AS status FROM lineitem
""")
def cascade_void(t):
    children = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(1).alias("status"))
    voided = t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return mg.void(children, voided, "l_orderkey", "status", X.clock(AS_OF), "batch", when=F.col("status") == 1)


@query("soft_delete", f"""
SELECT event_id, user_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 400) AND event_type = 'view'
  THEN TIMESTAMP '{AS_OF}' END AS deleted FROM events
""")
def soft_delete(t):
    target = t.events.select("event_id", "user_id", "event_type", F.lit(None).cast("timestamp_ntz").alias("deleted"))
    ids = t.events.filter((F.col("event_type") == "error") & (F.col("value") > 400)).select("user_id")
    return mg.soft_delete(target, ids, "user_id", X.clock(AS_OF), "batch", when=F.col("event_type") == "view").select("event_id", "user_id", "deleted")


@query("replace_children", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 1, o_custkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus = 'O'
""")
def replace_children(t):
    parents = t.orders.filter(F.col("o_orderkey") % 7 == 0)
    new = parents.filter(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_custkey").alias("l_partkey")
    )
    target = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return mg.replace_children(target, new, parents.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("relink_parent", """
WITH first AS (SELECT l_orderkey, min(l_partkey) AS parent FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 3 AND f.l_orderkey IS NOT NULL THEN f.parent ELSE 0 END AS related
FROM lineitem l LEFT JOIN first f ON f.l_orderkey = l.l_orderkey
""")
def relink_parent(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(0).cast("long").alias("related"))
    parents = rows.filter(F.col("l_linenumber") == 1).groupBy("l_orderkey").agg(F.min("l_partkey").alias("parent"))
    lines, others = rows.filter(F.col("l_linenumber") == 3), rows.filter(F.col("l_linenumber") != 3)
    return mg.relink(lines, "l_orderkey", "related", parents).unionByName(others)


@query("price_keep", """
SELECT p_partkey, CASE WHEN p_partkey % 100 = p_size THEN p_retailprice ELSE p_retailprice + 10 END AS price FROM part
""")
def price_keep(t):
    return t.part.select("p_partkey", X.keep_price(F.col("p_partkey") % 100, "p_size", "p_retailprice", F.col("p_retailprice") + 10).alias("price"))


@query("price_half", """
SELECT p_partkey, CAST(coalesce(CASE WHEN lp = 0 THEN round(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.5 AS DECIMAL(2,1)), 2) ELSE lp END, 0) AS DOUBLE) AS price
FROM (SELECT *, CAST(CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 12.25 END AS DECIMAL(12,2)) AS lp FROM part) x
""")
def price_half(t):
    k = F.col("p_partkey") % 3
    rows = t.part.withColumn("lp", F.when(k == 0, 0).when(k == 1, 12.25).cast("decimal(12,2)")).withColumn("extra", _price("p_retailprice"))
    return rows.select("p_partkey", F.coalesce(X.half_price("lp", "extra"), F.lit(0)).cast("double").alias("price"))


@query("fan_out_children", """
SELECT o_orderkey, 1 AS kind, o_orderkey % 10 AS count FROM orders
UNION ALL SELECT o_orderkey, 2, o_orderkey % 4 FROM orders UNION ALL SELECT o_orderkey, 3, o_orderkey % 3 FROM orders
""")
def fan_out_children(t):
    variant = lambda kind, mod: {"kind": F.lit(kind), "count": F.col("o_orderkey") % mod}
    return mg.fan_out(t.orders, ["o_orderkey"], [variant(1, 10), variant(2, 4), variant(3, 3)])


@query("backfill_fk", """
WITH d AS (SELECT o_orderkey, 'Line ' || min(o_custkey % 7 + 1) AS description, max(o_custkey) AS discount_id FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN d.discount_id END AS discount_id
FROM lineitem LEFT JOIN d ON d.o_orderkey = l_orderkey AND d.description = 'Line ' || l_linenumber
""")
def backfill_fk(t):
    line = lambda n: F.concat(F.lit("Line "), n.cast("string"))
    discounts = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), line(F.col("o_custkey") % 7 + 1).alias("description"), F.col("o_custkey").alias("discount_id"))
    details = t.lineitem.withColumn("description", line(F.col("l_linenumber")))
    return details.join(discounts, ["l_orderkey", "description"], "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("discount_id")).alias("discount_id")
    )


@query("insert_cross_docs", """
SELECT c_custkey, d.doc_id FROM customer JOIN (SELECT s_suppkey AS doc_id, s_nationkey AS park, s_suppkey % 8 AS kind FROM supplier) d
ON d.park = c_nationkey WHERE d.kind IN (3, 4, 5, 7)
""")
def insert_cross_docs(t):
    docs = t.supplier.filter((F.col("s_suppkey") % 8).isin(3, 4, 5, 7)).select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").alias("c_nationkey"))
    return jn.product_join(t.customer.select("c_custkey", "c_nationkey"), docs, "c_nationkey").select("c_custkey", "doc_id")


@query("rule_zeroing", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_retailprice END AS price, CASE WHEN p_type = 'PROMO' THEN false ELSE p_size > 5 END AS is_taxable FROM part
""")
def rule_zeroing(t):
    return t.part.select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"),
        X.iif(F.col("p_type") == "PROMO", F.lit(False), F.col("p_size") > 5).alias("is_taxable"),
    )


@query("rule_fee_presence", """
WITH fee AS (SELECT l_orderkey AS o_orderkey, max(l_suppkey) AS fee FROM lineitem WHERE l_linenumber = 4 GROUP BY 1),
     o AS (SELECT o_orderkey, o_orderkey % 4 AS base, o_orderkey % 3 AS extra FROM orders)
SELECT o.o_orderkey, coalesce(fee.fee, 0) AS fee FROM o LEFT JOIN fee USING (o_orderkey)
WHERE (fee.fee IS NOT NULL AND NOT (base = 0 AND extra = 0)) OR (fee.fee IS NULL AND base <> 0)
""")
def rule_fee_presence(t):
    events = t.orders.select("o_orderkey", (F.col("o_orderkey") % 4).alias("base"), (F.col("o_orderkey") % 3).alias("extra"))
    fees = t.lineitem.filter(F.col("l_linenumber") == 4).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_suppkey").alias("fee"))
    without = events.filter((F.col("base") == 0) & (F.col("base") + F.col("extra") == 0)).select("o_orderkey")
    kept = fees.join(events, "o_orderkey", "left_semi").join(without, "o_orderkey", "left_anti")
    added = events.filter(F.col("base") != 0).join(fees, "o_orderkey", "left_anti").select("o_orderkey", F.lit(0).cast("long").alias("fee"))
    return kept.unionByName(added)


@query("split_rejects", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finalised' WHEN o_orderkey % 6 = 0 THEN 'stale' ELSE 'accepted' END AS outcome FROM orders
""")
def split_rejects(t):
    accepted, rejected = flt.split_rejects(
        t.orders, [("finalised", F.col("o_orderstatus") == "F"), ("stale", F.col("o_orderkey") % 6 == 0)]
    )
    return accepted.select("o_orderkey", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("o_orderkey", F.col("reject_reason").alias("outcome"))
    )


@query("audit_totals", """
SELECT o_orderkey, coalesce(base, 0) AS base, coalesce(extra, CAST(o_orderkey % 5 AS BIGINT), 0) AS extra, coalesce(add_on, 0) AS add_on FROM orders LEFT JOIN (
  SELECT l_orderkey, min(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS BIGINT) END) AS base,
    CAST(sum(CASE WHEN l_linenumber IN (2, 3) THEN CAST(l_quantity AS BIGINT) * l_linenumber END) AS BIGINT) AS extra,
    CAST(sum(CASE WHEN l_linenumber > 3 AND l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS add_on FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey
""")
def audit_totals(t):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.when(n == 1, q)).alias("base"), F.sum(F.when(n.isin(2, 3), q * n)).alias("extra"),
        F.sum(F.when((n > 3) & (F.col("l_returnflag") != "R"), q)).alias("add_on"),
    )
    return t.orders.join(totals, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("extra", F.col("o_orderkey") % 5).alias("extra"),
        F.coalesce("add_on", F.lit(0)).alias("add_on"),
    )


@query("entitlement_discount", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(abs((CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_tax AS DECIMAL(4,2))) * CAST(l_quantity AS INTEGER)) AS DOUBLE) AS discount
FROM lineitem WHERE 'Entitlement - ' || l_returnflag LIKE 'Entitlement - R%' AND l_tax > 0 AND l_extendedprice <> 0
""")
def entitlement_discount(t):
    rows = t.lineitem.withColumn("description", F.concat(F.lit("Entitlement - "), "l_returnflag"))
    unit = F.col("l_extendedprice").cast("decimal(12,2)") + F.col("l_tax").cast("decimal(4,2)")
    return rows.filter(F.col("description").like("Entitlement - R%") & (F.abs("l_tax") > 0) & (F.abs("l_extendedprice") > 0)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.abs(unit * F.col("l_quantity").cast("int")).cast("double").alias("discount")
    )


@query("load_run_log", f"""
SELECT TIMESTAMP '{AS_OF}' AS created_on, 'Record(s) Inserted' AS command_type, CAST(count(*) AS INTEGER) AS record_count, 'No Error' AS error_message
FROM events WHERE ts > TIMESTAMP '2024-01-10'
""")
def load_run_log(t):
    """The log of a load, as the load's own write has counted it."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/load-{uuid.uuid4().hex}"
    sinks.logged_load(t.events.filter(F.col("ts") > X.clock("2024-01-10")), f"{folder}/rows/first", f"{folder}/log/first", X.clock(AS_OF), newest="ts")
    return sinks.read_loads(t.spark, f"{folder}/log", sinks.LOG).drop("newest")


@query("newest_change_wins", """
SELECT user_id AS id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id
""")
def newest_change_wins(t):
    target = t.events.select(F.col("user_id").alias("id"), F.lit("none").alias("event_type")).distinct()
    changes = t.events.select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("seq"))
    return mg.upsert(target, changes, ["id"], keep_when_null=["event_type"], sequence="seq")
