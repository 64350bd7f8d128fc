"""Row sources, projections and filters over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import filters as flt
from turnstile.queries.base import AS_OF, query
from turnstile.sources import rows as src


@query("src_literal_rows", """
SELECT o_custkey, count(*) AS orders FROM orders
WHERE o_custkey NOT IN (SELECT v FROM (VALUES (1), (7), (13), (101)) AS x(v))
GROUP BY o_custkey
""")
def src_literal_rows(t):
    excluded = src.literal_rows(t.spark, [(1,), (7,), (13,), (101,)], "o_custkey long")
    kept = t.orders.join(excluded, "o_custkey", "left_anti")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("src_date_spine", """
WITH spine AS (
  SELECT DISTINCT e.user_id, CAST(e.ts AS DATE) + CAST(k.i AS INTEGER) AS d
  FROM events e, (VALUES (-2), (-1), (0), (1), (2)) AS k(i))
SELECT user_id, d AS date, dayofweek(d) AS day_of_week FROM spine
""")
def src_date_spine(t):
    active = t.events.select("user_id", F.to_date("ts").alias("center")).distinct()
    return src.date_spine(active, "center", 2, 2).select("user_id", "date", "day_of_week").distinct()


@query("topk_sample", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def topk_sample(t):
    return src.sample_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 1000, ["o_orderkey"])


@query("json_shred_events", """
SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS events FROM events GROUP BY 1
""")
def json_shred_events(t):
    shredded = src.parse_json_rows(t.events.select("event_id", "props"), "props", "k int")
    return shredded.groupBy("k").agg(F.count("*").alias("events"))


@query("json_scalar_events", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id, value FROM events
""")
def json_scalar_events(t):
    return t.events.select("event_id", src.json_field("props", "k", "int").alias("k"), "user_id", "value")


@query("proj_rename", """
SELECT event_id AS id, user_id AS account_id, event_type AS kind, CAST(ts AS DATE) AS created_date,
       CAST(CAST(value AS DECIMAL(18,6)) AS DOUBLE) AS amount FROM events
""")
def proj_rename(t):
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("event_type").alias("kind"),
        F.to_date("ts").alias("created_date"), X.money(F.col("value")).cast("double").alias("amount"),
    )


@query("cast_mix", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS key_text,
       TRY_CAST(substr(c_name, length(c_name) - 3, 4) AS INTEGER) AS tail_number,
       TRY_CAST(c_mktsegment AS INTEGER) IS NULL AS segment_is_text,
       CAST(TRIM(CAST(c_nationkey AS VARCHAR)) AS INTEGER) AS nation FROM customer
""")
def cast_mix(t):
    return t.customer.select(
        "c_custkey", F.col("c_custkey").cast("string").alias("key_text"),
        F.right("c_name", F.lit(4)).try_cast("int").alias("tail_number"),
        F.col("c_mktsegment").try_cast("int").isNull().alias("segment_is_text"),
        F.trim(F.col("c_nationkey").cast("string")).cast("int").alias("nation"),
    )


@query("filter_optional_param", """
SELECT 'all' AS scope, o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'one', o_orderstatus, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus
""")
def filter_optional_param(t):
    def count(scope, priority):
        kept = flt.optional_eq(t.orders, "o_orderpriority", priority)
        return kept.groupBy("o_orderstatus").agg(F.count("*").alias("orders")).select(F.lit(scope).alias("scope"), "*")

    return count("all", None).unionByName(count("one", "1-URGENT"))


@query("filter_flag_toggle", """
SELECT 'with' AS mode, l_linenumber, count(*) AS rows_kept FROM lineitem GROUP BY l_linenumber
UNION ALL
SELECT 'without', l_linenumber, count(*) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_linenumber
""")
def filter_flag_toggle(t):
    def count(mode, only_kept):
        rows = flt.toggled(t.lineitem, only_kept, F.col("l_returnflag") != "R")
        return rows.groupBy("l_linenumber").agg(F.count("*").alias("rows_kept")).select(F.lit(mode).alias("mode"), "*")

    return count("with", False).unionByName(count("without", True))


@query("filter_date_halfopen", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1997-03-31'
""")
def filter_date_halfopen(t):
    kept = flt.between_dates(t.orders, "o_orderdate", "1997-02-01", "1997-03-31")
    return kept.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))


@query("filter_date_local_tz", """
WITH z AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
                     WHEN 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END AS zone FROM events),
     d AS (SELECT event_id, zone, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE zone AS DATE) AS local_day FROM z)
SELECT event_id, zone, local_day FROM d WHERE local_day BETWEEN DATE '2024-01-10' AND DATE '2024-01-11'
""")
def filter_date_local_tz(t):
    zone = (
        F.when(F.col("user_id") % 4 == 0, "Eastern Standard Time").when(F.col("user_id") % 4 == 1, "America/Chicago")
        .when(F.col("user_id") % 4 == 2, "Mountain Standard Time").otherwise("America/Los_Angeles")
    )
    rows = t.events.withColumn("zone", X.iana_zone(zone))
    kept = flt.between_local_dates(rows, "ts", "zone", "2024-01-10", "2024-01-11")
    return kept.select("event_id", "zone", X.local_date("ts", "zone").alias("local_day"))


@query("filter_active", """
SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 10 = 0)
""")
def filter_active(t):
    rows = t.orders.withColumn("deleted", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderdate")))
    return flt.active(rows, "deleted").select("o_orderkey")


@query("filter_code_set", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
""")
def filter_code_set(t):
    kept = t.orders.filter(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return kept.select("o_orderkey", "o_orderstatus")


@query("filter_null_default", "SELECT p_partkey FROM part WHERE coalesce(nullif(p_size, 10), 50) <= 25")
def filter_null_default(t):
    return t.part.filter(F.coalesce(F.nullif(F.col("p_size"), F.lit(10)), F.lit(50)) <= 25).select("p_partkey")


@query("filter_interval_overlap", """
WITH s AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, s AS first_ship, nullif(e, s) AS last_ship FROM s
WHERE s <= DATE '1998-02-28' AND e >= DATE '1998-02-01'
""")
def filter_interval_overlap(t):
    spans = t.lineitem.groupBy("l_orderkey").agg(
        F.to_date(F.min("l_shipdate")).alias("first_ship"), F.to_date(F.max("l_shipdate")).alias("last")
    ).withColumn("last_ship", F.nullif(F.col("last"), F.col("first_ship")))
    window = X.overlaps("first_ship", "last_ship", X.day("1998-02-01"), X.day("1998-02-28"))
    return spans.filter(window).select("l_orderkey", "first_ship", "last_ship")


@query("filter_effective_window", """
WITH w AS (
  SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(o.o_orderdate AS DATE) AS outer_start,
         CASE WHEN l.l_linenumber <> 3 THEN CAST(l.l_shipdate AS DATE) END AS inner_start,
         CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(o.o_orderdate AS DATE) + 90 END AS outer_end,
         CAST(l.l_shipdate AS DATE) + 10 AS inner_end
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM w
WHERE CASE WHEN outer_start < inner_start THEN inner_start ELSE outer_start END <= DATE '1999-06-30'
  AND CASE WHEN outer_end > inner_end THEN inner_end ELSE outer_end END >= DATE '1999-06-01'
""")
def filter_effective_window(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.to_date("o_orderdate").alias("outer_start"),
        F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate")).alias("inner_start"),
        F.when(F.col("o_orderkey") % 5 != 0, F.date_add(F.to_date("o_orderdate"), 90)).alias("outer_end"),
        F.date_add(F.to_date("l_shipdate"), 10).alias("inner_end"),
    )
    return rows.filter(
        (X.effective_start("outer_start", "inner_start") <= X.day("1999-06-30"))
        & (X.effective_end("outer_end", "inner_end") >= X.day("1999-06-01"))
    ).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("filter_hold_ttl", f"""
SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS began FROM events) x
WHERE began IS NULL OR began + INTERVAL 25 MINUTE > TIMESTAMP '{AS_OF}'
""")
def filter_hold_ttl(t):
    holds = t.events.withColumn("began", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    return holds.filter(X.not_expired("began", 25, X.clock(AS_OF))).select("event_id")


@query("filter_start_buffer", f"SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTE >= TIMESTAMP '{AS_OF}'")
def filter_start_buffer(t):
    return t.events.filter(F.col("ts") + X.minutes(30) >= X.clock(AS_OF)).select("event_id")


@query("filter_horizon", """
SELECT e.event_id FROM events e
WHERE CAST(e.ts AS DATE) <= CAST((TIMESTAMP '2023-12-20 02:00:00' AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) + 30
""")
def filter_horizon(t):
    today = X.local_date(X.clock("2023-12-20 02:00:00"), F.lit("America/Chicago"))
    return t.events.filter(F.to_date("ts") <= F.date_add(today, 30)).select("event_id")


@query("filter_like", """
SELECT p_partkey, p_type FROM part
WHERE p_type LIKE 'S%' AND p_name LIKE '%a%' AND p_brand LIKE 'Brand#_%' AND p_type NOT LIKE '_M%'
""")
def filter_like(t):
    return t.part.filter(
        F.col("p_type").like("S%") & F.col("p_name").like("%a%") & F.col("p_brand").like("Brand#_%")
        & ~F.col("p_type").like("_M%")
    ).select("p_partkey", "p_type")


@query("filter_suffix", "SELECT c_custkey FROM customer WHERE right(c_name, 1) = '7'")
def filter_suffix(t):
    return t.customer.filter(F.col("c_name").endswith("7")).select("c_custkey")


@query("filter_not_mine", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS owner FROM events)
SELECT 'keep' AS form, count(*) AS kept FROM e WHERE owner IS NULL OR owner <> 8
UNION ALL SELECT 'drop', count(*) FROM e WHERE owner <> 8
""")
def filter_not_mine(t):
    rows = t.events.select(F.when(F.col("event_id") % 9 != 0, F.col("user_id")).alias("owner"))
    count = lambda form, keep: flt.not_mine(rows, "owner", 8, keep).agg(
        F.lit(form).alias("form"), F.count("*").alias("kept")
    )
    return count("keep", True).unionByName(count("drop", False))


@query("filter_nonzero", """
SELECT l_linenumber, count(*) AS taxed_or_discounted FROM lineitem WHERE l_tax <> 0 OR l_discount <> 0 GROUP BY l_linenumber
""")
def filter_nonzero(t):
    return flt.any_nonzero(t.lineitem, "l_tax", "l_discount").groupBy("l_linenumber").agg(
        F.count("*").alias("taxed_or_discounted")
    )
