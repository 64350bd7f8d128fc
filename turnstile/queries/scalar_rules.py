"""Text, condition, date and key rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import merge as mg
from turnstile.queries.base import AS_OF, query

RAW_NAME_SQL = r"""CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN replace(c_name, '#', '/')
  WHEN 4 THEN replace(c_name, '#', '\') WHEN 5 THEN 'A/B\C' WHEN 6 THEN '/' ELSE c_name END"""


def raw_name():
    k = F.col("c_custkey") % 8
    return (
        F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, "   ")
        .when(k == 3, F.replace("c_name", F.lit("#"), F.lit("/"))).when(k == 4, F.replace("c_name", F.lit("#"), F.lit("\\")))
        .when(k == 5, "A/B\\C").when(k == 6, "/").otherwise(F.col("c_name"))
    )


@query("str_concat_null", f"""
SELECT c_custkey, coalesce(nm, '') || ' ' || coalesce(c_mktsegment, '') AS holder FROM (SELECT c_custkey, c_mktsegment, {RAW_NAME_SQL} AS nm FROM customer) x
""")
def str_concat_null(t):
    return t.customer.withColumn("nm", raw_name()).select("c_custkey", X.concat_nn("nm", F.lit(" "), "c_mktsegment").alias("holder"))


@query("str_concat_plus", f"""
SELECT c_custkey, 'Promotion - ' || nm AS description FROM (SELECT c_custkey, {RAW_NAME_SQL} AS nm FROM customer) x
""")
def str_concat_plus(t):
    return t.customer.withColumn("nm", raw_name()).select("c_custkey", F.concat(F.lit("Promotion - "), "nm").alias("description"))


@query("str_functions", """
SELECT page_id, left(url, 5) AS head, right(url, 4) AS tail, substr(url, 3, 6) AS middle, strpos(url, '/') AS first_slash, reverse(url) AS backwards,
       regexp_extract(url, '([^/]*)$', 1) AS file_name,
       CASE WHEN strpos(url, '/') > 0 THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS directory, length(rtrim(url)) AS len FROM pages
""")
def str_functions(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", F.left(url, F.lit(5)).alias("head"), F.right(url, F.lit(4)).alias("tail"), F.substring(url, 3, 6).alias("middle"),
        F.locate("/", url).alias("first_slash"), F.reverse(url).alias("backwards"), X.after_last(url, "/").alias("file_name"),
        X.before_last(url, "/").alias("directory"), F.length(F.rtrim(url)).alias("len"),
    )


@query("clean_names", rf"""
SELECT c_custkey, CASE WHEN strpos(nm, '/') > 0 THEN replace(nm, '/', '') WHEN strpos(nm, '\') > 0 THEN replace(nm, '\', '')
   WHEN nm IS NULL OR rtrim(nm) = '' THEN 'Customer' ELSE nm END AS stripped,
   CASE WHEN nm IS NULL OR rtrim(nm) = '' THEN 'Customer' ELSE nm END AS plain
FROM (SELECT c_custkey, {RAW_NAME_SQL} AS nm FROM customer) x
""")
def clean_names(t):
    rows = t.customer.withColumn("nm", raw_name())
    return rows.select("c_custkey", X.clean_name("nm").alias("stripped"), X.clean_name("nm", strip_slashes=False).alias("plain"))


@query("valid_emails", """
SELECT c_custkey, CASE WHEN coalesce(regexp_full_match(mail, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'), false) THEN mail ELSE '' END AS email
FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'user' || c_custkey WHEN 2 THEN 'u@' || c_custkey
        WHEN 3 THEN 'a b@x.org' ELSE 'user.' || c_custkey || '@mail.example.com' END AS mail FROM customer) x
""".replace("\\\\", "\\"))
def valid_emails(t):
    k, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    mail = (
        F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.lit("user"), key)).when(k == 2, F.concat(F.lit("u@"), key))
        .when(k == 3, "a b@x.org").otherwise(F.concat(F.lit("user."), key, F.lit("@mail.example.com")))
    )
    return t.customer.select("c_custkey", X.email_or_blank(mail).alias("email"))


@query("cond_isnull", "SELECT p_partkey, coalesce(CAST(nullif(p_size, 10) AS INTEGER), 0) AS size FROM part")
def cond_isnull(t):
    return t.part.select("p_partkey", X.isnull_as(F.nullif(F.col("p_size"), F.lit(10)), 0, "int").alias("size"))


@query("cond_coalesce", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_name END, CASE WHEN p_size > 20 THEN p_type END, CASE WHEN p_size > 10 THEN p_brand END) AS label,
       coalesce(CASE WHEN p_size > 40 THEN p_retailprice END, CASE WHEN p_type = 'PROMO' THEN 1.5 END, 50.0) AS deposit FROM part
""")
def cond_coalesce(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        F.coalesce(F.when(size > 40, F.col("p_name")), F.when(size > 20, F.col("p_type")), F.when(size > 10, F.col("p_brand"))).alias("label"),
        F.coalesce(F.when(size > 40, F.col("p_retailprice")), F.when(F.col("p_type") == "PROMO", 1.5), F.lit(50.0)).alias("deposit"),
    )


@query("cond_iif", "SELECT p_partkey, CASE WHEN nullif(p_size, 10) > 25 THEN 'large' ELSE 'small' END AS size_class FROM part")
def cond_iif(t):
    return t.part.select("p_partkey", X.iif(F.nullif(F.col("p_size"), F.lit(10)) > 25, "large", "small").alias("size_class"))


@query("cond_category_case", """
SELECT l_linenumber, category, count(*) AS rows_in FROM (
  SELECT l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN 'Reservation' WHEN l_linenumber = 5 THEN 'Tip' WHEN l_linenumber = 4 THEN 'Fee'
    WHEN l_orderkey % 3 = 0 AND l_returnflag = 'A' THEN 'Booking Deposit' WHEN l_orderkey % 3 = 0 THEN 'Booking' ELSE l_linestatus END AS category FROM lineitem) x
GROUP BY 1, 2
""")
def cond_category_case(t):
    booking = F.col("l_orderkey") % 3 == 0
    category = (
        F.when(F.col("l_orderkey") % 11 == 0, "Reservation").when(F.col("l_linenumber") == 5, "Tip").when(F.col("l_linenumber") == 4, "Fee")
        .when(booking & (F.col("l_returnflag") == "A"), "Booking Deposit").when(booking, "Booking").otherwise(F.col("l_linestatus"))
    )
    return t.lineitem.groupBy("l_linenumber", category.alias("category")).agg(F.count("*").alias("rows_in"))


@query("cond_case_null", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_brand END AS promoted_brand FROM part")
def cond_case_null(t):
    return t.part.select("p_partkey", F.when(F.col("p_type") == "PROMO", F.col("p_brand")).alias("promoted_brand"))


@query("date_add_sub", """
SELECT event_id, CAST(ts AS DATE) - 2 AS two_back, CAST(ts AS DATE) + 1 AS one_ahead, ts + INTERVAL 25 MINUTE AS hold_end, ts - INTERVAL 6 HOUR AS shifted FROM events
""")
def date_add_sub(t):
    d = F.to_date("ts")
    return t.events.select(
        "event_id", F.date_sub(d, 2).alias("two_back"), F.date_add(d, 1).alias("one_ahead"), (F.col("ts") + X.minutes(25)).alias("hold_end"),
        (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("shifted"),
    )


@query("date_dow0", "SELECT dayofweek(o_orderdate) AS day_of_week, count(*) AS orders FROM orders GROUP BY 1")
def date_dow0(t):
    return t.orders.groupBy(X.dow0(F.to_date("o_orderdate")).alias("day_of_week")).agg(F.count("*").alias("orders"))


@query("date_month_window", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, last_day(o_orderdate) + 1 AS next_first,
       CAST(date_trunc('month', (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago') AS DATE) AS local_first FROM orders
""")
def date_month_window(t):
    return t.orders.select(
        "o_orderkey", X.month_start("o_orderdate").alias("first_day"), X.next_month_start("o_orderdate").alias("next_first"),
        X.month_start(X.local_time("o_orderdate", F.lit("America/Chicago"))).alias("local_first"),
    )


@query("date_floor_1900", """
SELECT o_orderkey, CASE WHEN year(d) < 1900 THEN DATE '1900-01-01' ELSE d END AS birth FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50000 AS INTEGER) END AS d FROM orders) x
""")
def date_floor_1900(t):
    d = F.when(F.col("o_orderkey") % 6 != 0, F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 50000).cast("int")))
    return t.orders.select("o_orderkey", X.floor_1900(d).alias("birth"))


@query("date_format_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders")
def date_format_iso(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))


@query("date_cast", "SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1")
def date_cast(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))


@query("date_tz_local", """
SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS local_ts,
       CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS DATE) AS local_day, CAST(ts - INTERVAL 5 HOUR AS DATE) AS written_day FROM events
""")
def date_tz_local(t):
    return t.events.select(
        "event_id", X.local_time("ts", F.lit("America/Denver")).alias("local_ts"), X.local_date("ts", F.lit("Mountain Standard Time")).alias("local_day"),
        X.stored_date("ts", F.lit(-300)).alias("written_day"),
    )


@query("id_deterministic", """
SELECT c_custkey, upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS cookie_id
FROM (SELECT c_custkey, sha256('6:cookie' || length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey) AS h FROM customer) x
""")
def id_deterministic(t):
    return t.customer.select("c_custkey", X.derived_uuid(F.lit("cookie"), "c_custkey").alias("cookie_id"))


@query("id_assign", """
SELECT o_orderkey, (SELECT max(o_custkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS new_id FROM orders
""")
def id_assign(t):
    start = mg.max_id(t.orders, "o_custkey")
    bucket = F.floor(F.col("o_orderkey") / F.lit(4096))
    return mg.assign_ids(t.orders.select("o_orderkey"), ["o_orderkey"], "new_id", start, bucket=bucket)
