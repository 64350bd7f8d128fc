"""Nested documents over the given tables; results are flattened to text for the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators import documents as doc
from turnstile.queries.base import query


def _lines(t, *cols):
    return t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *cols)


def _joined(array, field, sep=","):
    return F.array_join(F.transform(array, lambda x: x[field].cast("string")), sep)


@query("doc_children", """
SELECT o_orderkey, count(l_orderkey) AS lines, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS keys
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def doc_children(t):
    docs = doc.collect_children(
        t.orders.select("o_orderkey"), _lines(t), "o_orderkey", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "Lines"
    )
    text = F.array_join(F.transform("Lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return docs.select("o_orderkey", F.coalesce(F.array_size("Lines"), F.lit(0)).cast("long").alias("lines"), text.alias("keys"))


@query("doc_nested_struct", """
SELECT c_custkey, '{"Id":' || c_custkey || ',"Location":{"Name":"' || n_name || '","Brand":{"Id":' || r_regionkey || ',"Name":"' || r_name || '"}}'
  || CASE WHEN c_custkey % 3 = 0 THEN ',"Account":{"Holder":{"Name":"' || c_name || '"}}' ELSE '' END || '}' AS document
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def doc_nested_struct(t):
    rows = (
        t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
        .withColumn("holder", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")))
    )
    nested = doc.nest_paths(
        rows,
        {
            "Id": "c_custkey", "Location.Name": "n_name", "Location.Brand.Id": "r_regionkey", "Location.Brand.Name": "r_name",
            "Account.Holder.Name": "holder",
        },
        keep=["c_custkey"],
    )
    return doc.as_json(nested, ["c_custkey"])


@query("doc_single", """
SELECT user_id, '{"Id":' || event_id || ',"Type":"' || event_type || '"}' AS document FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1
""")
def doc_single(t):
    from turnstile.operators.windows import keep_first

    newest = keep_first(t.events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()])
    return doc.as_json(doc.nest_paths(newest, {"Id": "event_id", "Type": "event_type"}, keep=["user_id"]), ["user_id"])


@query("doc_array", """
SELECT l_orderkey AS o_orderkey, '[' || string_agg('{"Id":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS document FROM lineitem GROUP BY 1
""")
def doc_array(t):
    arrays = doc.child_arrays(_lines(t), "o_orderkey", {"Id": "l_partkey"}, ["l_linenumber", "l_partkey"], "Parts")
    return arrays.select("o_orderkey", F.to_json("Parts").alias("document"))


@query("doc_array_struct", """
SELECT p_partkey, '[{"Amount":' || p_size || '}]' AS schedules FROM part
""")
def doc_array_struct(t):
    return t.part.select("p_partkey", F.to_json(F.array(F.struct(F.col("p_size").alias("Amount")))).alias("schedules"))


@query("doc_sibling_arrays", """
WITH p AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1),
     s AS (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, parts, returned FROM orders LEFT JOIN p ON p.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey
""")
def doc_sibling_arrays(t):
    parts = doc.child_arrays(_lines(t), "o_orderkey", {"Id": "l_partkey"}, ["l_partkey"], "Parts")
    returned = doc.child_arrays(_lines(t).filter(F.col("l_returnflag") == "R"), "o_orderkey", {"Id": "l_suppkey"}, ["l_suppkey"], "Returned")
    docs = doc.attach_children(t.orders.select("o_orderkey"), "o_orderkey", [parts, returned])
    return docs.select("o_orderkey", _joined("Parts", "Id").alias("parts"), _joined("Returned", "Id").alias("returned"))


@query("doc_sorted_array", """
SELECT l_orderkey AS o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_linenumber) AS lines
FROM lineitem GROUP BY 1
""")
def doc_sorted_array(t):
    flag = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    arrays = doc.child_arrays(_lines(t), "o_orderkey", {"n": "l_linenumber"}, [flag, "l_linenumber"], "Lines")
    return arrays.select("o_orderkey", _joined("Lines", "n").alias("lines"))


@query("doc_gated_child", """
SELECT o_orderkey, o_orderstatus, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2
""")
def doc_gated_child(t):
    parent = t.orders.select("o_orderkey", "o_orderstatus")
    # The gate sits on the child side: a parent outside it is listed without children.
    open_parents = parent.filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")
    gated = _lines(t).join(open_parents, "o_orderkey", "left_semi")
    docs = doc.collect_children(parent, gated, "o_orderkey", {"n": "l_linenumber"}, ["l_linenumber"], "Lines")
    return docs.select("o_orderkey", "o_orderstatus", _joined("Lines", "n").alias("lines"))


@query("doc_three_level", """
WITH f AS (SELECT l_orderkey, l_returnflag, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, string_agg(l_returnflag || '[' || lines || ']', ';' ORDER BY l_returnflag) AS flags
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1
""")
def doc_three_level(t):
    flags = doc.child_arrays(_lines(t), ["o_orderkey", "l_returnflag"], {"No": "l_linenumber"}, ["l_linenumber"], "Lines")
    orders = doc.collect_children(
        t.orders.select("o_orderkey"), flags, "o_orderkey", {"Flag": "l_returnflag", "Lines": "Lines"}, ["l_returnflag"], "Flags"
    )
    text = F.transform("Flags", lambda f: F.concat(f["Flag"], F.lit("["), _joined(f["Lines"], "No"), F.lit("]")))
    return orders.select("o_orderkey", F.array_join(text, ";").alias("flags"))


@query("doc_exclude_self", """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT a.l_orderkey AS o_orderkey, a.l_linenumber, string_agg(CAST(b.l_linenumber AS VARCHAR), ',' ORDER BY b.l_linenumber) AS others
FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber GROUP BY 1, 2
""")
def doc_exclude_self(t):
    rows = _lines(t).select("o_orderkey", "l_linenumber").distinct()
    siblings = doc.child_arrays(rows, "o_orderkey", {"No": "l_linenumber"}, ["l_linenumber"], "All")
    others = rows.join(siblings, "o_orderkey").withColumn("Others", F.filter("All", lambda x: x["No"] != F.col("l_linenumber")))
    return others.select("o_orderkey", "l_linenumber", F.nullif(_joined("Others", "No"), F.lit("")).alias("others"))


@query("doc_audit_snapshot", """
SELECT o_orderkey, '{"Id":' || o_orderkey || ',"Status":"' || o_orderstatus || '"' || coalesce(',"Lines":[' || lines || ']', '') || '}' AS snapshot, coalesce(quantity, 0) AS quantity
FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg('{"No":' || l_linenumber || ',"Part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) AS lines,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
""")
def doc_audit_snapshot(t):
    docs = doc.collect_children(
        t.orders.select("o_orderkey", "o_orderstatus"), _lines(t), "o_orderkey", {"No": "l_linenumber", "Part": "l_partkey"}, ["l_linenumber", "l_partkey"], "Lines"
    )
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    nested = doc.nest_paths(docs, {"Id": "o_orderkey", "Status": "o_orderstatus", "Lines": "Lines"}, keep=["o_orderkey"])
    snapshot = doc.as_json(nested, ["o_orderkey"], "snapshot")
    return snapshot.join(totals, "o_orderkey", "left").withColumn("quantity", F.coalesce("quantity", F.lit(0)))
