"""Batch twins of the streaming jobs, with SQL, and the streams themselves run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnstile.queries.base import query
from turnstile.session import ensure_checkpoint_dir
from turnstile.streaming import jobs


def _holds(events):
    return events.filter(F.col("event_type") == "click").select(F.col("event_id").alias("hold_id"), F.col("user_id").alias("owner"), F.col("ts").alias("began"))


def _endings(events):
    kind = F.when(F.col("event_type") == "purchase", "converted").otherwise("released")
    return events.filter(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("owner"), F.col("ts").alias("ended"), kind.alias("outcome"))


HOLDS = """WITH h AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), e AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'converted' ELSE 'released' END AS outcome FROM events WHERE event_type IN ('purchase', 'error')),
m AS (SELECT h.event_id, h.user_id, h.ts, e.outcome, row_number() OVER (PARTITION BY h.event_id ORDER BY e.ts, e.outcome) AS rn FROM h LEFT JOIN e ON e.user_id = h.user_id AND e.ts BETWEEN h.ts AND h.ts + INTERVAL 25 MINUTE)
SELECT event_id AS hold_id, user_id AS owner, coalesce(outcome, 'expired') AS outcome FROM m WHERE rn = 1"""


@query("hold_outcomes", HOLDS)
def hold_outcomes(t):
    return jobs.first_outcome(jobs.hold_outcomes(_holds(t.events), _endings(t.events))).drop("began")


DAILY = """SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS revenue, count(*) AS payments FROM events GROUP BY 1, 2"""


@query("rev_daily_window", DAILY)
def rev_daily_window(t):
    rows = jobs.daily_revenue(t.events, ["event_type"], F.col("value").cast("decimal(12,2)"))
    return rows.select(F.to_date("day_start").alias("day"), "event_type", F.col("revenue").cast("double").alias("revenue"), "payments")


def _run_to_table(t, stream, mode: str):
    """Run a stream over all files at hand and return what it wrote."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _event_stream(t):
    return jobs.as_instants(t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir), "ts")


@query("stream_deduplicated", "SELECT user_id, event_type, count(DISTINCT ts) AS moments FROM events GROUP BY 1, 2")
def stream_deduplicated(t):
    stream = jobs.first_payments_only(_event_stream(t).select("user_id", "event_type", "ts"), ["user_id", "event_type", "ts"])
    return _run_to_table(t, stream, "append").groupBy("user_id", "event_type").agg(F.count("*").alias("moments"))


@query("stream_daily_revenue", f"SELECT * FROM ({DAILY}) x WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_daily_revenue(t):
    """Days the watermark has closed, from the stream."""
    stream = jobs.daily_revenue(_event_stream(t), ["event_type"], F.col("value").cast("decimal(12,2)"))
    rows = _run_to_table(t, stream, "append")
    return rows.select(F.to_date("day_start").alias("day"), "event_type", F.col("revenue").cast("double").alias("revenue"), "payments")


@query("stream_hold_outcomes", HOLDS + """ AND (outcome IS NOT NULL
  OR ts + INTERVAL 26 MINUTE < (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type IN ('purchase', 'error'))) FROM events))""")
def stream_hold_outcomes(t):
    """The same from two streams. A hold without an ending comes out once the watermark, a minute behind the slower
    stream, has passed its time; holds still open when the streams end do not."""
    outcomes = jobs.hold_outcomes(_holds(_event_stream(t)), _endings(_event_stream(t)))
    return jobs.first_outcome(_run_to_table(t, outcomes, "append")).drop("began")
