"""Incremental loads, hold outcomes, daily revenue and duplicate suppression as Structured Streaming jobs.

The batch twins beside them give the same rows over data that has come to rest. These jobs re-aim batch
ideas at streams; watermarks bound all state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.sources import sinks

HOLD = f"INTERVAL {codes.HOLD_MINUTES} MINUTES"


def read_stream(spark, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive, with the schema of a batch read."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def as_instants(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need instants: zone-less UTC stamps become timestamps of the UTC session."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


# --- incremental contact load ---------------------------------------------------------------------

def load_contacts(people: DataFrame, out: str, log: str, checkpoint: str, as_of) -> StreamingQuery:
    """Append current, cleansed child rows file by file; the checkpoint takes the place of the watermark query.

    Each micro-batch writes a folder of its own, named by the query id that the checkpoint keeps and the batch's number:
    a batch repeated after a failure replaces itself, and a load under a new checkpoint replaces nothing.
    """
    now = X.clock(as_of)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter((F.col("account_role_id") != codes.ROLE_OWNER) & (F.col("row_end") >= X.clock(codes.OPEN_END))).withColumns(
            {"first_name": X.clean_name("first_name", False), "last_name": X.clean_name("last_name", False), "date_of_birth": X.floor_1900("date_of_birth"), "dataload_create_date": now}
        )
        name = f"batch={batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        sinks.logged_load(rows, f"{out}/{name}", f"{log}/{name}", now, newest="row_start")

    return people.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- hold outcomes ---------------------------------------------------------------------------------

def hold_outcomes(holds: DataFrame, endings: DataFrame) -> DataFrame:
    """What became of each hold within its minutes: converted, released or expired.

    `holds`: hold_id, owner, began; `endings`: owner, ended, outcome. Works on streams (both sides carry
    a watermark; a hold is emitted once its time is over) and on tables alike. One row per ending inside
    the window; `first_outcome` reduces them.
    """
    h = holds.withWatermark("began", "1 minute") if holds.isStreaming else holds
    e = endings.withWatermark("ended", "1 minute") if endings.isStreaming else endings
    # An ending is filed under its own time slot and the one before: a hold meets only endings near it,
    # however many rows its owner has.
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / F.lit(60 * codes.HOLD_MINUTES))
    h = h.withColumn("slot", slot("began"))
    e = e.select(F.col("owner").alias("ending_owner"), "ended", "outcome", F.explode(F.array(slot("ended"), slot("ended") - 1)).alias("ending_slot"))
    in_time = (
        (F.col("owner") == F.col("ending_owner")) & (F.col("slot") == F.col("ending_slot")) & (F.col("ended") >= F.col("began"))
        & (F.col("ended") <= F.col("began") + F.expr(HOLD))
    )
    return h.join(e, in_time, "leftOuter").select("hold_id", "owner", "began", "ended", F.coalesce("outcome", F.lit("expired")).alias("outcome"))


def first_outcome(outcomes: DataFrame) -> DataFrame:
    """Earliest ending per hold; a conversion beats a release at the same instant."""
    return outcomes.groupBy("hold_id", "owner", "began").agg(F.min_by("outcome", F.struct(F.coalesce("ended", F.col("began")), "outcome")).alias("outcome"))


# --- daily revenue -----------------------------------------------------------------------------------

def daily_revenue(events: DataFrame, keys: list[str], amount: Column, delay: str = "1 day") -> DataFrame:
    """Sum per day and key; on a stream a day is emitted once the watermark has passed it."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("day"), *keys).agg(F.sum(amount).alias("revenue"), F.count("*").alias("payments")).select(
        F.col("day.start").alias("day_start"), *keys, "revenue", "payments"
    )


# --- duplicate suppression ------------------------------------------------------------------------------

def first_payments_only(payments: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each payment once, however often it is delivered within the delay."""
    if payments.isStreaming:
        return payments.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return payments.dropDuplicates(keys)
