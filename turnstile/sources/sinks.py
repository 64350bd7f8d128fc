"""Writers: appended Parquet, table versions, JSON documents, run log."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnstile.session import ensure_checkpoint_dir

#: A row of the run log; `newest` is the latest stamp that the load wrote.
LOG = "created_on timestamp_ntz, command_type string, record_count int, error_message string, newest timestamp_ntz"


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_version(df: DataFrame, root: str, version: int, partition_by: list[str] = ()) -> str:
    """Next version of a table; the one it was computed from stays readable."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def write_json_documents(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).option("ignoreNullFields", "true").json(path)


def run_log(loaded: DataFrame, as_of: Column, command: str = "Record(s) Inserted", error: str = "No Error") -> DataFrame:
    """One log row counting what a load wrote."""
    return loaded.agg(F.count("*").cast("int").alias("record_count")).select(
        as_of.alias("created_on"), F.lit(command).alias("command_type"), "record_count", F.lit(error).alias("error_message")
    )


def logged_load(rows: DataFrame, path: str, log: str, as_of: Column, newest: str | None = None, command: str = "Record(s) Inserted", error: str = "No Error") -> None:
    """Writes a load into a folder of its own and then its log row, from what the write itself has counted.

    Nothing is read or computed again for the log. Both folders are replaced as wholes, so that a load repeated after a
    failure leaves one copy of its rows and one log row.
    """
    seen = Observation()
    latest = F.max(newest) if newest else F.max(F.lit(None).cast("timestamp_ntz"))
    rows.observe(seen, F.count(F.lit(1)).alias("record_count"), latest.cast("timestamp_ntz").alias("newest")).write.mode("overwrite").parquet(path)
    entry = rows.sparkSession.range(1).select(
        as_of.alias("created_on"), F.lit(command).alias("command_type"), F.lit(seen.get["record_count"]).cast("int").alias("record_count"),
        F.lit(error).alias("error_message"), F.lit(seen.get["newest"]).cast("timestamp_ntz").alias("newest"),
    )
    entry.write.mode("overwrite").parquet(log)


def read_loads(spark: SparkSession, root: str, schema) -> DataFrame:
    """Rows of all loads below a folder; none if nothing has been loaded yet."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/*")


#: Spark's setting by which the shuffle files of an execution go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made inside leave no shuffle files behind; for steps whose rows are kept elsewhere and that are run once."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut a long lineage: a reliable checkpoint that survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame) -> DataFrame:
    """Cut a long lineage with a packed copy in the checkpoint folder, of which later steps read the columns they need.

    The copy is smaller than a checkpoint, and the shuffles that made it leave the disk once it is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
