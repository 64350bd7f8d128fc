"""What the steps of a job leave on the disk."""

import json
from pathlib import Path

from frames import values
from pyspark.sql import functions as F

from turnstile.operators import joins as jn
from turnstile.plans import invoice_batch
from turnstile.plans.revenue import revenue_ledger
from turnstile.queries.base import AS_OF
from turnstile.sources import sinks
from turnstile.sources.derived import DerivedCatalog


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def checkpoints(spark):
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return {p.name for p in Path(root.removeprefix("file:")).glob("rdd-*")}


def test_a_staged_step_keeps_its_rows_and_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.createDataFrame([(1, "a", None), (1, "b", [1]), (None, "c", [])], "k int, v string, l array<int>")
    staged = sinks.stage(rows.repartition(3, "v").groupBy("k").agg(F.max("v").alias("v"), F.max("l").alias("l")))
    assert values(staged) == [(1, "b", [1]), (None, "c", [])]
    assert not shuffle_files(spark) - before
    assert spark.conf.get(sinks.DROP_SHUFFLES, "false") == "false"


def test_left_lookup_passes_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "e")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (3, "z"), (None, "no")], "k int, w string")
    assert values(jn.left_lookup(left, right, "k"), "k", "v", "w") == values(left.join(right, "k", "left"), "k", "v", "w")


def test_an_invoice_batch_writes_no_checkpoints_and_keeps_no_shuffles(spark, sf):
    cat = DerivedCatalog(spark, sf)
    one = cat.table("invoice.InvoiceHeader").filter("id > 0").orderBy("id").first()["id"]
    sent = [(1, one, json.dumps({"InvoiceStatusId": 5}), json.dumps([{"Id": "1", "Description": "new", "ExternalId": "fresh", "Quantity": 1}]))]
    batch = spark.createDataFrame(sent, "request_id int, invoice_header_id long, header string, details string")
    files, kept = shuffle_files(spark), checkpoints(spark)
    out = invoice_batch.apply_invoice_batch(cat, batch, "me", AS_OF)
    # Lines, their changes and their links pass from step to step in staged copies.
    assert checkpoints(spark) == kept and not shuffle_files(spark) - files
    assert values(out["invoice.InvoiceDetail"].filter("external_id = 'fresh'"), "invoice_header_id", "description") == [(one, "new")]


def test_ledger_rows_lie_in_staged_copies(spark, sf):
    files = shuffle_files(spark)
    ledger = revenue_ledger(DerivedCatalog(spark, sf), "1995-06-01", "1995-12-31")
    # Each group of branches is written before the next one starts: reading the ledger shuffles nothing.
    assert not shuffle_files(spark) - files
    for rows in (ledger.results, ledger.fees):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() > 0
