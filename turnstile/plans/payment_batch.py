"""Payments, their allocations and application fees from JSON, as one batch of table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import merge as mg
from turnstile.operators.windows import keep_first
from turnstile.plans.documents import payment_documents
from turnstile.sources.catalog import Catalog, FrameCatalog, snake
from turnstile.sources.rows import parse_json_rows
from turnstile.sources.sinks import materialise

# Fields of the three payloads.
PAYMENT_JSON = """InvoiceHeaderId bigint, ExternalId string, CheckoutId string, CardReaderId string, IdempotencyKey string, Amount decimal(18,6), FeeAmount decimal(18,6),
ApplicationFeeTotal decimal(18,6), PaymentStatusId int, PaymentChannelId int, PaymentMethodId bigint, PaymentOriginId int, SubAccountId bigint, IsDeposit boolean, IsHardDecline boolean,
RemainingBalance decimal(18,6), FailureReasonId int, FailureMessage string"""
ALLOCATION_JSON = "PaymentId bigint, InvoiceDetailId string, PaidPrinciple decimal(18,6), PaidTax decimal(18,6)"
FEE_JSON = "ApplicationFeeTypeId int, UnitPrinciple decimal(18,6), UnitTax decimal(18,6)"
OVERWRITTEN = [
    "external_id", "checkout_id", "card_reader_id", "amount", "fee_amount", "application_fee_total", "payment_status_id", "payment_channel_id", "payment_method_id", "failure_reason_id",
    "failure_message", "is_deposit", "is_hard_decline", "remaining_balance",
]


def shred(batch: DataFrame, col: str, schema: str, *keys: str) -> DataFrame:
    """Typed rows of one JSON column under the batch's keys, in snake case, with their position."""
    rows = batch.filter(F.col(col).isNotNull()).select(*keys, F.posexplode(F.from_json(col, f"array<struct<{schema}>>")).alias("position", "row"))
    flat = rows.select(*keys, "position", "row.*")
    return flat.toDF(*[snake(c) for c in flat.columns])


def apply_payment_batch(cat: Catalog, batch: DataFrame, user: str, as_of=None) -> dict[str, DataFrame]:
    """New versions of the payment, allocation and fee tables, and (request_id, payment_id).

    `batch`: request_id, payment_id (null or 0 for a new one), payment, allocations and fees as JSON text.
    Absent fields of an update become null. Allocations are taken from updates only.
    """
    now = X.clock(as_of)
    payments = cat.table("invoice.Payment")
    stamp = {"modified_by": F.lit(user), "modified_date": now}
    is_new = F.coalesce(F.col("payment_id"), F.lit(0)) == 0
    parsed = shred(batch, "payment", PAYMENT_JSON, "request_id", "payment_id").drop("position")
    # Payloads are parsed and new payments numbered once; every table of the result goes on from these.
    fresh = materialise(mg.with_new_ids(parsed.filter(is_new).drop("payment_id"), payments, ["request_id"]))
    known = batch.filter(~is_new).join(payments.select(F.col("id").alias("payment_id")), "payment_id", "left_semi")
    made = materialise(fresh.select("request_id", F.col("id").alias("payment_id")).unionByName(known.select("request_id", "payment_id")))

    changes = parsed.filter(~is_new).withColumn("id", F.col("payment_id")).withColumnRenamed("request_id", "sequence")
    overwritten = [c for c in OVERWRITTEN if c in payments.columns]
    updated = mg.upsert(payments, changes, ["id"], overwrite=overwritten, stamp=stamp, sequence="sequence", insert=False)
    inserted = _typed(fresh.withColumns({**stamp, "created_by": F.lit(user), "created_date": now}), payments)
    new_payments = updated.unionByName(inserted)

    allocations = cat.table("invoice.PaymentInvoiceDetail")
    given = shred(known, "allocations", ALLOCATION_JSON, "request_id").withColumnRenamed("request_id", "sequence")
    given = given.withColumns({"payment_invoice_detail_status_id": F.lit(codes.STATUS_ACTIVE), "created_by": F.lit(user), "created_date": now, **stamp})
    given = given.join(
        allocations.filter(F.col("payment_invoice_detail_status_id") == codes.STATUS_ACTIVE).select("payment_id", "invoice_detail_id"), ["payment_id", "invoice_detail_id"], "left_anti"
    )
    added = mg.with_new_ids(given, allocations, ["payment_id", "invoice_detail_id", "sequence", "position"])
    new_allocations = allocations.unionByName(_typed(added, allocations))

    fees = cat.table("invoice.ApplicationFeeDetail")
    keys = ["payment_id", "application_fee_type_id"]
    stated = shred(batch.drop("payment_id"), "fees", FEE_JSON, "request_id").join(made, "request_id")
    stated = materialise(keep_first(stated, keys, [F.col("request_id").desc(), F.col("position").desc()]))
    fee_stamp = {c: v for c, v in stamp.items() if c in fees.columns}
    changed = mg.upsert(fees, stated, keys, overwrite=["unit_principle", "unit_tax"], stamp=fee_stamp, insert=False)
    absent = stated.join(fees.select(*keys), keys, "left_anti").withColumns({**stamp, "created_by": F.lit(user), "created_date": now})
    new_fees = changed.unionByName(_typed(mg.with_new_ids(absent, fees, keys), fees))

    return {
        "invoice.Payment": reconcile_fee_totals(new_payments, new_fees, made), "invoice.PaymentInvoiceDetail": new_allocations, "invoice.ApplicationFeeDetail": new_fees,
        "requests": made,
    }


def documents_after(cat: Catalog, result: dict[str, DataFrame]) -> DataFrame:
    """Documents of the payments concerned, from the tables that `apply_payment_batch` left behind."""
    return payment_documents(FrameCatalog(cat.spark, result, cat), result["requests"].select("payment_id").distinct())


def reconcile_fee_totals(payments: DataFrame, fees: DataFrame, touched: DataFrame) -> DataFrame:
    """Raise the stored fee total of touched payments to the sum of their fee rows, never lower it."""
    sums = fees.join(touched.select("payment_id").distinct(), "payment_id", "left_semi").groupBy(F.col("payment_id").alias("id")).agg(
        F.sum(F.col("unit_principle") + F.col("unit_tax")).alias("fee_sum")
    )
    return mg.raise_only(payments.join(sums, "id", "left").withColumn("fee_sum", X.money(F.col("fee_sum"))), "application_fee_total", "fee_sum").select(*payments.columns)


def _typed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows in the columns and types of a table; columns the rows lack are null."""
    from turnstile.operators.sets import conform

    return conform(rows, like.schema)
