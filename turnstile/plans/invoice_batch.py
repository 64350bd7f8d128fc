"""Invoice headers and details from JSON: void, update, insert, and link lines to their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import joins as jn
from turnstile.operators import merge as mg
from turnstile.operators.windows import keep_first
from turnstile.plans.documents import invoice_documents
from turnstile.plans.payment_batch import _typed, shred
from turnstile.sources.catalog import Catalog, FrameCatalog
from turnstile.sources.sinks import stage

# Fields of the two payloads.
HEADER_JSON = """ConfirmationCode string, LocationId bigint, AccountId bigint, BookingId bigint, RecurringBillingPeriodId int, RefundedInvoiceId bigint, InvoiceStatusId int, CurrencyId int"""
DETAIL_JSON = """Id string, Description string, UnitPrinciple decimal(18,6), UnitTax decimal(18,6), Quantity int, DetailTypeId int, RelatedInvoiceDetailId string, SubscriptionId bigint,
SubscriptionDiscountId bigint, EventReservationId bigint, ItemFeeId bigint, ProductFeeId bigint, BookingItemId bigint, BookingParticipantId bigint, BookingResourceId bigint, BookingFeeId bigint,
IsTaxable boolean, TaxCode string, ExternalId string, BundledItemPrinciple decimal(18,6)"""
KEPT_WHEN_NULL = [
    "description", "unit_principle", "unit_tax", "quantity", "detail_type_id", "subscription_discount_id", "item_fee_id", "product_fee_id", "booking_item_id", "booking_participant_id",
    "booking_resource_id", "booking_fee_id", "is_taxable", "tax_code", "external_id", "bundled_item_principle",
]
UPDATE_KEYS = ["booking_item_id", "booking_fee_id", "booking_participant_id", "booking_resource_id", "external_id"]
# A line that matches by its resource alone is updated and still inserted.
INSERT_KEYS = [k for k in UPDATE_KEYS if k != "booking_resource_id"]


def apply_invoice_batch(cat: Catalog, batch: DataFrame, user: str, as_of=None) -> dict[str, DataFrame]:
    """New versions of headers, details and allocations, and (request_id, invoice_header_id).

    `batch`: request_id, invoice_header_id (null or 0 for a new one), header and details as JSON text.
    """
    now = X.clock(as_of)
    stamp = {"modified_by": F.lit(user), "modified_date": now}
    batch = stage(batch)
    headers = cat.table("invoice.InvoiceHeader")
    is_new = F.coalesce(F.col("invoice_header_id"), F.lit(0)) == 0
    parsed = shred(batch, "header", HEADER_JSON, "request_id", "invoice_header_id").drop("position")
    fresh = mg.with_new_ids(parsed.filter(is_new).drop("invoice_header_id"), headers, ["request_id"])
    known = batch.filter(~is_new).join(headers.select(F.col("id").alias("invoice_header_id")), "invoice_header_id", "left_semi")
    made = fresh.select("request_id", F.col("id").alias("invoice_header_id")).unionByName(known.select("request_id", "invoice_header_id"))
    changes = parsed.filter(~is_new).withColumn("id", F.col("invoice_header_id")).withColumnRenamed("request_id", "sequence")
    updated = mg.upsert(headers, changes, ["id"], overwrite=["refunded_invoice_id", "invoice_status_id"], stamp=stamp, sequence="sequence", insert=False)
    new_headers = updated.unionByName(_typed(fresh.withColumns({**stamp, "created_by": F.lit(user), "created_date": now}), headers))

    made = stage(made)
    given = shred(batch.drop("invoice_header_id"), "details", DETAIL_JSON, "request_id").join(made, "request_id").withColumnRenamed("id", "input_id")
    given = stage(
        given.withColumn("change_id", F.concat_ws("-", F.lpad(F.col("request_id").cast("string"), 20, "0"), F.lpad(F.col("position").cast("string"), 10, "0")))
    )
    touched = made.join(batch.filter(F.col("details").isNotNull()).select("request_id"), "request_id", "left_semi").select("invoice_header_id").distinct()
    # Only the lines of touched invoices go through the steps; all others are passed on as they are. What the steps find is kept
    # by line id, so that whole lines meet it once, at the end.
    details, allocations = cat.table("invoice.InvoiceDetail"), cat.table("invoice.PaymentInvoiceDetail")
    mine = stage(details.join(touched, "invoice_header_id", "left_semi"))
    line_ids = mine.select(F.col("id").alias("invoice_detail_id"))
    voided, voided_paid = void_unpaid(mine, allocations.join(line_ids, "invoice_detail_id", "left_semi"), now, user)
    kept, new = merge_details(voided, given, details, stamp, now, user)
    links = line_links(cat, kept.unionByName(new), given)
    linked = [mg.relink(lines, "id", "related_invoice_detail_id", links) for lines in (kept, new)]
    return {
        "invoice.InvoiceHeader": new_headers,
        "invoice.InvoiceDetail": details.join(touched, "invoice_header_id", "left_anti").select(*details.columns).unionByName(linked[0]).unionByName(linked[1]),
        "invoice.PaymentInvoiceDetail": allocations.join(line_ids, "invoice_detail_id", "left_anti").select(*allocations.columns).unionByName(voided_paid),
        "requests": made,
    }


def documents_after(cat: Catalog, result: dict[str, DataFrame]) -> DataFrame:
    """Documents of the invoices concerned, from the tables that `apply_invoice_batch` left behind."""
    return invoice_documents(FrameCatalog(cat.spark, result, cat), result["requests"].select("invoice_header_id").distinct())


def void_unpaid(mine: DataFrame, paid: DataFrame, now, user: str) -> tuple[DataFrame, DataFrame]:
    """Void active lines without an active allocation, then the allocations of every voided line."""
    live = F.col("payment_invoice_detail_status_id") == codes.STATUS_ACTIVE
    active = F.col("invoice_detail_status_id") == codes.STATUS_ACTIVE
    kept = paid.filter(live).select(F.col("invoice_detail_id").alias("id"))
    unpaid = stage(mine.filter(active).select("id").join(kept, "id", "left_anti").distinct())
    voided = mine.filter(~active).select("id").unionByName(unpaid).withColumnRenamed("id", "invoice_detail_id")
    return (
        mg.void(mine, unpaid, "id", "invoice_detail_status_id", now, user),
        mg.void(paid, voided, "invoice_detail_id", "payment_invoice_detail_status_id", now, user, when=live),
    )


def merge_details(details: DataFrame, given: DataFrame, table: DataFrame, stamp: dict, now, user: str) -> tuple[DataFrame, DataFrame]:
    """Update active lines that share one of five ids with a given line; make lines of those that match none.

    `table` is the whole table, whose ids the new lines continue.
    """
    active = details.filter(F.col("invoice_detail_status_id") == codes.STATUS_ACTIVE)
    match = lambda keys: jn.any_key_join(active, given, keys, "id", "change_id", on="invoice_header_id")
    kept = [c for c in KEPT_WHEN_NULL if c in details.columns]
    changes = match(UPDATE_KEYS).join(given.select("change_id", *kept), "change_id")
    changes = stage(keep_first(changes, "id", [F.col("change_id").desc()]).drop("change_id"))
    stamps = {c: v for c, v in stamp.items() if c in details.columns}
    updated = mg.upsert(details, changes, ["id"], keep_when_null=kept, stamp=stamps, insert=False)
    new = given.join(match(INSERT_KEYS).select("change_id").distinct(), "change_id", "left_anti").select("invoice_header_id", "change_id", *kept)
    new = new.withColumns({**stamp, "created_by": F.lit(user), "created_date": now, "invoice_detail_status_id": F.lit(codes.STATUS_ACTIVE)})
    return updated, stage(_typed(mg.with_new_ids(new, table, ["invoice_header_id", "change_id", "created_date"]), details))


def line_links(cat: Catalog, details: DataFrame, given: DataFrame) -> DataFrame:
    """(id, parent) of lines that get a parent: promotions by name, discounts and entitlements by the base participant, others as given.

    Of several possible parents the lowest id is taken. A given parent beats the other rules.
    """
    scope, name = ["invoice_header_id"], ["invoice_header_id", "external_id"]
    # Lines without a name are nobody's child or parent here.
    mine = stage(details.filter(F.col("external_id").isNotNull()).select("id", *name, (F.col("invoice_detail_status_id") == codes.STATUS_ACTIVE).alias("active")))
    live = F.coalesce(F.col("active"), F.lit(False))
    by_name = mine.groupBy(*name).agg(F.min("id").alias("parent"), F.min(F.when(live, F.col("id"))).alias("active_parent"), F.bool_or(live).alias("any_active"))
    promo = mine.filter(F.col("external_id").endswith("-Promo")).select(
        "id", "invoice_header_id", F.replace("external_id", F.lit("-Promo"), F.lit("")).alias("external_id")
    ).join(by_name.select(*name, "parent"), name, "left").select("id", "parent", F.lit(1).alias("rule"))
    # Few lines ask for the base participant: only their invoices are searched for it.
    asking = stage(mine.filter((F.col("external_id") == "Discount") | F.col("external_id").like("%Entitlement%")).select("id", *scope))
    base_names = cat.table("booking.BookingParticipant", "external_id", "participant_type_id").filter(F.col("participant_type_id") == codes.PARTICIPANT_BASE).select("external_id").distinct()
    base = mine.join(asking.select(*scope).distinct(), scope, "left_semi").join(base_names, "external_id", "left_semi").groupBy(*scope).agg(F.min("id").alias("parent"))
    off = asking.join(base, scope, "left").select("id", "parent", F.lit(2).alias("rule"))
    # The given parent is an id of the same batch: translated through the external ids of both lines.
    children = given.filter(F.col("related_invoice_detail_id").isNotNull()).select(*scope, "request_id", F.col("related_invoice_detail_id").alias("input_id"), "external_id")
    parents = given.select("request_id", "input_id", F.col("external_id").alias("parent_external_id"))
    named = by_name.filter("any_active").select(*scope, F.col("external_id").alias("parent_external_id"), F.col("active_parent").alias("parent"))
    stated = children.join(parents, ["request_id", "input_id"]).join(named, [*scope, "parent_external_id"]).join(
        mine.filter(live).select("id", *name), name
    ).select("id", "parent", F.lit(3).alias("rule"))
    return stage(keep_first(promo.unionByName(off).unionByName(stated), "id", [F.col("rule").desc(), F.col("parent")]).drop("rule"))
