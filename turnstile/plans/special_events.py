"""Special-event bookings from JSON, new and changed, as one batch of table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import filters as flt
from turnstile.operators import merge as mg
from turnstile.plans.audit import booking_audit
from turnstile.plans.documents import special_event_documents
from turnstile.plans.payment_batch import _typed, shred
from turnstile.sources.catalog import Catalog, FrameCatalog
from turnstile.sources.sinks import materialise

# Fields of the three payloads.
BOOKING_JSON = """Id bigint, ParkId bigint, AccountId bigint, ScheduleDetailId bigint, ProductLevelId int, InternalNotes string, ExternalNotes string, InvoiceId bigint, DepositPrice decimal(18,6),
IsSpecialEvent boolean, RelatedBookingId bigint"""
EVENT_JSON = """OrganizationName string, IsTaxExempt boolean, TaxCode string, ContactFirstName string, ContactLastName string, EmailAddress string, PhoneNumber string, BasePrice decimal(18,6),
BaseParticipantCount int, ExtraPrice decimal(18,6), ExtraParticipantCount int, IsQuote boolean, IsGroupSales boolean, ExpirationDate date"""
ITEM_JSON = "ParkProductId int, ParkProductName string, Included boolean, Quantity int, Price decimal(18,6), IsTaxable boolean, TaxCode string"
EVENT_COLUMNS = [
    "organization_name", "is_tax_exempt", "tax_code", "contact_first_name", "contact_last_name", "email_address", "phone_number", "base_price", "base_participant_count", "extra_price",
    "extra_participant_count", "is_quote", "is_group_sales", "expiration_date",
]


def admit(cat: Catalog, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests on bookings: finished ones, stale copies and unknown ids are rejected with a reason."""
    state = cat.table("booking.Booking", "id", "paid", "no_show", "canceled", "deleted", "row_ver").select(
        F.col("id").alias("booking_id"), F.lit(True).alias("exists"), F.col("row_ver").alias("current_row_ver"),
        (F.col("paid").isNotNull() | F.col("no_show").isNotNull() | F.col("canceled").isNotNull() | F.col("deleted").isNotNull()).alias("finalised"),
    )
    given = F.col("booking_id").isNotNull()
    accepted, rejected = flt.split_rejects(
        requests.join(state, "booking_id", "left"),
        [
            ("finalised", F.col("finalised")), ("not found", given & F.col("exists").isNull()),
            ("stale copy", given & ~F.coalesce(F.col("current_row_ver") == F.col("row_ver"), F.lit(False))),
        ],
    )
    extra = ["exists", "current_row_ver", "finalised"]
    return accepted.drop(*extra), rejected.drop(*extra)


def valid_booking_fees(cat: Catalog, now: Column) -> DataFrame:
    fees = cat.table("prdct.ProductFee", "id", "park_id", "product_type_id", "amount", "is_taxable", "description", "tax_code", "valid_from", "valid_to")
    return fees.filter((F.col("product_type_id") == codes.PRODUCT_BOOKING_FEE) & now.between(F.col("valid_from"), F.col("valid_to"))).select(
        F.col("id").alias("product_fee_id"), "park_id", F.col("amount").alias("price"), "is_taxable", "description", "tax_code"
    )


def booked_lines(cat: Catalog, bookings: DataFrame, with_children: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoice lines of the bookings' items, all lines of the bookings' invoices, the bookings), as ids."""
    details = cat.table("invoice.InvoiceDetail", "id", "booking_item_id", "related_invoice_detail_id", "invoice_header_id")
    keys = bookings.select("booking_id").distinct()
    item_ids = cat.table("booking.BookingItem", "id", "booking_id").join(keys, "booking_id", "left_semi").select(F.col("id").alias("booking_item_id"))
    lines = details.join(item_ids, "booking_item_id", "left_semi").select("id")
    if with_children:
        related = details.join(lines.withColumnRenamed("id", "related_invoice_detail_id"), "related_invoice_detail_id", "left_semi").select("id")
        lines = lines.unionByName(related)
    owned = cat.table("invoice.InvoiceHeader", "id", "booking_id").join(keys, "booking_id", "left_semi").select(F.col("id").alias("invoice_header_id"))
    invoiced = details.join(owned, "invoice_header_id", "left_semi").select(F.col("id").alias("invoice_detail_id"))
    return lines.distinct(), invoiced, keys


def withdraw_items(cat: Catalog, bookings: DataFrame, now: Column, user: str, with_children: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines to void, allocations, items) when a booking's items are withdrawn: all its allocations are voided."""
    lines, invoiced, keys = booked_lines(cat, bookings, with_children)
    allocations, items = cat.table("invoice.PaymentInvoiceDetail"), cat.table("booking.BookingItem")
    return (
        lines, mg.void(allocations, invoiced, "invoice_detail_id", "payment_invoice_detail_status_id", now, user, when=F.lit(True)),
        mg.soft_delete(items, keys, "booking_id", now, user, when=F.lit(True)),
    )


def apply_special_event_batch(cat: Catalog, batch: DataFrame, user: str, as_of=None) -> dict[str, DataFrame]:
    """New table versions, audit rows of the accepted bookings to append, (request_id, booking_id) and rejected requests.

    `batch`: request_id, booking_id (null for a new one), row_ver, is_tax_exempt, and booking,
    special_event, items as JSON text.
    """
    now = X.clock(as_of)
    stamp = {"modified_by": F.lit(user), "modified_date": now}
    born = {"created_by": F.lit(user), "created_date": now, **stamp}
    accepted, rejected = admit(cat, batch.withColumn("booking_id", F.nullif(F.col("booking_id"), F.lit(0))))
    accepted = materialise(accepted)
    booking, special = cat.table("booking.Booking"), cat.table("booking.BookingSpecialEvent")
    items, fees = cat.table("booking.BookingItem"), cat.table("booking.BookingFee")
    parsed = shred(accepted, "booking", BOOKING_JSON, "request_id", "booking_id").drop("position").withColumnRenamed("id", "stated_id")

    # bookings
    fresh = mg.with_new_ids(parsed.filter(F.col("booking_id").isNull()).drop("booking_id", "stated_id"), booking, ["request_id"])
    made = fresh.select("request_id", F.col("id").alias("booking_id")).unionByName(accepted.filter(F.col("booking_id").isNotNull()).select("request_id", "booking_id"))
    changed = ["schedule_detail_id", "internal_notes", "external_notes", "deposit_price", "product_level_id", "related_booking_id"]
    updates = parsed.filter(F.col("booking_id").isNotNull() & F.col("stated_id").isNotNull()).withColumnsRenamed({"stated_id": "id", "request_id": "sequence"})
    new_bookings = mg.upsert(booking, updates, ["id"], overwrite=changed, stamp=stamp, sequence="sequence", insert=False).unionByName(
        _typed(fresh.withColumns({"requires_handicap": F.lit(False), "has_protection_plan": F.lit(False), **born}), booking)
    )
    # the chosen slot is kept for special events
    slots = cat.table("booking.ScheduleDetails")
    chosen = parsed.select(F.col("schedule_detail_id").alias("id")).filter(F.col("id").isNotNull())
    new_slots = mg.mark(slots, chosen, "id", {"minimum_product_level_id": F.lit(codes.LEVEL_SPECIAL_EVENT)}, when=F.lit(True))
    # event
    event = shred(accepted, "special_event", EVENT_JSON, "request_id").drop("position").join(made, "request_id")
    is_fresh = accepted.filter(F.col("booking_id").isNull()).select("request_id")
    fresh_events = event.join(is_fresh, "request_id", "left_semi")
    changed_events = event.join(is_fresh, "request_id", "left_anti").withColumnRenamed("request_id", "sequence")
    inserted_events = mg.with_new_ids(fresh_events, special, ["booking_id"]).withColumn("cookie_id", X.derived_uuid(F.lit("special-event"), "booking_id"))
    new_special = mg.upsert(special, changed_events, ["booking_id"], overwrite=EVENT_COLUMNS, sequence="sequence", insert=False).unionByName(_typed(inserted_events, special))
    # items: included ones are free, exempt events are not taxed
    existing = made.join(is_fresh, "request_id", "left_anti").select("booking_id")
    lines, allocations, kept_items = withdraw_items(cat, existing, now, user, with_children=False)
    details = mg.void(cat.table("invoice.InvoiceDetail"), lines, "id", "invoice_detail_status_id", now, user, when=F.lit(True))
    products = cat.table("prdct.ParkProduct", "id", "tax_code").toDF("park_product_id", "product_tax_code").join(
        cat.table("prdct.ProductChannelProduct", "park_product_id", "external_id"), "park_product_id", "left"
    )
    exempt = F.coalesce(F.col("is_tax_exempt"), F.lit(False))
    flags = accepted.select("request_id", exempt.alias("exempt"))
    stated = shred(accepted, "items", ITEM_JSON, "request_id").drop("tax_code").join(made, "request_id").join(flags, "request_id").join(products, "park_product_id", "left").withColumns(
        {
            "price": X.iif(F.col("included"), X.zero(), F.col("price")), "is_taxable": X.iif(F.col("exempt"), F.lit(False), F.col("is_taxable")), "tax_code": F.col("product_tax_code"), **born,
        }
    )
    new_items = kept_items.unionByName(_typed(mg.with_new_ids(stated, items, ["request_id", "position", "external_id"]), items))
    # fees: there while the event has a base price, gone when it costs nothing at all
    place = new_bookings.select(F.col("id").alias("booking_id"), "park_id", "invoice_id")
    priced = event.select("request_id", "booking_id", "base_price", (F.col("base_price") + F.col("extra_price") * F.col("extra_participant_count")).alias("total")).join(flags, "request_id").join(place, "booking_id")
    without = priced.filter(F.col("base_price") != 0).join(fees.select("booking_id").distinct(), "booking_id", "left_anti")
    added = without.join(valid_booking_fees(cat, now).drop("is_taxable"), "park_id").withColumn("is_taxable", ~F.col("exempt"))
    # an event with a base price and a fee falls through to the second test as well
    adding = without.select("booking_id")
    free = priced.join(is_fresh, "request_id", "left_anti").filter(F.col("total") == 0).join(adding, "booking_id", "left_anti").select("booking_id")
    uninvoiced = priced.join(is_fresh, "request_id", "left_anti").filter(F.col("invoice_id").isNull())
    retaxed = fees.join(uninvoiced.select("booking_id", F.col("exempt").alias("__exempt")).distinct(), "booking_id", "left").withColumn(
        "is_taxable", F.coalesce(~F.col("__exempt"), F.col("is_taxable"))
    ).select(*fees.columns)
    new_fees = retaxed.join(free, "booking_id", "left_anti").select(*fees.columns).unionByName(_typed(mg.with_new_ids(added, fees, ["booking_id", "product_fee_id"]), fees))
    tables = {
        "booking.Booking": new_bookings, "booking.ScheduleDetails": new_slots, "booking.BookingSpecialEvent": new_special, "booking.BookingItem": new_items, "booking.BookingFee": new_fees,
        "invoice.InvoiceDetail": details, "invoice.PaymentInvoiceDetail": allocations,
    }
    audit = booking_audit(FrameCatalog(cat.spark, tables, cat), made.select("booking_id").distinct(), user, as_of)
    return {**tables, "booking.BookingAudit": audit, "requests": made, "rejected": rejected}


def documents_after(cat: Catalog, result: dict[str, DataFrame]) -> DataFrame:
    """Documents of the accepted bookings, from the tables that `apply_special_event_batch` left behind."""
    return special_event_documents(FrameCatalog(cat.spark, result, cat), result["requests"].select("booking_id").distinct())
