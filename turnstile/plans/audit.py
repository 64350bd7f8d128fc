"""Booking snapshots with their four totals, for the audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import documents as doc
from turnstile.plans.documents import _camel, _wanted
from turnstile.sources.catalog import Catalog

BOOKING = [
    "party_host_id", "requires_handicap", "has_protection_plan", "internal_notes", "external_notes", "booked", "paid", "invoice_id", "canceled", "deleted", "created_by", "created_date",
    "modified_by", "modified_date", "deposit_price", "is_special_event", "related_booking_id",
]
EVENT = [
    "cookie_id", "organization_name", "is_tax_exempt", "contact_first_name", "contact_last_name", "email_address", "phone_number", "base_price", "base_participant_count", "extra_price",
    "extra_participant_count", "tax_code",
]
FEE = ["id", "product_fee_id", "price", "is_taxable", "description", "tax_code"]
GUEST = ["id", "first_name", "last_name", "date_of_birth"]
ITEM = ["id", "park_product_id", "park_product_name", "included", "quantity", "price", "is_taxable", "tax_code", "external_id"]
PARTICIPANT = ["id", "participant_type_id", "bundle_schedule_id", "bundle_name", "count", "price", "is_taxable", "tax_code", "external_id"]


def audit_totals(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(booking_id, package, resource, participant and add-on totals)."""
    booking = _wanted(cat.table("booking.Booking", "id").withColumnRenamed("id", "booking_id"), ids, "booking_id")
    kind = F.col("participant_type_id")
    participants = cat.table("booking.BookingParticipant", "booking_id", "participant_type_id", "price", "count")
    base = participants.filter(kind == codes.PARTICIPANT_BASE).select("booking_id", F.col("price").alias("base_price"))
    extra = participants.filter(kind.isin(codes.PARTICIPANT_EXTRA, codes.PARTICIPANT_ADULT)).groupBy("booking_id").agg(F.sum(F.col("price") * F.col("count")).alias("extra"))
    items = cat.table("booking.BookingItem", "booking_id", "included", "deleted", "price", "quantity").filter(~F.col("included") & F.col("deleted").isNull()).groupBy("booking_id").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("items")
    )
    resource = cat.table("booking.BookingResource", "booking_id", "price").withColumnRenamed("price", "resource_price")
    event = cat.table("booking.BookingSpecialEvent", "booking_id", "base_price", "extra_price", "extra_participant_count").toDF("booking_id", "event_price", "extra_price", "extra_count")
    joined = booking
    for part in (resource, event, base, extra, items):
        joined = joined.join(part, "booking_id", "left")
    return joined.select(
        "booking_id", X.money(F.coalesce("base_price", "event_price", X.zero())).alias("package_price"), X.money(X.or_zero("resource_price")).alias("resource_price"),
        X.money(F.coalesce(F.col("extra"), F.col("extra_price") * F.col("extra_count"), X.zero())).alias("participant_total"), X.money(X.or_zero("items")).alias("addon_total"),
    )


def booking_snapshots(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(booking_id, booking_json) of bookings in an undeleted schedule."""
    booking = _wanted(cat.table("booking.Booking", "id", "park_id", "account_id", "schedule_detail_id", "product_level_id", *BOOKING).withColumnRenamed("id", "booking_id"), ids, "booking_id")
    schedule = cat.table("booking.Schedule", "id", "date", "template_id", "deleted").filter(F.col("deleted").isNull()).select(
        F.col("id").alias("schedule_id"), F.col("date").alias("schedule_date"), "template_id"
    )
    slot = cat.table("booking.ScheduleDetails", "id", "schedule_id", "resource_id", "start_hour", "end_hour", "party_theme_id", "minimum_product_level_id").withColumnRenamed("id", "schedule_detail_id").join(
        schedule, "schedule_id"
    )
    level = cat.table("prdct.ProductLevel", "id", "name").toDF("product_level_id", "level_name")
    event = cat.table("booking.BookingSpecialEvent", "booking_id", "id", *EVENT).withColumnRenamed("id", "event_id")
    event = event.toDF(*[c if c in ("booking_id", "event_id") else f"event_{c}" for c in event.columns])
    resource = cat.table("booking.BookingResource", "booking_id", "resource_type_name", "resource_name", "price").withColumnRenamed("price", "resource_price")
    owner = cat.table("acct.AccountPerson", "account_id", "person_id", "account_role_id").filter(F.col("account_role_id") == codes.ROLE_OWNER).drop("account_role_id").join(
        cat.table("acct.Person", "id", "first_name", "last_name").withColumnRenamed("id", "person_id"), "person_id", "left"
    ).withColumn("owner_account_id", F.col("account_id"))
    park = cat.table("park.Park", "id", "name").select(F.col("id").alias("park_id"), F.col("id").alias("known_park_id"), F.col("name").alias("park_name"))
    parents = (
        booking.join(slot, "schedule_detail_id").join(level, "product_level_id").join(event, "booking_id", "left").join(resource, "booking_id", "left").join(owner, "account_id", "left").join(park, "park_id", "left")
    )
    child = lambda table, columns, name, df=None: doc.child_arrays(
        cat.table(table, "booking_id", *columns) if df is None else df, "booking_id", _camel(columns), ["id"], name
    )
    live_items = cat.table("booking.BookingItem", "booking_id", *ITEM, "deleted").filter(F.col("deleted").isNull())
    arrays = [
        child("booking.BookingFee", FEE, "fees"), child("booking.BookingGuestOfHonor", GUEST, "guests"), child("booking.BookingItem", ITEM, "items", live_items),
        child("booking.BookingParticipant", PARTICIPANT, "participants"),
    ]
    paths = {
        "Id": "booking_id", **_camel(BOOKING), "SpecialEvent.Id": "event_id", **{f"SpecialEvent.{m}": f"event_{c}" for m, c in _camel(EVENT).items()},
        "BookingResource.ResourceTypeName": "resource_type_name", "BookingResource.ResourceName": "resource_name", "BookingResource.Price": "resource_price",
        **{f"ScheduleDetail.{m}": c for m, c in _camel(["start_hour", "end_hour", "resource_id", "party_theme_id", "minimum_product_level_id"]).items()},
        "ScheduleDetail.Id": "schedule_detail_id", "ScheduleDetail.Schedule.Id": "schedule_id", "ScheduleDetail.Schedule.TemplateId": "template_id",
        "ScheduleDetail.Schedule.Date": "schedule_date", "Park.Id": "known_park_id", "Park.Name": "park_name", "Account.Id": "owner_account_id",
        "Account.PrimaryAccountHolder.FirstName": "first_name", "Account.PrimaryAccountHolder.LastName": "last_name", "ProductLevel.Id": "product_level_id",
        "ProductLevel.Name": "level_name", "Fees": "fees", "Guests": "guests", "Items": "items", "Participants": "participants",
    }
    nested = doc.nest_paths(doc.attach_children(parents, "booking_id", arrays), paths, keep=["booking_id"])
    return doc.as_json(nested, ["booking_id"], "booking_json")


def booking_audit(cat: Catalog, ids: DataFrame | None, user: str, as_of=None) -> DataFrame:
    """Rows to append to the audit table; a booking without a valid schedule has no snapshot."""
    now = X.clock(as_of)
    rows = audit_totals(cat, ids).join(booking_snapshots(cat, ids), "booking_id", "left")
    return rows.withColumns({"created_by": F.lit(user), "created_date": now, "modified_by": F.lit(user), "modified_date": now})
