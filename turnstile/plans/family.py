"""Family calendar: reservations of an account's people with nested context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import documents as doc
from turnstile.operators import filters as flt
from turnstile.sources.catalog import Catalog

_SERIES = "FranchiseScheduleDetail"
_PLAN = f"{_SERIES}.FranchiseSchedule"
_PERSON = "Subscription.Person"

PATHS = {
    f"{_SERIES}.Id": "detail_id", f"{_SERIES}.StartDate": "start_date", f"{_SERIES}.EndDate": "end_date", f"{_SERIES}.DayMask": "day_mask",
    f"{_SERIES}.StartTime": "start_time", f"{_SERIES}.EndTime": "end_time", f"{_PLAN}.Name": "schedule_name", f"{_PLAN}.Id": "schedule_id",
    f"{_PLAN}.EventTypeId": "event_type_id", f"{_PLAN}.EventType.Name": "event_type", f"{_PLAN}.EventType.ClassificationEventTypes": "classifications",
    f"{_PLAN}.Location.Name": "spot_name", f"{_PLAN}.Park.Brand.Name": "brand_name", f"{_PLAN}.Park.Brand.UrlSlug": "brand_slug", f"{_PLAN}.Park.Brand.Id": "brand_id",
    f"{_PLAN}.Park.Brand.BrandSettings": "settings", f"{_PLAN}.Park.Id": "park_id", f"{_PLAN}.Park.Name": "park_name", f"{_PLAN}.Park.Permission": "permission",
    f"{_PLAN}.Park.Timezone": "timezone", f"{_SERIES}.Exclusions": "exclusions", f"{_PERSON}.Id": "person_id", f"{_PERSON}.FirstName": "first_name",
    f"{_PERSON}.LastName": "last_name", f"{_PERSON}.Subscriptions": "others", f"{_PERSON}.PersonImage.Image.Location": "image_location",
    f"{_PERSON}.AccountWaiverParty.AccountWaiver.Id": "waiver_id", "Subscription.ParkProduct.ProductTemplate.ProductTypeId": "product_type_id",
    "Subscription.SubscriptionStatusId": "subscription_status_id", "Subscription.ExpirationDate": "expiration_date", "Subscription.PersonAttendance.Attended": "attended",
    "FromDate": "reservation_from", "ToDate": "reservation_to", "Canceled": "canceled_local", "Id": "reservation_id", "EventReservationTypeId": "event_reservation_type_id",
    "EventReservationExclusions": "reservation_exclusions",
}


def family_calendar(cat: Catalog, requests: DataFrame, as_of=None) -> DataFrame:
    """Flat calendar rows with child arrays.

    `requests`: request_id, account_id, from_date, to_date, wanted_person_id (or null), active_only.
    """
    now = X.clock(as_of)
    rows = _reservations(cat, requests, now)
    rows = _people(cat, rows, now)
    arrays = [
        ("event_type_id", doc.child_arrays(cat.table("events.ClassificationEventTypes", "event_type_id", "classification_id"), "event_type_id", {"ClassificationId": "classification_id"}, ["classification_id"], "classifications")),
        ("brand_id", doc.child_arrays(brand_settings(cat), "brand_id", {"SettingId": "setting_id", "Value": "value"}, ["setting_id", "value"], "settings")),
        ("detail_id", doc.child_arrays(
            flt.active(cat.table("events.FranchiseScheduleExclusions", "franchise_schedule_detail_id", "exclusion_type_id", "exclusion_date", "deleted"), "deleted").withColumnRenamed("franchise_schedule_detail_id", "detail_id"),
            "detail_id", {"ExclusionTypeId": "exclusion_type_id", "ExclusionDate": "exclusion_date"}, ["exclusion_date", "exclusion_type_id"], "exclusions")),
        ("reservation_id", doc.child_arrays(
            flt.active(cat.table("events.EventReservationExclusions", "event_reservation_id", "date", "deleted"), "deleted").withColumnRenamed("event_reservation_id", "reservation_id"),
            "reservation_id", {"Date": "date"}, ["date"], "reservation_exclusions")),
    ]
    for key, array in arrays:
        rows = rows.join(array, key, "left")
    return rows


def family_documents(cat: Catalog, requests: DataFrame, as_of=None) -> DataFrame:
    """(request_id, Reservations): one document array per request."""
    rows = doc.nest_paths(family_calendar(cat, requests, as_of), PATHS, keep=["request_id", "reservation_id"])
    members = [c for c in rows.columns if c not in ("request_id", "reservation_id")]
    return doc.child_arrays(rows, "request_id", {m: m for m in members}, ["reservation_id"], "Reservations")


#: Parts in which the settings meet the brands.
SETTING_SLOTS = 16


def brand_settings(cat: Catalog) -> DataFrame:
    """Every setting of every brand: the brand's value, else the default."""
    settings = cat.table("dbo.Settings", "id", "default_value").toDF("setting_id", "default_value")
    brands = cat.table("dbo.Brands", "id").withColumnRenamed("id", "brand_id")
    values = cat.table("dbo.BrandSettings", "brand_id", "setting_id", "value")
    overridden = settings.join(values, "setting_id").select("brand_id", "setting_id", F.coalesce("value", "default_value").alias("value"))
    # Every brand lists every setting: the grid is the result, dealt out by setting, so that no task holds all settings.
    slots = F.sequence(F.lit(0).cast("long"), F.lit(SETTING_SLOTS - 1).cast("long"))
    dealt = settings.withColumn("__slot", F.pmod(F.xxhash64("setting_id"), F.lit(SETTING_SLOTS)))
    grid = brands.withColumn("__slot", F.explode(slots)).join(dealt, "__slot").drop("__slot")
    defaults = grid.join(values.select("brand_id", "setting_id").distinct(), ["brand_id", "setting_id"], "left_anti").withColumnRenamed("default_value", "value")
    return overridden.unionByName(defaults).distinct()


def _reservations(cat: Catalog, requests: DataFrame, now) -> DataFrame:
    park = cat.table("park.Park", "id", "name", "brand_id", "timezone", "permission").toDF("park_id", "park_name", "brand_id", "timezone", "permission")
    brand = cat.table("dbo.Brands", "id", "name", "url_slug").toDF("brand_id", "brand_name", "brand_slug")
    plans = cat.table("events.FranchiseSchedules", "id", "event_type_id", "park_id", "name", "location_id", "deleted", "is_active").filter(
        F.col("is_active") & F.col("deleted").isNull()
    ).select(F.col("id").alias("schedule_id"), "event_type_id", "park_id", F.col("name").alias("schedule_name"), "location_id")
    details = cat.table(
        "events.FranchiseScheduleDetails", "id", "franchise_schedule_id", "start_date", "end_date", "day_mask", "start_time", "end_time", "canceled", "deleted"
    )
    series = (
        flt.active(details, "canceled", "deleted").drop("canceled", "deleted").withColumnRenamed("id", "detail_id").withColumnRenamed("franchise_schedule_id", "schedule_id")
        .join(plans, "schedule_id").join(park, "park_id").join(brand, "brand_id")
        .join(cat.table("events.Locations", "id", "name").toDF("location_id", "spot_name"), "location_id", "left")
        .join(cat.table("events.EventTypes", "id", "name").toDF("event_type_id", "event_type"), "event_type_id", "left")
    )
    types = cat.table("prdct.ParkProduct", "id", "product_template_id").toDF("product_id", "product_template_id").join(
        cat.table("prdct.ProductTemplate", "id", "product_type_id").withColumnRenamed("id", "product_template_id"), "product_template_id", "left"
    ).select("product_id", "product_type_id")
    subscriptions = cat.table("acct.Subscription", "id", "account_id", "person_id", "product_id", "subscription_status_id", "expiration_date").withColumnRenamed("id", "subscription_id")
    reservations = cat.table(
        "events.EventReservations", "id", "franchise_schedule_detail_id", "subscription_id", "canceled", "from_date", "to_date", "event_reservation_type_id"
    ).toDF("reservation_id", "detail_id", "subscription_id", "canceled", "reservation_from", "reservation_to", "event_reservation_type_id")
    rows = requests.join(subscriptions, "account_id").join(types, "product_id", "left").join(reservations, "subscription_id").join(series, "detail_id")
    usable = (
        F.col("subscription_status_id").isin(codes.SUBSCRIPTION_USABLE) & (F.col("expiration_date") > X.local_time(now, "timezone"))
        & (F.col("expiration_date") > F.col("from_date").cast("timestamp_ntz"))
    )
    # A cancelled series counts while its cancel date lies behind the start of the range.
    running = F.col("canceled").isNull() | (
        (F.col("event_reservation_type_id") == codes.RESERVATION_SERIES) & F.col("end_date").isNotNull() & (F.to_date("canceled") > F.col("from_date"))
    )
    return rows.filter(
        X.overlaps("start_date", "end_date", "from_date", "to_date") & (F.col("wanted_person_id").isNull() | (F.col("person_id") == F.col("wanted_person_id")))
        & (~F.col("active_only") | (usable & running))
    ).withColumn("canceled_local", X.local_time("canceled", "timezone"))


def _people(cat: Catalog, rows: DataFrame, now) -> DataFrame:
    """Adds the person, image, waiver, attendance and the person's other memberships at the park."""
    person = cat.table("acct.Person", "id", "first_name", "last_name").select(
        F.col("id").alias("person_id"), F.coalesce("first_name", F.lit("Unassigned")).alias("first_name"), "last_name", F.lit(True).alias("known")
    )
    images = cat.table("acct.PersonImage", "person_id", "is_active", "person_image_type_id", "image_id").filter(F.col("is_active") & (F.col("person_image_type_id") == 1)).join(
        cat.table("media.Image", "id", "location").toDF("image_id", "image_location"), "image_id", "left"
    ).select("person_id", "image_location")
    waivers = cat.table("acct.AccountWaiver", "id", "account_id", "park_id", "expiration_date").filter(F.col("expiration_date").cast("timestamp_ntz") > now).select(
        F.col("id").alias("account_waiver_id"), "account_id", "park_id"
    )
    parties = cat.table("acct.AccountWaiverParty", "account_waiver_id", "person_id", "waiver_party_type_id").filter(
        F.col("waiver_party_type_id") == codes.WAIVER_COVERED_PERSON
    ).select("account_waiver_id", "person_id", F.col("account_waiver_id").alias("waiver_id"))
    attendance = cat.table("acct.PersonAttendance", "subscription_id", "event_reservation_id", "attended").toDF("pa_subscription", "pa_reservation", "attended")
    in_range = F.col("attended").isNull() | F.col("attended").between(F.col("from_date").cast("timestamp_ntz"), F.col("to_date").cast("timestamp_ntz"))
    joined = (
        rows.join(person, "person_id", "left").withColumn("first_name", F.coalesce("first_name", F.lit("Unassigned")))
        .join(images, "person_id", "left").join(waivers, ["account_id", "park_id"], "left").join(parties, ["account_waiver_id", "person_id"], "left")
        .join(attendance, (F.col("pa_subscription") == F.col("subscription_id")) & (F.col("pa_reservation") == F.col("reservation_id")) & in_range, "left")
    )
    others = doc.child_arrays(other_memberships(cat, rows, now), ["person_id", "park_id"], {"Id": "other_id"}, ["other_id"], "all_memberships")
    alone = F.filter("all_memberships", lambda x: x["Id"] != F.col("subscription_id"))
    return joined.join(others, ["person_id", "park_id"], "left").withColumn("others", F.when(F.array_size(alone) > 0, alone)).drop("all_memberships", "known")


def other_memberships(cat: Catalog, rows: DataFrame, now) -> DataFrame:
    """Unexpired memberships of each (person, park) among the rows."""
    pairs = rows.select("person_id", "park_id", "timezone").distinct()
    products = cat.table("prdct.ParkProduct", "id", "park_id", "product_template_id").toDF("product_id", "park_id", "product_template_id").join(
        cat.table("prdct.ProductTemplate", "id", "product_type_id").filter(F.col("product_type_id").isin(codes.PRODUCT_MEMBERSHIPS)).select(F.col("id").alias("product_template_id")),
        "product_template_id",
    ).select("product_id", "park_id")
    held = cat.table("acct.Subscription", "id", "person_id", "product_id", "subscription_status_id", "expiration_date").filter(
        F.col("subscription_status_id").isin(codes.SUBSCRIPTION_HELD)
    ).join(products, "product_id")
    return held.join(pairs, ["person_id", "park_id"]).filter(F.col("expiration_date") > X.local_time(now, "timezone")).select(
        "person_id", "park_id", F.col("id").alias("other_id")
    ).distinct()
