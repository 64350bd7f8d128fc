"""Open-play and ticket calendar with remaining capacity, for many (park, day) requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import documents as doc
from turnstile.operators import joins as jn
from turnstile.operators import windows as win
from turnstile.sources.catalog import Catalog

ENTRY = ["request_id", "category_id", "start_hour", "name", "description", "crowd_level_id", "exclude_open_play", "exclude_memberships", "is_open_play"]
OUTPUT = {
    "ParkAttendanceLimitId": "park_attendance_limit_id", "CategoryId": "category_id", "Name": "name", "Description": "description", "CrowdMeterLevelId": "crowd_level_id",
    "ValidFrom": "valid_from", "ValidTo": "valid_to", "Amount": "amount", "AvailableCapacity": "available_capacity", "ExcludeMemberships": "exclude_memberships",
    "IsOpenPlay": "is_open_play", "CurrencyCode": "currency_code", "ConversionRate": "conversion_rate",
}


def park_calendar(cat: Catalog, requests: DataFrame, as_of=None) -> DataFrame:
    """One row per request, attendance slot and category; `requests`: request_id, park_id, date."""
    now = X.clock(as_of)
    entries = _entries(cat, requests)
    # Open play shows its cheapest option only, and none where something in the slot excludes it.
    slot = ["request_id", "start_hour"]
    marked = win.with_group(
        entries, slot,
        {
            "open_min": F.min(F.when(F.col("is_open_play"), F.col("amount"))),
            "slot_excludes": F.coalesce(F.bool_or(F.col("exclude_open_play")), F.lit(False)),
        },
    )
    shown = marked.filter(
        F.col("amount").isNotNull() & (~F.col("is_open_play") | (F.col("amount") == F.col("open_min")))
        & (~F.col("slot_excludes") | F.col("exclude_open_play"))
    ).drop("open_min", "slot_excludes")
    return _with_capacity(cat, requests, shown, now)


def calendar_documents(cat: Catalog, requests: DataFrame, as_of=None) -> DataFrame:
    return doc.child_arrays(park_calendar(cat, requests, as_of), "request_id", OUTPUT, ["valid_from", "category_id", "name"], "Slots")


def _entries(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Cheapest price per category and start hour from tickets and e-commerce bundles."""
    days = _categories(cat, requests)
    in_window = lambda: (
        (X.effective_start("c_start", "i_start") <= F.col("date")) & (X.effective_end("c_end", "i_end") >= F.col("date"))
    )
    ticket = cat.table("product.Ticket", "id", "category_id", "is_active", "display_in_store", "product_level_id", "start_date", "end_date").filter(
        F.col("is_active") & F.col("display_in_store")
    ).select(F.col("id").alias("ticket_id"), "category_id", "product_level_id", F.col("start_date").alias("i_start"), F.col("end_date").alias("i_end"))
    ticket_prices = cat.table("product.TicketSchedule", "ticket_id", "category_schedule_id", "amount", "quantity").filter(F.col("quantity") > 0).drop("quantity")
    ticket_off = cat.table("product.TicketScheduleBlackout", "ticket_id", "start_date", "end_date")
    sold = jn.not_in_interval(
        days.join(ticket, "category_id").join(ticket_prices, ["ticket_id", "category_schedule_id"]).filter(in_window()), ticket_off, "date", "start_date", "end_date", "ticket_id",
        dates=requests,
    )
    normal = ~F.col("product_level_id").isin(codes.LEVELS_NOT_SOLD_AS_TICKET)
    small = F.col("product_level_id") == codes.LEVEL_FIVE_AND_UNDER
    # Normal tickets and those for small children in one pass; a normal price wins over the other.
    tickets = sold.filter(normal | small).groupBy(*ENTRY).agg(
        F.coalesce(F.min(F.when(normal, F.col("amount"))), F.min(F.when(small, F.col("amount")))).alias("amount")
    )
    bundle = cat.table("product.Bundle", "id", "category_id", "is_active", "bundle_type_id", "start_date", "end_date").filter(
        F.col("is_active") & (F.col("bundle_type_id") == codes.BUNDLE_ECOMMERCE)
    ).select(F.col("id").alias("bundle_id"), "category_id", F.col("start_date").alias("i_start"), F.col("end_date").alias("i_end"))
    bundle_prices = cat.table("product.BundleSchedule", "bundle_id", "category_schedule_id", "amount", "quantity").filter(F.col("quantity") > 0).drop("quantity")
    bundle_off = cat.table("product.BundleScheduleBlackout", "bundle_id", "start_date", "end_date")
    bundles = jn.not_in_interval(
        days.join(bundle, "category_id").join(bundle_prices, ["bundle_id", "category_schedule_id"]).filter(in_window()), bundle_off, "date", "start_date", "end_date", "bundle_id",
        dates=requests,
    ).groupBy(*ENTRY).agg(F.min("amount").alias("amount"))
    return tickets.unionByName(bundles).groupBy(*ENTRY).agg(F.min("amount").alias("amount"))


def _categories(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Active categories of each requested day with crowd level, less blackouts.

    A row whose only meter reading is deleted goes; one without any reading stays.
    """
    category = cat.table(
        "product.Category", "id", "park_id", "is_open_play", "name", "description", "exclude_open_play", "exclude_memberships", "start_date", "end_date", "is_active"
    ).filter("is_active").select(
        F.col("id").alias("category_id"), "park_id", "is_open_play", X.iif(F.col("is_open_play"), F.lit("Park Tickets"), F.col("name")).alias("name"), "description",
        "exclude_open_play", "exclude_memberships", F.col("start_date").alias("c_start"), F.col("end_date").alias("c_end"),
    )
    hours = cat.table("product.CategorySchedule", "id", "category_id", "day_of_week", "start_hour", "is_active").filter("is_active").select(
        F.col("id").alias("category_schedule_id"), "category_id", F.col("day_of_week").alias("dow"), "start_hour"
    )
    meter = cat.table("booking.CrowdMeter", "park_id", "day_of_week", "start_hour", "level_id", "deleted").toDF("park_id", "dow", "start_hour", "crowd_level_id", "meter_deleted")
    blackout = cat.table("product.CategoryScheduleBlackout", "category_id", "start_date", "end_date")
    rows = requests.withColumn("dow", X.dow0("date")).join(category.join(hours, "category_id"), ["park_id", "dow"])
    read = rows.join(meter, ["park_id", "dow", "start_hour"], "left").filter(F.col("meter_deleted").isNull()).drop("meter_deleted")
    return jn.not_in_interval(read, blackout, "date", "start_date", "end_date", "category_id", dates=requests)


def _with_capacity(cat: Catalog, requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    limit = cat.table(
        "park.ParkAttendanceLimit", "id", "park_id", "valid_from", "valid_to", "valid_from_hour", "max_attendance_limit", "event_bookings", "employee_count", "transient_bookings"
    ).withColumnRenamed("id", "park_attendance_limit_id")
    upcoming = limit.filter(F.col("valid_from") >= now).select("park_attendance_limit_id")
    by_ticket = (
        cat.table("acct.TicketReservation", "id", "park_attendance_limit_id", "is_active").filter("is_active").withColumnRenamed("id", "ticket_reservation_id")
        .join(upcoming, "park_attendance_limit_id", "left_semi")
        .join(cat.table("acct.TicketReservationSubscription", "ticket_reservation_id", "subscription_id"), "ticket_reservation_id")
        .join(
            cat.table("acct.Subscription", "id", "subscription_status_id").filter(F.col("subscription_status_id").isin(codes.SUBSCRIPTION_USABLE)).select(F.col("id").alias("subscription_id")),
            "subscription_id",
        ).groupBy("park_attendance_limit_id").agg(F.count("*").alias("ticket_seats"))
    )
    by_member = cat.table("acct.MemberReservation", "park_attendance_limit_id", "is_active").filter("is_active").groupBy("park_attendance_limit_id").agg(F.count("*").alias("member_seats"))
    park = (
        cat.table("park.Park", "id", "timezone", "currency_id", "is_active").filter("is_active").select(F.col("id").alias("park_id"), "timezone", "currency_id")
        .join(cat.table("park.ParkEx", "park_id", "payment_processor_version"), "park_id")
    )
    money = cat.table("currency.Currency", "id", "code").toDF("currency_id", "currency_code")
    rates = cat.table("currency.CurrencyConversion", "from_currency_id", "to_currency_id", "conversion_rate").filter(F.col("from_currency_id") == codes.CURRENCY_BASE).select(
        F.col("to_currency_id").alias("currency_id"), "conversion_rate", F.lit(codes.PROCESSOR_CONVERTS_CURRENCY).alias("payment_processor_version")
    )
    slots = (
        limit.filter((F.col("max_attendance_limit") > 0) & (F.col("valid_from") + X.minutes(codes.START_BUFFER_MINUTES) >= now))
        .withColumn("date", F.to_date("valid_from")).join(requests, ["park_id", "date"]).join(park, "park_id").join(money, "currency_id", "left")
        .join(rates.withColumn("has_rate", F.lit(True)), ["currency_id", "payment_processor_version"], "left")
        .join(by_ticket, "park_attendance_limit_id", "left").join(by_member, "park_attendance_limit_id", "left").withColumnRenamed("valid_from_hour", "start_hour")
    )
    free = F.floor(F.col("max_attendance_limit") - F.col("event_bookings") - F.col("employee_count") - F.col("transient_bookings")).cast("int")
    today = X.local_date(now, "timezone")
    near = ~F.col("is_open_play") | (F.col("date") <= F.date_add(today, codes.OPEN_PLAY_HORIZON_DAYS))
    return slots.join(entries, ["request_id", "start_hour"]).filter(near).select(
        "request_id", "park_attendance_limit_id", "category_id", "name", "description", F.when(~F.col("exclude_open_play"), F.col("crowd_level_id")).alias("crowd_level_id"),
        "valid_from", F.when(~F.col("is_open_play"), F.col("valid_to")).alias("valid_to"), "amount",
        (free - F.coalesce("ticket_seats", F.lit(0)) - F.coalesce("member_seats", F.lit(0))).alias("available_capacity"), "exclude_memberships", "is_open_play",
        "currency_code", "conversion_rate",
    )
