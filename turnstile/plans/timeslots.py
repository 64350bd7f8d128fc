"""Priced party slots for many (caller, park, day, level) requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import joins as jn
from turnstile.operators import windows as win
from turnstile.plans import occupancy as occ
from turnstile.sources.catalog import Catalog

THEME = ["party_theme", "party_theme_id", "theme_color", "theme_image"]
SLOT = ["request_id", "start_hour", "end_hour", *THEME]
BUNDLE = ["quantity", "bundle_schedule_id", "crowd_level_id", "extra_bundle_schedule_id", "adult_bundle_schedule_id", "is_active"]
OUTPUT = {
    "StartTime": "start_hour", "EndTime": "end_hour", "Available": "available", "Price": "price", "PartyTheme": "party_theme", "PartyThemeId": "party_theme_id",
    "PartyThemeColorCode": "theme_color", "PartyThemeImageUrl": "theme_image", "Quantity": "quantity", "BaseBundleScheduleId": "bundle_schedule_id",
    "CrowdLevelId": "crowd_level_id", "ExtraBundleScheduleId": "extra_bundle_schedule_id", "AdultBundleScheduleId": "adult_bundle_schedule_id", "IsActive": "is_active",
}


def timeslots(cat: Catalog, requests: DataFrame, as_of=None) -> DataFrame:
    """One row per request, slot and base bundle.

    `requests`: request_id, cookie_id, park_id, date, product_level_id, accessible, use_percent.
    """
    return _entries(cat, requests, X.clock(as_of)).select("request_id", F.inline("entries"))


#: What decides a request's answer besides the caller's own carts and bookings.
VIEW = ["park_id", "date", "product_level_id", "accessible", "use_percent"]


def base_bundles(cat: Catalog, requests: DataFrame, now) -> DataFrame:
    """One party bundle per request and start hour: active before inactive, then cheapest."""
    return occ.shared_answers(requests, occ.bundle_stakes(cat, requests, now), VIEW, lambda rows: _bundles_of(cat, asked(cat, rows), now)).drop("cookie_id")


def open_slots(cat: Catalog, requests: DataFrame, now) -> DataFrame:
    """Slots with price and count: the day's schedule, else dated templates, else default ones."""
    stakes = occ.detail_stakes(cat, requests, now)
    rows = occ.shared_answers(requests, stakes, VIEW, lambda r: _slots_of(cat, asked(cat, r), now), _own_cart_weights(cat))
    return rows.select(*SLOT, F.col("price").alias("slot_price"), _available(F.col("kinds"), F.col("weights")).alias("available"))


def _available(kinds: Column, weights: Column) -> Column:
    """Places of a slot. The caller's carts change what one of their resource type counts for."""
    count = lambda k: k["places"] * F.coalesce(F.try_element_at(weights, k["resource_type_id"]), F.lit(1))
    return F.aggregate(kinds, F.lit(0).cast("long"), lambda n, k: n + count(k))


def _entries(cat: Catalog, requests: DataFrame, now) -> DataFrame:
    """(request_id, entries): a request's slots next to its bundles, as a list without order.

    Both are lists of an answer that requests share. A request takes its few bundles along to the list of slots and is multiplied
    by them in its own row, so that nothing is shuffled after that.
    """
    stakes = {"slots_id": occ.detail_stakes(cat, requests, now), "bundles_id": occ.bundle_stakes(cat, requests, now)}
    keyed = occ.answer_keys(requests.distinct(), VIEW, stakes)
    bundles = _decorate(cat, _bundles_of(cat, asked(cat, occ.askers(keyed, "bundles_id", VIEW)), now))
    offered = bundles.groupBy(F.col("request_id").alias("bundles_id")).agg(F.collect_list(F.struct("band_start", *BUNDLE, "bundle_price")).alias("bundles"))
    slots = _slots_of(cat, asked(cat, occ.askers(keyed, "slots_id", VIEW)), now)
    opened = slots.groupBy(F.col("request_id").alias("slots_id")).agg(F.collect_list(F.struct(*SLOT[1:], "price", "kinds")).alias("slots"))
    callers = keyed.select("request_id", "cookie_id", "slots_id", "bundles_id").join(_own_cart_weights(cat), "cookie_id", "left")
    met = callers.join(offered, "bundles_id").join(opened, "slots_id")

    def entry(s, b):
        return F.struct(
            *[s[c].alias(c) for c in SLOT[1:]], _available(s["kinds"], F.col("weights")).alias("available"), *[b[c].alias(c) for c in BUNDLE],
            (s["price"] + b["bundle_price"]).alias("price"),
        )

    def beside(b):
        within = F.filter("slots", lambda s: (s["start_hour"] >= b["band_start"]) & (s["start_hour"] < b["band_start"] + F.lit(1)))
        return F.transform(within, lambda s: entry(s, b))

    return met.select("request_id", F.flatten(F.transform("bundles", beside)).alias("entries")).filter(F.size("entries") > 0)


def asked(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Requests with their weekday and the ordinal of the wanted level."""
    levels = cat.table("prdct.ProductLevel", "id", "ordinal").toDF("product_level_id", "wanted_ordinal")
    return requests.withColumn("dow", X.dow0("date")).join(levels, "product_level_id", "left")


def timeslot_documents(cat: Catalog, requests: DataFrame, as_of=None) -> DataFrame:
    """(request_id, Slots): slots of a request in order of start and theme."""
    order = ["start_hour", "party_theme", "end_hour", "bundle_schedule_id"]
    element = lambda e: F.struct(F.struct(*[e[c] for c in order]).alias("o"), F.struct(*[e[c].alias(name) for name, c in OUTPUT.items()]).alias("e"))
    listed = F.sort_array(F.transform("entries", element))
    return _entries(cat, requests, X.clock(as_of)).select("request_id", F.transform(listed, lambda x: x["e"]).alias("Slots"))


def _bundles_of(cat: Catalog, requests: DataFrame, now) -> DataFrame:
    bundle = cat.table("product.Bundle", "id", "park_id", "bundle_type_id", "start_date", "end_date", "is_active").filter(
        F.col("bundle_type_id") == codes.BUNDLE_PARTY
    ).select(F.col("id").alias("bundle_id"), "park_id", F.col("start_date").alias("b_start"), F.col("end_date").alias("b_end"), F.col("is_active").alias("bundle_active"))
    schedule = cat.table("product.BundleSchedule", "id", "bundle_id", "category_schedule_id", "amount", "quantity").filter(F.col("amount") > 0).select(
        F.col("id").alias("bundle_schedule_id"), "bundle_id", "category_schedule_id", "amount", F.col("quantity").alias("bundle_capacity")
    )
    hours = cat.table("product.CategorySchedule", "id", "category_id", "day_of_week", "start_hour", "quantity").toDF(
        "category_schedule_id", "category_id", "dow", "band_start", "category_capacity"
    )
    category = cat.table("product.Category", "id", "start_date", "end_date", "is_active").filter("is_active").select(
        F.col("id").alias("category_id"), F.col("start_date").alias("c_start"), F.col("end_date").alias("c_end")
    )
    content = cat.table("product.BundleProduct", "bundle_id", "ticket_id", "quantity")
    tickets = cat.table("product.Ticket", "id", "product_level_id").withColumnRenamed("id", "ticket_id")
    offers = (
        bundle.join(schedule, "bundle_id").join(hours, "category_schedule_id").join(category, "category_id")
        .join(content.join(tickets, "ticket_id"), "bundle_id").join(occ.allocated_bundles(cat), "bundle_id", "left")
    )
    offers = offers.withColumns({
        "starts": F.coalesce("b_start", "c_start"), "ends": F.coalesce("b_end", "c_end"), "allocated": F.col("bundle_allocated").isNotNull(),
    }).drop("b_start", "b_end", "c_start", "c_end", "bundle_allocated")
    taken = occ.taken_bundles(cat, now)
    for rows in taken:
        offers = rows.total_beside(offers)
    offers = offers.withColumns({
        "bundle_left": F.col("bundle_capacity") - F.col("bundle_booked") - F.col("bundle_held"),
        "category_left": F.col("category_capacity") - F.col("category_booked") - F.col("category_held"),
    }).drop(*[rows.name for rows in taken], "bundle_capacity", "category_capacity")
    order = [F.col("bundle_active").desc(), F.col("amount"), F.col("bundle_schedule_id"), F.col("quantity")]
    # What callers have taken themselves only adds to what is left, and one choice is made for all bundles of a schedule that
    # nobody can be refused: it is made before requests multiply them.
    place = ["park_id", "dow", "product_level_id"]
    alike = [*place, "category_schedule_id", "band_start", "starts", "ends", "allocated", "category_left"]
    first = win.keep_first(offers.filter(F.col("bundle_left") > 0), alike, order)
    # Not known whether percentages matter: only fully allocated bundles pass, as if they did.
    asking = requests.withColumn("use_percent", F.coalesce("use_percent", F.lit(True)))
    fits = (F.col("starts") <= F.col("date")) & (F.col("ends") >= F.col("date")) & (~F.col("use_percent") | F.col("allocated"))
    offer = ["category_schedule_id", "band_start", "bundle_id", "bundle_schedule_id", "quantity", "bundle_active", "amount"]
    view = [*place, "date", "use_percent"]
    open_to_all = asking.select(*view).distinct().join(first.filter(F.col("category_left") > 0), place).filter(fits)
    shared = win.keep_first(open_to_all, [*view, "band_start"], order).select(*view, *offer)
    # Besides, callers may be the ones who have taken the last of a bundle or of its schedule.
    callers = asking.filter(F.col("cookie_id").isNotNull()).select("cookie_id", "park_id", "product_level_id").distinct()
    own_bundles, own_categories = (occ.own_of(taken[i : i + 2], name) for i, name in ((0, "own_bundle"), (2, "own_category")))
    reach = ["cookie_id", *place]
    lifted = callers.join(own_categories, "cookie_id").join(first.filter(F.col("category_left") <= 0), ["category_schedule_id", "park_id", "product_level_id"])
    kept = (
        callers.join(own_bundles, "cookie_id").join(offers.filter(F.col("bundle_left") <= 0), ["bundle_schedule_id", "park_id", "product_level_id"])
        .filter(F.col("bundle_left") + F.col("own_bundle") > 0).join(own_categories, ["cookie_id", "category_schedule_id"], "left")
    )
    theirs = [*reach, "starts", "ends", "allocated", *offer]
    special = (
        lifted.filter(F.col("category_left") + F.col("own_category") > 0).select(*theirs)
        .unionByName(kept.filter(F.col("category_left") + F.coalesce("own_category", F.lit(0)) > 0).select(*theirs))
    )
    columns = ["request_id", "cookie_id", *place, *offer]
    free = asking.join(shared, view).select(*columns).unionByName(asking.join(special, reach).filter(fits).select(*columns))
    chosen = win.keep_first(free, ["request_id", "band_start"], order)
    # The price agreed in the caller's own cart, if it is already booked, beats the list price.
    carts = cat.table("booking.Cart", "cookie_id", "base_bundle_schedule_id", "booking_id").filter(F.col("cookie_id").isNotNull())
    agreed = carts.join(occ.base_participants(cat).select("booking_id", "price"), "booking_id").groupBy(
        "cookie_id", F.col("base_bundle_schedule_id").alias("bundle_schedule_id")
    ).agg(F.min("price").alias("own_price"))
    return (
        chosen.join(agreed, ["cookie_id", "bundle_schedule_id"], "left").withColumn("bundle_price", F.coalesce("own_price", "amount"))
        .drop("own_price", "amount", "cookie_id").withColumnRenamed("bundle_active", "is_active")
    )


def _slots_of(cat: Catalog, requests: DataFrame, now) -> DataFrame:
    schedule = cat.table("booking.Schedule", "id", "park_id", "date", "deleted").filter(F.col("deleted").isNull()).select(F.col("id").alias("schedule_id"), "park_id", "date")
    template = cat.table("booking.Template", "id", "park_id", "start_date", "end_date", "is_default", "is_active", "deleted").filter(
        F.col("is_active") & F.col("deleted").isNull()
    ).withColumnRenamed("id", "template_id")
    day = ["park_id", "date"]
    unscheduled = requests.join(schedule.select(*day).distinct(), day, "left_anti")
    dated = template.filter(F.col("start_date").isNotNull() & F.col("end_date").isNotNull()).select("template_id", "park_id", "start_date", "end_date")
    overridden = jn.interval_join(unscheduled.select(*day).distinct(), dated, "date", "start_date", "end_date", "park_id", dates=requests).select(*day, "template_id")
    default = template.filter(F.col("start_date").isNull() & F.col("end_date").isNull() & F.col("is_default")).select("template_id", "park_id")
    by_default = unscheduled.join(overridden.select(*day).distinct(), day, "left_anti").join(default, "park_id")
    templated = unscheduled.join(overridden, day).unionByName(by_default)

    detail = cat.table("booking.ScheduleDetails", "id", "schedule_id", "resource_id", "start_hour", "end_hour", "minimum_product_level_id", "party_theme_id", "deleted").filter(
        F.col("deleted").isNull()
    ).withColumnRenamed("id", "schedule_detail_id").drop("deleted")
    details = occ.Details(cat, now, schedule.join(detail, "schedule_id").join(occ.resources(cat), "resource_id"))
    kind = ["resource_type_id", "is_handicap_accessible", "minimum_product_level_id", "party_theme_id", "start_hour", "end_hour"]
    # Details free for everybody become one row per day, time and kind before requests multiply them.
    cheapest = details.uncontested.groupBy(*day, *kind).agg(F.min("price").alias("price"), F.count("*").alias("places"))
    asked_columns = [*requests.columns, *kind, "price", "places"]
    offered = requests.join(cheapest, day).select(*asked_columns).unionByName(
        details.free_for(requests).withColumn("places", F.lit(1).cast("long")).select(*asked_columns)
    )
    scheduled = _suitable(cat, offered)
    pattern = cat.table("booking.TemplateDetails", "template_id", "resource_id", "day_of_week", "start_hour", "end_hour", "minimum_product_level_id", "party_theme_id", "deleted").filter(
        F.col("deleted").isNull()
    ).withColumnRenamed("day_of_week", "dow").drop("deleted")
    # So do the details of a template.
    patterns = pattern.join(occ.resources(cat), "resource_id").groupBy("template_id", "dow", *kind).agg(F.min("price").alias("price"), F.count("*").alias("places"))
    # No cart changes what a template's slot counts for.
    from_template = _suitable(cat, templated.join(patterns, ["template_id", "dow"])).withColumn("resource_type_id", F.lit(None).cast(dict(scheduled.dtypes)["resource_type_id"]))
    columns = ["request_id", "start_hour", "end_hour", "party_theme_id", "resource_type_id", "price", "places"]
    themes = cat.table("booking.PartyTheme", "id", "description", "color_code", "image_url").toDF("party_theme_id", "party_theme", "theme_color", "theme_image")
    known = themes.select("*", F.col("party_theme_id").alias("known_theme_id"))
    return (
        scheduled.select(*columns).unionByName(from_template.select(*columns)).join(known, "party_theme_id", "left")
        .withColumn("party_theme_id", F.col("known_theme_id")).groupBy(*SLOT, "resource_type_id")
        .agg(F.min("price").alias("price"), F.sum("places").alias("places"))
        .groupBy(*SLOT).agg(F.min("price").alias("price"), F.collect_list(F.struct("resource_type_id", "places")).alias("kinds"))
    )


def _suitable(cat: Catalog, rows: DataFrame) -> DataFrame:
    """Rows whose resource is in use and suits the request, at or above the wanted level."""
    levels = cat.table("prdct.ProductLevel", "id", "ordinal").toDF("minimum_product_level_id", "slot_ordinal")
    high = F.coalesce("slot_ordinal", "wanted_ordinal") >= F.col("wanted_ordinal")
    return occ.usable(rows, cat).join(levels, "minimum_product_level_id", "left").filter(high)


def _own_cart_weights(cat: Catalog) -> DataFrame:
    """How often a slot counts for a caller with carts of its resource type: once per cart and resource booked with it.

    One row per cookie_id, with a map from resource types to weights.
    """
    carts = cat.table("booking.Cart", "cookie_id", "selected_resource_type_id", "booking_id").filter(
        F.col("cookie_id").isNotNull() & F.col("selected_resource_type_id").isNotNull()
    ).withColumnRenamed("selected_resource_type_id", "resource_type_id")
    booked = cat.table("booking.BookingResource", "booking_id").groupBy("booking_id").agg(F.count("*").alias("n"))
    weights = carts.join(booked, "booking_id", "left").groupBy("cookie_id", "resource_type_id").agg(F.sum(F.coalesce("n", F.lit(1))).alias("weight"))
    return weights.groupBy("cookie_id").agg(F.map_from_entries(F.collect_list(F.struct("resource_type_id", "weight"))).alias("weights"))


def _decorate(cat: Catalog, bundles: DataFrame) -> DataFrame:
    """Base bundles with their crowd levels, add-on and adult add-on."""
    crowd = cat.table("booking.CrowdMeter", "park_id", "day_of_week", "start_hour", "level_id", "deleted").filter(F.col("deleted").isNull()).select(
        "park_id", F.col("day_of_week").alias("dow"), F.col("start_hour").alias("crowd_hour"), F.col("level_id").alias("crowd_level_id")
    ).distinct()
    add_on = (
        cat.table("product.Bundle", "id", "related_bundle_id", "bundle_type_id").filter(F.col("bundle_type_id") == codes.BUNDLE_ADD_ON).withColumnRenamed("id", "add_on_id")
        .join(cat.table("product.BundleProduct", "bundle_id", "ticket_id").withColumnRenamed("bundle_id", "add_on_id"), "add_on_id")
        .join(cat.table("product.Ticket", "id", "product_level_id").withColumnRenamed("id", "ticket_id"), "ticket_id")
        .join(cat.table("product.BundleSchedule", "id", "bundle_id", "category_schedule_id").toDF("add_on_schedule_id", "add_on_id", "category_schedule_id"), "add_on_id")
    )
    extra = add_on.filter(F.col("related_bundle_id").isNotNull()).groupBy(
        F.col("related_bundle_id").alias("bundle_id"), "category_schedule_id", "product_level_id"
    ).agg(F.min("add_on_schedule_id").alias("extra_bundle_schedule_id"))
    adult = add_on.filter(F.col("product_level_id") == codes.LEVEL_PARENT).groupBy("category_schedule_id").agg(
        F.min("add_on_schedule_id").alias("adult_bundle_schedule_id")
    )
    return (
        bundles.withColumn("crowd_hour", F.floor("band_start").cast("decimal(9,4)")).join(crowd, ["park_id", "dow", "crowd_hour"], "left")
        .join(extra, ["bundle_id", "category_schedule_id", "product_level_id"], "left").join(adult, "category_schedule_id", "left")
    )
