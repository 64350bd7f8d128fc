"""Carts turned into bookings, new or changed, as one batch of table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import filters as flt
from turnstile.operators import merge as mg
from turnstile.operators.windows import keep_first
from turnstile.plans.audit import booking_audit
from turnstile.plans.payment_batch import _typed
from turnstile.plans.special_events import admit, valid_booking_fees, withdraw_items
from turnstile.sources.catalog import Catalog, FrameCatalog
from turnstile.sources.sinks import materialise

CART = [
    "booking_id", "park_id", "schedule_detail_id", "product_level_id", "requires_handicap", "internal_notes", "external_notes", "promotion_id", "is_ai", "base_bundle_schedule_id",
    "extra_bundle_schedule_id", "adult_bundle_schedule_id", "base_participant_count", "extra_participant_count", "adult_participant_count",
]
KINDS = {codes.PARTICIPANT_BASE: "base", codes.PARTICIPANT_EXTRA: "extra", codes.PARTICIPANT_ADULT: "adult"}


def convert_carts(cat: Catalog, requests: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """New table versions, the converted bookings, and rejected requests with a reason.

    `requests`: request_id, cookie_id, account_id, modified_by, row_ver, deposit_price, invoice_header_id,
    account_entitlement_id, clear_party_host. Each converts one cart: the caller's first by booking id,
    carts without a booking in front. Of several carts on one booking the lowest request id converts.
    """
    now = X.clock(as_of)
    accepted, rejected = _choose_carts(cat, requests)
    accepted = materialise(accepted)
    new, changed = accepted.filter(F.col("booking_id").isNull()), accepted.filter(F.col("booking_id").isNotNull())
    prices = _bundle_prices(cat)
    booking = cat.table("booking.Booking")
    numbered = materialise(mg.with_new_ids(_open_bookings(cat, new, prices, now), booking, ["request_id"]))
    carts = materialise(
        numbered.select("request_id", F.col("id").alias("new_booking_id")).join(new.drop("booking_id"), "request_id").withColumnRenamed("new_booking_id", "booking_id").withColumn("is_new", F.lit(True))
        .unionByName(changed.withColumn("is_new", F.lit(False)))
    )
    tables = {"booking.Booking": _bookings(cat, changed, now).unionByName(_typed(numbered, booking))}
    tables["booking.BookingGuestOfHonor"] = _guests(cat, carts)
    tables["booking.BookingFee"], fee_links = _fees(cat, carts, now)
    tables["booking.BookingParticipant"], seats, participant_links = _participants(cat, carts, prices)
    tables["booking.BookingResource"] = _resources(cat, carts)
    withdrawn, allocations, items = withdraw_items(cat, carts.filter(~F.col("is_new")), now, "cart", with_children=True)
    tables["booking.BookingItem"], item_links = _items(cat, carts, items, seats, now)
    contracts = _contracts(cat, carts, now)
    tables["invoice.PaymentInvoiceDetail"] = allocations

    headers = _assign_headers(cat, carts)
    tables["invoice.InvoiceHeader"] = headers
    owned = materialise(
        headers.filter(F.col("booking_id").isNotNull()).select(F.col("id").alias("invoice_header_id"), "booking_id").join(
            carts.select("booking_id", "modified_by", "account_entitlement_id").distinct(), "booking_id"
        )
    )
    links = fee_links.unionByName(participant_links, allowMissingColumns=True).unionByName(item_links, allowMissingColumns=True)
    # Only lines that are withdrawn, or that belong to a converted booking's invoice, go through the steps.
    details = cat.table("invoice.InvoiceDetail")
    concerned = withdrawn.unionByName(details.join(owned.select("invoice_header_id"), "invoice_header_id", "left_semi").select("id"))
    discounted = cat.table("booking.BookingDiscount", "id", "booking_id").join(carts.select("booking_id"), "booking_id", "left_semi").select(F.col("id").alias("booking_discount_id"))
    concerned = materialise(concerned.unionByName(details.join(discounted, "booking_discount_id", "left_semi").select("id")).distinct())
    mine = mg.void(details.join(concerned, "id", "left_semi"), withdrawn, "id", "invoice_detail_status_id", now, "cart", when=F.lit(True))
    mine = materialise(_link_details(materialise(mine), owned, links, now))
    promoted = carts.select("booking_id").join(tables["booking.Booking"].select(F.col("id").alias("booking_id"), "promotion_id"), "booking_id")
    tables["booking.BookingDiscount"], mine = _discounts(cat, carts, promoted, mine, owned, now)
    tables["invoice.InvoiceDetail"] = details.join(concerned, "id", "left_anti").select(*details.columns).unionByName(mine)

    after = FrameCatalog(cat.spark, tables, cat)
    places = cat.table("park.Park", "id", "brand_id").toDF("park_id", "brand_id").join(cat.table("dbo.Brands", "id", "party_store_url").withColumnRenamed("id", "brand_id"), "brand_id")
    result = tables["booking.Booking"].select(F.col("id").alias("booking_id"), "booked", "park_id").join(places, "park_id").join(
        carts.select("request_id", "booking_id", "is_new"), "booking_id"
    ).select("request_id", "booking_id", "is_new", "booked", "party_store_url")
    return {
        **tables, "acct.PersonContract": contracts, "booking.BookingAudit": booking_audit(after, carts.select("booking_id"), "cart", as_of), "converted": result, "rejected": rejected,
    }


def _choose_carts(cat: Catalog, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    carts = cat.table("booking.Cart", "id", "cookie_id", *CART).withColumnRenamed("id", "cart_id")
    first = keep_first(
        requests.select("request_id", "cookie_id").join(carts, "cookie_id"), "request_id", [F.col("booking_id").asc_nulls_first(), F.col("cart_id")]
    ).drop("cookie_id")
    found, unknown = flt.split_rejects(requests.join(first, "request_id", "left"), [("not found", F.col("cart_id").isNull())])
    admitted, refused = admit(cat, found)
    # The first conversion gives its booking a new row version; later carts of the batch hold a stale copy.
    first_of = admitted.filter(F.col("booking_id").isNotNull()).groupBy("booking_id").agg(F.min("request_id").alias("__first"))
    accepted, late = flt.split_rejects(admitted.join(first_of, "booking_id", "left"), [("stale copy", F.col("request_id") > F.col("__first"))])
    columns = [*requests.columns, "reject_reason"]
    return accepted.drop("__first"), unknown.select(*columns).unionByName(refused.select(*columns)).unionByName(late.select(*columns))


def _bundle_prices(cat: Catalog) -> DataFrame:
    """Price, name and tax of each bundle schedule."""
    schedule = cat.table("product.BundleSchedule", "id", "bundle_id", "amount").toDF("bundle_schedule_id", "bundle_id", "list_price")
    bundle = cat.table("product.Bundle", "id", "name", "external_id", "category_id", "deposit_price").toDF("bundle_id", "bundle_name", "external_id", "category_id", "bundle_deposit")
    category = cat.table("product.Category", "id", "is_taxable", "tax_code").withColumnRenamed("id", "category_id")
    return schedule.join(bundle, "bundle_id").join(category, "category_id", "left").withColumn("in_category", F.col("is_taxable").isNotNull() | F.col("tax_code").isNotNull())


def _open_bookings(cat: Catalog, new: DataFrame, prices: DataFrame, now: Column) -> DataFrame:
    level = cat.table("product.BundleProduct", "bundle_id", "ticket_id").join(cat.table("product.Ticket", "id", "product_level_id").withColumnRenamed("id", "ticket_id"), "ticket_id").groupBy(
        "bundle_id"
    ).agg(F.min_by("product_level_id", "ticket_id").alias("product_level_id"))
    park = cat.table("park.Park", "id", "booking_deposit_amount").withColumnRenamed("id", "park_id")
    carts = cat.table("booking.Cart", "id", "created_by", "created_date").toDF("cart_id", "cart_created_by", "cart_created_date")
    base = prices.select(F.col("bundle_schedule_id").alias("base_bundle_schedule_id"), "bundle_id", "bundle_deposit")
    return (
        new.drop("product_level_id", "booking_id").join(base, "base_bundle_schedule_id").join(level, "bundle_id", "left").join(park, "park_id").join(carts, "cart_id")
        .withColumns(
            {
                "deposit_price": F.coalesce("deposit_price", "bundle_deposit", "booking_deposit_amount"), "has_protection_plan": F.lit(False), "booked": now,
                "created_by": F.col("cart_created_by"), "created_date": F.col("cart_created_date"), "modified_by": F.col("cart_created_by"), "modified_date": now, "is_special_event": F.lit(False),
            }
        )
        .select(
            "request_id", "park_id", "account_id", "schedule_detail_id", "product_level_id", "requires_handicap", "deposit_price", "has_protection_plan", "internal_notes", "external_notes",
            "booked", "created_by", "created_date", "modified_by", "modified_date", "is_special_event", "promotion_id", "is_ai",
        )
    )


def _bookings(cat: Catalog, changed: DataFrame, now: Column) -> DataFrame:
    """Existing bookings take the cart's slot, level, notes and promotion; the deposit stays if there is one."""
    booking = cat.table("booking.Booking")
    park = cat.table("park.Park", "id", "booking_deposit_amount").withColumnRenamed("id", "park_id")
    taken = ["schedule_detail_id", "product_level_id", "requires_handicap", "internal_notes", "external_notes", "promotion_id"]
    change = changed.select(F.col("booking_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in taken], F.col("modified_by").alias("__user"), F.coalesce("clear_party_host", F.lit(False)).alias("__clear"))
    rows = booking.join(change, "id", "left").join(park, "park_id", "left")
    hit = F.col("__user").isNotNull() | F.col("__clear").isNotNull()
    new = {
        **{c: F.col(f"__{c}") for c in taken}, "deposit_price": F.coalesce("deposit_price", "booking_deposit_amount"), "party_host_id": F.when(~F.col("__clear"), F.col("party_host_id")),
        "modified_by": F.col("__user"), "modified_date": now,
    }
    return rows.select(*[F.when(hit, new[c].cast(booking.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in booking.columns])


def _guests(cat: Catalog, carts: DataFrame) -> DataFrame:
    target = cat.table("booking.BookingGuestOfHonor")
    named = cat.table("booking.CartGuestOfHonor", "cart_id", "first_name", "last_name", "date_of_birth").join(carts.select("cart_id", "booking_id"), "cart_id")
    rows = mg.with_new_ids(named, target, ["booking_id", "first_name", "last_name", "date_of_birth"])
    return mg.replace_children(target, _typed(rows, target), carts.filter(~F.col("is_new")), "booking_id")


def _fees(cat: Catalog, carts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New bookings get their park's booking fees; the second result links fee ids to invoice lines."""
    target = cat.table("booking.BookingFee")
    due = carts.filter(F.col("is_new")).select("booking_id", "park_id").join(valid_booking_fees(cat, now), "park_id")
    rows = mg.with_new_ids(due, target, ["booking_id", "product_fee_id"])
    links = rows.select("booking_id", F.col("product_fee_id").cast("string").alias("external_id"), F.col("id").cast("long").alias("booking_fee_id"))
    return target.unionByName(_typed(rows, target)), links


def _participants(cat: Catalog, carts: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, extra and adult participants: inserted for new bookings, updated for known ones.

    An unchanged bundle keeps its agreed price; an adult price of 0 becomes half the extra price.
    """
    target = cat.table("booking.BookingParticipant")
    wanted = mg.fan_out(
        carts, ["booking_id", "is_new"],
        [
            {"participant_type_id": F.lit(kind), "bundle_schedule_id": F.col(f"{name}_bundle_schedule_id").cast("long"), "count": F.col(f"{name}_participant_count").cast("long")}
            for kind, name in KINDS.items()
        ],
    ).filter(F.col("bundle_schedule_id").isNotNull())
    offered = wanted.join(prices.filter("in_category").drop("bundle_id", "category_id", "bundle_deposit", "in_category"), "bundle_schedule_id")
    old = target.select("booking_id", "participant_type_id", F.col("bundle_schedule_id").alias("old_schedule_id"), F.col("price").alias("old_price"))
    extra = codes.PARTICIPANT_EXTRA
    # A new booking's extra price is the list price; a known one's is its agreed price before this change,
    # or the one just set where it changes too.
    priced = offered.join(old, ["booking_id", "participant_type_id"], "left").withColumn("plain_price", X.keep_price("bundle_schedule_id", "old_schedule_id", "old_price", "list_price"))
    extra_new = priced.filter(F.col("participant_type_id") == extra).select("booking_id", F.col("plain_price").alias("extra_price"))
    extra_old = old.filter(F.col("participant_type_id") == extra).select("booking_id", F.col("old_price").alias("agreed_extra_price"))
    full = priced.join(extra_new, "booking_id", "left").join(extra_old, "booking_id", "left").withColumn("ep", F.coalesce("extra_price", "agreed_extra_price"))
    adult_list = F.when(F.col("participant_type_id") == codes.PARTICIPANT_ADULT, X.half_price("list_price", "ep")).otherwise(F.col("list_price"))
    changed_price = X.keep_price("bundle_schedule_id", "old_schedule_id", "old_price", adult_list)
    rows = full.withColumn(
        "price", F.when(F.col("is_new"), F.when(F.col("participant_type_id") == codes.PARTICIPANT_ADULT, F.coalesce(adult_list, X.zero())).otherwise(F.col("list_price"))).otherwise(changed_price)
    )
    columns = ["bundle_schedule_id", "bundle_name", "count", "price", "is_taxable", "tax_code", "external_id"]
    keys = ["booking_id", "participant_type_id"]
    rows = materialise(rows.select(*keys, "is_new", *columns))
    known = carts.filter(~F.col("is_new")).select("booking_id").distinct()
    updated = mg.upsert(target.join(known, "booking_id", "left_semi").select(*target.columns), rows.filter(~F.col("is_new")), keys, overwrite=columns, insert=False)
    inserted = mg.with_new_ids(rows.filter(F.col("is_new")), target, keys)
    seats = materialise(updated.unionByName(_typed(inserted, target)))
    fresh = seats.join(known, "booking_id", "left_anti")
    links = fresh.select("booking_id", "external_id", F.col("id").cast("long").alias("booking_participant_id"))
    return target.join(known, "booking_id", "left_anti").select(*target.columns).unionByName(seats), seats, links


def _resources(cat: Catalog, carts: DataFrame) -> DataFrame:
    """The booked resource; its price changes only with its type."""
    target = cat.table("booking.BookingResource")
    kind = cat.table("booking.ResourceType", "id", "name").toDF("resource_type_id", "resource_type_name")
    share = cat.table("booking.LocationResourceType", "location_id", "resource_type_id", "percent_allocation").withColumnRenamed("location_id", "park_id")
    resource = cat.table("booking.Resource", "id", "name", "resource_type_id", "price").toDF("resource_id", "resource_name", "resource_type_id", "price")
    slot = cat.table("booking.ScheduleDetails", "id", "resource_id").toDF("schedule_detail_id", "resource_id")
    rows = carts.select("booking_id", "park_id", "schedule_detail_id", "is_new").join(slot, "schedule_detail_id").join(resource, "resource_id").join(kind, "resource_type_id").join(
        share, ["park_id", "resource_type_id"]
    )
    old = target.select("booking_id", F.col("resource_type_name").alias("old_type"), F.col("price").alias("old_price"))
    known = rows.filter(~F.col("is_new")).join(old, "booking_id").withColumn("price", X.keep_price("resource_type_name", "old_type", "old_price", "price"))
    columns = ["resource_type_name", "resource_name", "price", "percent_allocation"]
    updated = mg.upsert(target, known.select("booking_id", *columns), ["booking_id"], overwrite=columns, insert=False)
    return updated.unionByName(_typed(rows.filter("is_new"), target))


def _items(cat: Catalog, carts: DataFrame, kept: DataFrame, participants: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Cart items as booking items, with their share of the bundle or of the resource modifier."""
    wanted = cat.table("booking.CartItem", "id", "cart_id", "park_product_id", "ticket_id", "included", "quantity", "price", "related_schedule_detail_id", "related_bundle_schedule_id").withColumnRenamed(
        "id", "cart_item_id"
    ).join(carts.select("cart_id", "booking_id", "modified_by"), "cart_id")
    product = cat.table("prdct.ParkProduct", "id", "name", "is_taxable", "tax_code", "park_id", "product_modifier_type_id").toDF(
        "park_product_id", "product_name", "product_taxable", "product_tax_code", "product_park_id", "product_modifier_type_id"
    )
    channel = cat.table("prdct.ProductChannelProduct", "park_product_id", "external_id").withColumnRenamed("external_id", "channel_external_id")
    ticket = cat.table("product.Ticket", "id", "name", "external_id", "category_id").toDF("ticket_id", "ticket_name", "ticket_external_id", "category_id").join(
        cat.table("product.Category", "id", "is_taxable", "tax_code").toDF("category_id", "category_taxable", "category_tax_code"), "category_id", "left"
    )
    schedule = cat.table("product.BundleSchedule", "id", "bundle_id").toDF("related_bundle_schedule_id", "bundle_id")
    content = cat.table("product.BundleProduct", "bundle_id", "park_product_id", "ticket_id", "percent_allocation")
    # A bundle lists an item as product or as ticket: two equi-joins in place of an OR.
    by_product = content.filter(F.col("park_product_id").isNotNull()).select("bundle_id", "park_product_id", F.col("percent_allocation").alias("product_share"))
    by_ticket = content.filter(F.col("ticket_id").isNotNull()).select("bundle_id", "ticket_id", F.col("percent_allocation").alias("ticket_share"))
    seat = participants.groupBy("booking_id", F.col("bundle_schedule_id").alias("related_bundle_schedule_id")).agg(F.min("id").alias("related_booking_participant_id"))
    slot = cat.table("booking.ScheduleDetails", "id", "resource_id").toDF("related_schedule_detail_id", "resource_id").join(
        cat.table("booking.Resource", "id", "resource_type_id").toDF("resource_id", "resource_type_id"), "resource_id", "left"
    )
    modifier = cat.table("booking.ParkResourceTypeModifier", "park_id", "resource_type_id", "product_modifier_type_id", "percent_allocation", "quantity", "deleted").filter(F.col("deleted").isNull()).toDF(
        "product_park_id", "resource_type_id", "product_modifier_type_id", "modifier_share", "modifier_quantity", "__deleted"
    ).drop("__deleted")
    rows = (
        wanted.join(product, "park_product_id", "left").join(channel, "park_product_id", "left").join(ticket, "ticket_id", "left").join(schedule, "related_bundle_schedule_id", "left")
        .join(by_product, ["bundle_id", "park_product_id"], "left").join(by_ticket, ["bundle_id", "ticket_id"], "left").join(seat, ["booking_id", "related_bundle_schedule_id"], "left")
        .join(slot, "related_schedule_detail_id", "left").join(modifier, ["product_park_id", "resource_type_id", "product_modifier_type_id"], "left")
    )
    prorated = (F.col("modifier_share").cast("double") / F.col("modifier_quantity").cast("double") * F.col("quantity")).cast(X.MONEY)
    stamp = {"created_by": F.col("modified_by"), "created_date": now, "modified_date": now}
    ready = rows.withColumns(
        {
            "park_product_name": F.coalesce("product_name", "ticket_name"), "is_taxable": F.coalesce("product_taxable", "category_taxable"), "tax_code": F.coalesce("product_tax_code", "category_tax_code"),
            "external_id": X.concat_nn(F.coalesce("channel_external_id", "ticket_external_id"), F.lit("-C"), "cart_item_id"),
            "percent_allocation": F.coalesce(F.col("product_share"), F.col("ticket_share"), prorated),
            "related_booking_resource_id": F.when(F.col("related_schedule_detail_id").isNotNull(), F.col("booking_id")), **stamp,
        }
    )
    numbered = materialise(_typed(mg.with_new_ids(ready, kept, ["booking_id", "cart_item_id", "external_id"]), kept))
    links = numbered.select("booking_id", "external_id", F.col("id").cast("long").alias("booking_item_id"))
    return kept.unionByName(numbered), links


def _contracts(cat: Catalog, carts: DataFrame, now: Column) -> DataFrame:
    """Accepted documents of new bookings: all active ones of the park, signed by the account's owner."""
    documents = cat.table("park.ParkDocument", "id", "park_id", "document_type", "is_active").filter(
        F.col("is_active") & F.col("document_type").isin(codes.ACCEPTED_DOCUMENT_TYPES)
    ).select("park_id", F.col("id").alias("park_document_id"))
    owner = cat.table("acct.AccountPerson", "account_id", "person_id", "account_role_id").filter(F.col("account_role_id") == codes.ROLE_OWNER).groupBy("account_id").agg(
        F.min("person_id").alias("person_id")
    )
    return carts.filter("is_new").select("account_id", "park_id").join(documents, "park_id").join(owner, "account_id", "left").select(
        "account_id", "person_id", "park_id", "park_document_id", now.alias("signed_on_date"), F.lit(codes.OPEN_END).cast("date").alias("expiration_date")
    )


def _assign_headers(cat: Catalog, carts: DataFrame) -> DataFrame:
    headers = cat.table("invoice.InvoiceHeader")
    named = carts.filter(F.col("invoice_header_id").isNotNull()).select(F.col("invoice_header_id").alias("id"), "booking_id", F.col("request_id").alias("sequence"))
    return mg.upsert(headers, named, ["id"], overwrite=["booking_id"], sequence="sequence", insert=False)


def _link_details(details: DataFrame, owned: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Invoice lines of converted bookings point at the new items, participants and fees, and at the resource."""
    mine = owned.select("invoice_header_id", "booking_id", F.col("modified_by").alias("__user"))
    chosen = links.groupBy("booking_id", "external_id").agg(
        F.max("booking_item_id").alias("__item"), F.max("booking_participant_id").alias("__participant"), F.max("booking_fee_id").alias("__fee"), F.lit(True).alias("__linked")
    )
    rows = details.join(mine, "invoice_header_id", "left").join(chosen, ["booking_id", "external_id"], "left")
    linked = F.coalesce("__linked", F.lit(False))
    resource = F.coalesce(
        F.col("booking_id").isNotNull() & (F.col("invoice_detail_status_id") == codes.STATUS_ACTIVE) & (F.col("external_id").endswith("-R") | (F.col("external_id") == "Resource")), F.lit(False)
    )
    new = {
        "booking_item_id": F.when(linked, F.col("__item")).otherwise(F.col("booking_item_id")), "booking_participant_id": F.when(linked, F.col("__participant")).otherwise(F.col("booking_participant_id")),
        "booking_fee_id": F.when(linked, F.col("__fee")).otherwise(F.col("booking_fee_id")), "booking_resource_id": F.when(resource, F.col("booking_id")).otherwise(F.col("booking_resource_id")),
        "modified_by": F.when(linked | resource, F.col("__user")).otherwise(F.col("modified_by")), "modified_date": now,
    }
    if "modified_date" in details.columns:
        new["modified_date"] = F.when(linked | resource, now).otherwise(F.col("modified_date"))
    return rows.select(*[new[c].cast(details.schema[c].dataType).alias(c) if c in new else F.col(c) for c in details.columns])


def _discounts(cat: Catalog, carts: DataFrame, promoted: DataFrame, details: DataFrame, owned: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Promotion and entitlement discounts, and the invoice lines they belong to."""
    target = cat.table("booking.BookingDiscount")
    mine = carts.select("booking_id", "modified_by", "is_new", "account_entitlement_id")
    promotions = cat.table("booking.Promotion", "id", "discount", "is_percentage", "code").withColumnRenamed("id", "promotion_id")
    given = promoted.join(mine, "booking_id").join(promotions, "promotion_id").filter(F.abs("discount") > 0).select(
        "booking_id", F.abs("discount").alias("amount"), "is_percentage", F.concat(F.lit("Promotion - "), "code").alias("description"), "promotion_id", F.lit(None).cast("int").alias("account_entitlement_id"),
        "modified_by", F.lit(None).cast("string").alias("detail_key"),
    )
    lines = details.join(owned.select("invoice_header_id", "booking_id", "modified_by", "account_entitlement_id").withColumnRenamed("modified_by", "__user"), "invoice_header_id")
    active = F.col("invoice_detail_status_id") == codes.STATUS_ACTIVE
    entitled = lines.filter(
        F.col("account_entitlement_id").isNotNull() & active & F.col("description").like("Entitlement - %") & (F.abs("unit_principle") > 0) & (F.abs("unit_tax") > 0) & (F.abs("quantity") > 0)
    ).select(
        "booking_id", X.money(F.abs((F.col("unit_principle") + F.col("unit_tax")) * F.col("quantity"))).alias("amount"), F.lit(False).alias("is_percentage"), "description",
        F.lit(None).cast("int").alias("promotion_id"), "account_entitlement_id", F.col("__user").alias("modified_by"), F.col("id").cast("string").alias("detail_key"),
    )
    new = materialise(mg.with_new_ids(given.unionByName(entitled), target, ["booking_id", "description", "detail_key"]))
    # Old entitlements always go; old promotions go when a known booking is changed.
    changed = mine.select("booking_id", F.col("is_new").alias("__new")).distinct()
    old = target.join(changed, "booking_id", "left").withColumn(
        "__drop", F.col("__new").isNotNull() & (F.col("account_entitlement_id").isNotNull() | (F.col("promotion_id").isNotNull() & ~F.col("__new")))
    )
    kept = old.withColumn("deleted", F.when(F.col("__drop"), now).otherwise(F.col("deleted"))).select(*target.columns)
    discounts = kept.unionByName(_typed(new.withColumns({"created_by": F.col("modified_by"), "created_date": now, "modified_date": now}), target))
    withdrawn = old.filter("__drop").select(F.col("id").alias("booking_discount_id"), F.lit(True).alias("__gone"))
    by_name = new.filter(F.col("promotion_id").isNotNull()).groupBy("booking_id", "description").agg(F.max("id").alias("__promo"))
    by_line = new.filter(F.col("detail_key").isNotNull()).select(F.col("detail_key").alias("__key"), F.col("id").alias("__entitled"))
    place = owned.select("invoice_header_id", "booking_id")
    rows = (
        details.withColumn("__key", F.col("id").cast("string")).join(withdrawn, "booking_discount_id", "left").join(place, "invoice_header_id", "left").join(by_name, ["booking_id", "description"], "left")
        .join(by_line, "__key", "left")
    )
    counts = active & (F.col("unit_principle") != 0) & (F.col("quantity") != 0)
    link = F.coalesce(
        F.col("__entitled"), F.when(counts, F.col("__promo")), F.when(F.col("__gone").isNull(), F.col("booking_discount_id"))
    )
    linked = rows.withColumn("booking_discount_id", link.cast(details.schema["booking_discount_id"].dataType)).select(*details.columns)
    return discounts, linked
