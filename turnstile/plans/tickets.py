"""Used tickets bought or redeemed "today" at a location, for many accounts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import filters as flt
from turnstile.plans.ledger import offset_of
from turnstile.sources.catalog import Catalog


def tickets_today(cat: Catalog, requests: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(tickets, rejected requests).

    `requests`: request_id, brand_slug, location_slug, account_id and, to ask about different days, as_of.
    A request for an unknown location is rejected.
    """
    asked = requests if "as_of" in requests.columns else requests.withColumn("as_of", X.clock(as_of))
    brands = cat.table("dbo.Brands", "id", "url_slug").toDF("brand_id", "brand_slug")
    places = cat.table("park.Park", "id", "brand_id", "url_slug", "timezone").toDF("location_id", "brand_id", "location_slug", "timezone").join(brands, "brand_id")
    located, rejected = flt.split_rejects(
        asked.join(places, ["brand_slug", "location_slug"], "left"), [("Invalid Location", F.col("location_id").isNull())]
    )
    subscriptions = cat.table("acct.Subscription", "id", "account_id", "ticket_id", "subscription_status_id").filter(
        (F.col("subscription_status_id") == codes.SUBSCRIPTION_USED) & F.col("ticket_id").isNotNull()
    ).select(F.col("id").alias("subscription_id"), "account_id", "ticket_id")
    mine = located.withColumn("today", X.local_date("as_of", "timezone")).join(subscriptions, "account_id").select(
        "request_id", "location_id", "today", "subscription_id", "ticket_id"
    )
    raw = cat.table("invoice.InvoiceHeader")
    headers = raw.select(F.col("id").alias("invoice_header_id"), "location_id", X.stored_date("created_date", offset_of(raw)).alias("created_day"))
    redemptions = cat.table("invoice.InvoiceRedemptionDetail", "subscription_id", "invoice_header_id", "modified_date")
    details = cat.table("invoice.InvoiceDetail", "subscription_id", "invoice_header_id", "invoice_detail_status_id").filter(
        (F.col("invoice_detail_status_id") == codes.STATUS_ACTIVE) & F.col("subscription_id").isNotNull()
    ).select("subscription_id", "invoice_header_id")
    redeemed = mine.join(redemptions, "subscription_id").join(headers, ["invoice_header_id", "location_id"])
    # A purchase counts only for a subscription that was never redeemed.
    bought = mine.join(redemptions, "subscription_id", "left_anti").join(details, "subscription_id").join(headers, ["invoice_header_id", "location_id"])
    arms = [redeemed.filter((F.to_date("modified_date") == F.col("today")) | (F.col("created_day") == F.col("today"))), bought.filter(F.col("created_day") == F.col("today"))]
    qualified = reduce(DataFrame.unionByName, [a.select("request_id", "subscription_id", "ticket_id") for a in arms]).distinct()
    levels = cat.table("prdct.ProductLevel", "id", "web_color").toDF("product_level_id", "color").withColumn("level_id", F.col("product_level_id"))
    tickets = cat.table("product.Ticket", "id", "name", "product_level_id").toDF("ticket_id", "name", "product_level_id").join(levels, "product_level_id", "left").select(
        "ticket_id", F.col("ticket_id").alias("known_ticket_id"), "name", "color", "level_id"
    )
    found = qualified.join(tickets, "ticket_id", "left").select(
        "request_id", "subscription_id", F.col("known_ticket_id").alias("ticket_id"), "name", "color", F.col("level_id").alias("product_level_id")
    )
    return found, rejected.select(*requests.columns, "reject_reason")
