"""Invoice, payment and special-event documents for every requested key.

Each level of nesting is aggregated once from the leaves upward; a key with very many children comes
back as several parts (see operators.documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.operators import documents as doc
from turnstile.sources.catalog import Catalog


def _camel(names: list[str]) -> dict[str, str]:
    """Member names of a document for columns in snake case."""
    return {"".join(word.capitalize() for word in n.split("_")): n for n in names}


def _wanted(df: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    return df if keys is None else df.join(keys.select(key).distinct(), key, "left_semi")


def _nested(df: DataFrame, paths: dict, keep: list[str]) -> DataFrame:
    return doc.nest_paths(df, paths, keep=keep)


# --- invoices ------------------------------------------------------------------------------------

DETAIL = ["id", "description", "unit_principle", "unit_tax", "quantity", "external_id", "detail_type_id", "related_invoice_detail_id"]
ALLOCATION = ["payment_id", "id", "invoice_detail_id", "paid_principle", "paid_tax"]


def _active_details(cat: Catalog, *columns: str) -> DataFrame:
    return cat.table("invoice.InvoiceDetail", "invoice_header_id", "invoice_detail_status_id", *columns).filter(
        F.col("invoice_detail_status_id") == codes.STATUS_ACTIVE
    ).drop("invoice_detail_status_id")


def _active_allocations(cat: Catalog) -> DataFrame:
    return cat.table("invoice.PaymentInvoiceDetail", *ALLOCATION, "payment_invoice_detail_status_id").filter(
        F.col("payment_invoice_detail_status_id") == codes.STATUS_ACTIVE
    ).drop("payment_invoice_detail_status_id")


def _cards(cat: Catalog, *columns: str) -> DataFrame:
    return cat.table("acct.PaymentMethod", "id", *columns).withColumnRenamed("id", "payment_method_id")


def invoice_documents(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(invoice_header_id, document columns); `ids`: invoice_header_id, or all invoices."""
    header = _wanted(
        cat.table("invoice.InvoiceHeader", "id", "confirmation_code", "account_id", "location_id", "currency_id").withColumnRenamed("id", "invoice_header_id"), ids, "invoice_header_id"
    )
    account = cat.table("acct.Account", "id", "person_id").toDF("account_id", "person_id").join(
        cat.table("acct.Person", "id", "first_name", "last_name", "email_address").withColumnRenamed("id", "person_id"), "person_id"
    )
    places = cat.table("park.Park", "id", "name", "brand_id").toDF("location_id", "location_name", "brand_id").join(
        cat.table("dbo.Brands", "id", "name").toDF("brand_id", "brand_name"), "brand_id"
    )
    parents = (
        header.join(cat.table("currency.Currency", "id", "code").toDF("currency_id", "currency_code"), "currency_id").join(places, "location_id").join(account, "account_id")
    )
    details = doc.child_arrays(_wanted(_active_details(cat, *DETAIL), ids, "invoice_header_id"), "invoice_header_id", _camel(DETAIL), ["id"], "invoice_details")
    payment_columns = ["id", "card_reader_id", "amount", "fee_amount", "payment_status_id", "payment_origin_id", "is_deposit"]
    payments = _wanted(cat.table("invoice.Payment", "invoice_header_id", "payment_method_id", *payment_columns), ids, "invoice_header_id").join(
        _cards(cat, "last_four"), "payment_method_id", "left"
    )
    # Allocations are listed for kept payments only; the others stay, without a list.
    kept = payments.filter(F.col("payment_status_id").isin(codes.PAYMENT_KEPT)).select(F.col("id").alias("payment_id"))
    allocations = doc.child_arrays(
        _active_allocations(cat).join(kept, "payment_id", "left_semi").withColumn("owner", F.col("payment_id")), "owner", _camel(ALLOCATION), ["id"], "allocations"
    ).withColumnRenamed("owner", "id")
    listed = doc.attach_children(payments, "id", [allocations])
    members = {**_camel(payment_columns), "PaymentMethod": {"LastFour": "last_four"}, "PaymentInvoiceDetails": "allocations"}
    payment_arrays = doc.child_arrays(listed, "invoice_header_id", members, ["id"], "payments")
    rows = doc.attach_children(parents, "invoice_header_id", [details, payment_arrays])
    return _nested(
        rows,
        {
            "Id": "invoice_header_id", "ConfirmationCode": "confirmation_code", "Account.PrimaryAccountHolder.FirstName": "first_name",
            "Account.PrimaryAccountHolder.LastName": "last_name", "Account.PrimaryAccountHolder.EmailAddress": "email_address", "Location.Name": "location_name",
            "Location.Brand.Name": "brand_name", "Currency.Code": "currency_code", "InvoiceDetails": "invoice_details", "Payments": "payments",
        },
        ["invoice_header_id"],
    )


# --- invoices by confirmation code ------------------------------------------------------------------

def _subscription_view(cat: Catalog) -> DataFrame:
    """Subscriptions with product, ticket, level colours and person."""
    levels = cat.table("prdct.ProductLevel", "id", "web_color")
    product = (
        cat.table("prdct.ParkProduct", "id", "name", "product_level_id", "product_template_id", "is_combo").toDF("product_id", "product_name", "product_level_id", "product_template_id", "is_combo")
        .join(levels.toDF("product_level_id", "product_color"), "product_level_id", "left")
        .join(
            cat.table("prdct.ProductTemplate", "id", "product_type_id", "billing_interval", "valid_from_offset", "expiration_type_id", "valid_to_offset").withColumnRenamed("id", "product_template_id"),
            "product_template_id", "left",
        ).drop("product_level_id", "product_template_id")
    )
    ticket = cat.table("product.Ticket", "id", "name", "product_level_id").toDF("ticket_id", "ticket_name", "product_level_id").join(
        levels.toDF("product_level_id", "ticket_color"), "product_level_id", "left"
    ).drop("product_level_id")
    person = cat.table("acct.Person", "id", "first_name", "last_name").withColumnRenamed("id", "person_id")
    return (
        cat.table("acct.Subscription", "id", "account_id", "person_id", "product_id", "ticket_id", "upgraded_from_subscription_id").withColumnRenamed("id", "subscription_id")
        .withColumnRenamed("account_id", "subscription_account_id").join(product, "product_id", "left").join(ticket, "ticket_id", "left").join(person, "person_id", "left")
    )


_SUBSCRIPTION = {
    "Id": "known_subscription_id", "ProductId": "product_id", "TicketId": "ticket_id", "UpgradedFromSubscriptionId": "upgraded_from_subscription_id",
    "ParkProduct": {
        "Name": "product_name", "ProductLevel": {"WebColor": "product_color"},
        "ProductTemplate": {
            "ProductTypeId": "product_type_id", "BillingInterval": "billing_interval", "ValidFromOffset": "valid_from_offset", "ExpirationTypeId": "expiration_type_id",
            "ValidToOffset": "valid_to_offset",
        },
    },
    "Ticket": {"Name": "ticket_name", "ProductLevel": {"WebColor": "ticket_color"}}, "Person": {"FirstName": "first_name", "LastName": "last_name"},
}
CODE_DETAIL = [
    "unit_principle", "bundled_item_principle", "external_id", "unit_tax", "id", "product_fee_id", "item_fee_id", "description", "quantity", "adhoc_discount_reason_id", "detail_type_id",
    "related_invoice_detail_id", "tax_code", "is_taxable",
]
CODE_PAYMENT = [
    "id", "external_id", "checkout_id", "card_reader_id", "idempotency_key", "payment_status_id", "failure_message", "failure_reason_id", "amount", "fee_amount", "payment_channel_id", "is_deposit",
    "remaining_balance",
]


def invoice_documents_by_code(cat: Catalog, keys: DataFrame) -> DataFrame:
    """(invoice_header_id, document columns) for `keys`: confirmation_code, account_id."""
    header = cat.table("invoice.InvoiceHeader", "id", "invoice_status_id", "account_id", "notes", "tax_exempt_id", "booking_id", "location_id", "confirmation_code").withColumnRenamed(
        "id", "invoice_header_id"
    ).join(keys.select("confirmation_code", "account_id").distinct(), ["confirmation_code", "account_id"], "left_semi")
    brands = cat.table("park.Park", "id", "brand_id").toDF("location_id", "brand_id")
    ids = header.select("invoice_header_id")
    view = _subscription_view(cat).withColumn("known_subscription_id", F.col("subscription_id"))
    combo = F.coalesce(F.col("is_combo"), F.lit(False))

    payments = _wanted(cat.table("invoice.Payment", "invoice_header_id", "payment_method_id", *CODE_PAYMENT), ids, "invoice_header_id").join(_cards(cat, "last_four"), "payment_method_id", "left")
    payment_arrays = doc.child_arrays(payments, "invoice_header_id", {**_camel(CODE_PAYMENT), "PaymentMethod": {"LastFour": "last_four"}}, ["id"], "payments")

    details = _wanted(_active_details(cat, "subscription_id", *CODE_DETAIL), ids, "invoice_header_id")
    # Allocations count when their payment belongs to the same invoice as the detail.
    payer = payments.select(F.col("id").alias("payment_id"), F.col("invoice_header_id").alias("payer_header_id"))
    owned = (
        _active_allocations(cat).drop("id").join(payer, "payment_id").withColumnRenamed("payer_header_id", "invoice_header_id").withColumn("detail_key", F.col("invoice_detail_id"))
    )
    allocations = doc.child_arrays(
        owned, ["invoice_header_id", "detail_key"], _camel(["payment_id", "invoice_detail_id", "paid_principle", "paid_tax"]), ["payment_id", "paid_principle"], "allocations"
    ).withColumnRenamed("detail_key", "id")
    listed = (
        doc.attach_children(details, ["invoice_header_id", "id"], [allocations]).join(view, "subscription_id", "left")
        .withColumn("is_combo_item", combo)
    )
    # Lines with a subscription come before fees, discounts and tips.
    order = [F.when(F.col("subscription_id").isNull(), 1).otherwise(0), "id"]
    detail_arrays = doc.child_arrays(
        listed, "invoice_header_id", {**_camel(CODE_DETAIL), "IsComboItem": "is_combo_item", "Subscription": _SUBSCRIPTION, "PaymentInvoiceDetails": "allocations"}, order, "invoice_details"
    )
    redeemed = _wanted(cat.table("invoice.InvoiceRedemptionDetail", "invoice_header_id", "subscription_id"), ids, "invoice_header_id").join(view, "subscription_id").withColumns(
        {"is_combo_item": combo, "one": F.lit(1)}
    )
    redemption_member = {
        "Subscription": {
            "Id": "known_subscription_id", "ProductId": "product_id", "TicketId": "ticket_id", "PersonId": "person_id", "AccountId": "subscription_account_id", "Quantity": "one",
            "ParkProduct": {"Name": "product_name", "ProductLevel": {"WebColor": "product_color"}}, "Ticket": {"Name": "ticket_name", "ProductLevel": {"WebColor": "ticket_color"}},
            "Person": {"FirstName": "first_name", "LastName": "last_name"},
        },
        "IsComboItem": "is_combo_item",
    }
    redemption_arrays = doc.child_arrays(redeemed, "invoice_header_id", redemption_member, ["known_subscription_id"], "redemptions")
    guests = _wanted(cat.table("invoice.InvoiceHeaderParticipant", "invoice_header_id", "participant_id"), ids, "invoice_header_id").join(
        cat.table("acct.Person", "id", "first_name", "last_name").withColumnRenamed("id", "participant_id"), "participant_id"
    )
    guest_arrays = doc.child_arrays(guests, "invoice_header_id", {"Id": "participant_id", "FirstName": "first_name", "LastName": "last_name"}, ["participant_id"], "guests")
    rows = doc.attach_children(header.join(brands, "location_id", "left"), "invoice_header_id", [payment_arrays, detail_arrays, redemption_arrays, guest_arrays])
    return _nested(
        rows,
        {
            "Id": "invoice_header_id", "InvoiceStatusId": "invoice_status_id", "AccountId": "account_id", "Notes": "notes", "TaxExemptId": "tax_exempt_id", "BookingId": "booking_id",
            "InvoiceHeader.Location.Id": "location_id", "InvoiceHeader.Location.Brand.Id": "brand_id", "Payments": "payments", "InvoiceDetails": "invoice_details",
            "InvoiceRedemptionDetails": "redemptions", "SelfServiceInvoiceParticipants": "guests",
        },
        ["invoice_header_id"],
    )


# --- payments -----------------------------------------------------------------------------------------

PAYMENT = [
    "id", "invoice_header_id", "external_id", "checkout_id", "card_reader_id", "idempotency_key", "amount", "fee_amount", "payment_status_id", "payment_channel_id", "payment_method_id",
    "payment_origin_id", "sub_account_id", "refunded_payment_id", "remaining_balance", "failure_reason_id", "failure_message", "modified_by", "modified_date", "is_deposit", "application_fee_total",
]
FEE = ["id", "unit_tax", "unit_principle", "application_fee_type_id"]
PAID_DETAIL = ["id", "description", "detail_type_id", "unit_principle", "unit_tax", "quantity", "related_invoice_detail_id", "product_fee_id", "booking_fee_id"]


def _listed_details(cat: Catalog) -> DataFrame:
    """Active details, less those that hang on a subscription line not sold as an e-commerce bundle."""
    details = _active_details(cat, "subscription_id", "item_fee_id", *PAID_DETAIL)
    shop = cat.table("acct.Subscription", "id", "bundle_id").join(
        cat.table("product.Bundle", "id", "bundle_type_id").filter(F.col("bundle_type_id") == codes.BUNDLE_ECOMMERCE).select(F.col("id").alias("bundle_id")), "bundle_id"
    ).select(F.col("id").alias("subscription_id"))
    # The parent line may itself be voided; it must belong to the same invoice.
    parents = cat.table("invoice.InvoiceDetail", "id", "invoice_header_id", "subscription_id").join(shop, "subscription_id", "left_semi").select(
        F.col("id").alias("related_invoice_detail_id"), "invoice_header_id", F.lit(True).alias("shop_parent")
    )
    marked = details.join(parents, ["related_invoice_detail_id", "invoice_header_id"], "left")
    return marked.filter(F.col("related_invoice_detail_id").isNull() | F.col("subscription_id").isNull() | F.col("shop_parent").isNotNull()).drop("shop_parent", "subscription_id")


def payment_documents(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(payment_id, document columns); `ids`: payment_id, or all payments."""
    payments = cat.table("invoice.Payment", *PAYMENT)
    chosen = payments if ids is None else payments.join(ids.select(F.col("payment_id").alias("id")).distinct(), "id", "left_semi")
    key = "payment_id"
    places = (
        cat.table("invoice.InvoiceHeader", "id", "location_id").toDF("invoice_header_id", "location_id")
        .join(cat.table("park.Park", "id", "brand_id").toDF("location_id", "brand_id"), "location_id", "left")
    )
    cards = cat.table("acct.PaymentMethod", "id", "external_id", "last_four", "payment_method_type_id").toDF("payment_method_id", "card_external_id", "last_four", "payment_method_type_id").withColumn(
        "card_id", F.col("payment_method_id")
    )
    parents = chosen.withColumn(key, F.col("id")).join(cards, "payment_method_id", "left").join(places, "invoice_header_id", "left")
    targets = chosen.select(F.col("id").alias(key), "invoice_header_id")

    fee_rows = cat.table("invoice.ApplicationFeeDetail", key, *FEE)
    fees = doc.child_arrays(fee_rows, key, _camel(FEE), ["id"], "fees")

    # Refunds of a payment, each with its fees, under the adjustment invoice that made them.
    refund = payments.filter(F.col("refunded_payment_id").isNotNull()).select(
        F.col("id").alias("refund_id"), "refunded_payment_id", "amount", "fee_amount", "application_fee_total", F.col("payment_status_id").alias("refund_status")
    )
    made = cat.table("invoice.AdjustmentPayment", "id", "adjustment_invoice_id", "payment_id").toDF("adjustment_payment_id", "adjustment_invoice_id", "refund_id").join(refund, "refund_id")
    made = made.withColumnRenamed("refunded_payment_id", key)
    with_fees = made.join(fees.toDF("refund_id", "refund_fees"), "refund_id", "left")
    adjustment_key = ["adjustment_invoice_id", key]
    refunds = doc.child_arrays(
        with_fees, adjustment_key,
        {
            "Id": "adjustment_payment_id",
            "Payment": {
                "Id": "refund_id", "Amount": "amount", "FeeAmount": "fee_amount", "ApplicationFeeTotal": "application_fee_total", "RefundedPayment": {"Id": key}, "ApplicationFeeDetails": "refund_fees",
            },
        },
        ["adjustment_payment_id"], "adjustment_payments",
    )
    adjusted = _active_details(cat, "id", "unit_principle", "unit_tax", "quantity").drop("invoice_header_id").withColumnRenamed("id", "invoice_detail_id")
    kept_refunds = made.filter(F.col("refund_status").isin(codes.PAYMENT_KEPT)).select(*adjustment_key).distinct()
    detail_rows = (
        cat.table("invoice.AdjustmentDetail", "id", "adjustment_invoice_id", "invoice_detail_id", "principle_adjustment", "tax_adjustment", "quantity_adjustment").withColumnRenamed("id", "adjustment_detail_id")
        .join(adjusted, "invoice_detail_id").join(kept_refunds, "adjustment_invoice_id")
    )
    adjustments = doc.child_arrays(
        detail_rows, adjustment_key,
        {
            "Id": "adjustment_detail_id", "PrincipleAdjustment": "principle_adjustment", "TaxAdjustment": "tax_adjustment", "QuantityAdjustment": "quantity_adjustment",
            "InvoiceDetail": {"Id": "invoice_detail_id", "UnitPrinciple": "unit_principle", "UnitTax": "unit_tax", "Quantity": "quantity"},
        },
        ["adjustment_detail_id"], "adjustment_details",
    )
    invoices = cat.table("invoice.AdjustmentInvoice", "id", "invoice_header_id").withColumnRenamed("id", "adjustment_invoice_id").join(targets, "invoice_header_id")
    adjusted_invoices = doc.attach_children(invoices, adjustment_key, [refunds, adjustments])
    adjustment_arrays = doc.child_arrays(
        adjusted_invoices, key, {"Id": "adjustment_invoice_id", "AdjustmentPayments": "adjustment_payments", "AdjustmentDetails": "adjustment_details"},
        ["adjustment_invoice_id"], "adjustment_invoices",
    )
    details = _listed_details(cat)
    # Lines are packed once per invoice, however many payments show them.
    packed_lines = doc.child_arrays(details, "invoice_header_id", _camel(PAID_DETAIL), ["id"], "invoice_details")
    lines = targets.join(packed_lines, "invoice_header_id").select(key, "invoice_details")
    paid_rows = (
        _active_allocations(cat).filter((F.col("paid_principle") != 0) | (F.col("paid_tax") != 0)).withColumnRenamed("id", "allocation_id")
        .join(details.withColumnRenamed("id", "invoice_detail_id").drop("invoice_header_id"), "invoice_detail_id")
    )
    line = {"Id": "invoice_detail_id", **{m: c for m, c in _camel([*PAID_DETAIL[1:], "item_fee_id"]).items()}}
    allocations = doc.child_arrays(
        paid_rows, key, {"Id": "allocation_id", "PaidTax": "paid_tax", "PaidPrinciple": "paid_principle", "Payment": {"Id": key}, "InvoiceDetail": line}, ["allocation_id"], "allocations"
    )
    rows = doc.attach_children(parents, key, [adjustment_arrays, lines, allocations, fees])
    return _nested(
        rows,
        {
            **_camel(PAYMENT), "PaymentMethod.Id": "card_id", "PaymentMethod.ExternalId": "card_external_id", "PaymentMethod.LastFour": "last_four",
            "PaymentMethod.PaymentMethodTypeId": "payment_method_type_id", "InvoiceHeader.Id": "invoice_header_id", "InvoiceHeader.Location.Id": "location_id",
            "InvoiceHeader.Location.Brand.Id": "brand_id", "InvoiceHeader.AdjustmentInvoices": "adjustment_invoices", "InvoiceHeader.InvoiceDetails": "invoice_details",
            "PaymentInvoiceDetails": "allocations", "ApplicationFeeDetails": "fees",
        },
        [key],
    )


# --- special events -----------------------------------------------------------------------------------

BOOKING = [
    "park_id", "account_id", "schedule_detail_id", "party_host_id", "requires_handicap", "has_protection_plan", "internal_notes", "external_notes", "booked", "paid", "invoice_id", "canceled",
    "deleted", "row_ver", "deposit_price", "is_special_event", "product_level_id",
]
SPECIAL_EVENT = [
    "organization_name", "tax_code", "is_tax_exempt", "contact_first_name", "contact_last_name", "phone_number", "base_price", "base_participant_count", "extra_price", "extra_participant_count",
    "cookie_id", "is_quote", "is_group_sales", "expiration_date",
]


def special_event_documents(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(booking_id, document columns); `ids`: booking_id, or all special events."""
    booking = _wanted(cat.table("booking.Booking", "id", *BOOKING).withColumnRenamed("id", "booking_id"), ids, "booking_id")
    resource = cat.table("booking.Resource", "id", "name", "resource_type_id").toDF("resource_id", "resource_name", "resource_type_id").join(
        cat.table("booking.ResourceType", "id").withColumnRenamed("id", "resource_type_id"), "resource_type_id", "left_semi"
    )
    schedule = cat.table("booking.Schedule", "id", "date", "deleted").filter(F.col("deleted").isNull()).select(F.col("id").alias("schedule_id"), F.col("date").alias("schedule_date"))
    slot = cat.table("booking.ScheduleDetails", "id", "schedule_id", "resource_id", "start_hour", "end_hour").withColumnRenamed("id", "schedule_detail_id").join(schedule, "schedule_id").join(
        resource, "resource_id"
    )
    event = cat.table("booking.BookingSpecialEvent", "booking_id", *SPECIAL_EVENT)
    holder = cat.table("acct.Account", "id", "person_id").toDF("account_id", "person_id").join(
        cat.table("acct.Person", "id", "email_address").toDF("person_id", "holder_email"), "person_id"
    )
    park = (
        cat.table("park.Park", "id", "currency_id").toDF("park_id", "currency_id").join(cat.table("park.ParkEx", "park_id", "payment_processor_version"), "park_id")
        .join(cat.table("invoice.SubAccountLocation", "location_id", "sub_account_id").withColumnRenamed("location_id", "park_id"), "park_id", "left")
    )
    second = cat.table("payment.Invoice", "id").select(F.col("id").alias("invoice_id"), F.col("id").alias("second_invoice_id"))
    first = cat.table("invoice.InvoiceHeader", "id", "booking_id").filter(F.col("booking_id").isNotNull()).withColumnRenamed("id", "invoice_header_id")
    parents = (
        booking.join(slot, "schedule_detail_id").join(event, "booking_id").join(second, "invoice_id", "left").join(first, "booking_id", "left").join(holder, "account_id").join(park, "park_id")
    )
    items = doc.child_arrays(
        cat.table("booking.BookingItem", "booking_id", "id", "park_product_id", "quantity", "price", "is_taxable", "included", "deleted").filter(F.col("deleted").isNull()),
        "booking_id", _camel(["park_product_id", "quantity", "price", "is_taxable", "included"]), ["id"], "items",
    )
    kept = lambda df: df.filter(F.col("payment_status_id").isin(codes.PAYMENT_KEPT))
    members = _camel(["amount", "payment_status_id", "is_deposit"])
    second_payments = doc.child_arrays(
        kept(cat.table("payment.Payment", "invoice_id", "id", "amount", "payment_status_id", "is_deposit")), "invoice_id", members, ["id"], "second_payments"
    )
    first_payments = doc.child_arrays(
        kept(cat.table("invoice.Payment", "invoice_header_id", "id", "amount", "payment_status_id", "is_deposit")), "invoice_header_id", members, ["id"], "first_payments"
    )
    # All three lists are keyed by booking and invoices alike, so that their parts line up.
    parents = parents.withColumn("owner", F.to_json(F.struct("booking_id", "invoice_id", "invoice_header_id")))
    owners = parents.select("owner", "booking_id", "invoice_id", "invoice_header_id").distinct()
    lists = [
        owners.join(items, "booking_id").select("owner", "items"), owners.join(second_payments, "invoice_id").select("owner", "second_payments"),
        owners.join(first_payments, "invoice_header_id").select("owner", "first_payments"),
    ]
    rows = doc.attach_children(parents, "owner", lists)
    return _nested(
        rows,
        {
            "Id": "booking_id", **_camel(BOOKING), "ScheduleDetail.Id": "schedule_detail_id", "ScheduleDetail.StartHour": "start_hour", "ScheduleDetail.EndHour": "end_hour",
            "ScheduleDetail.Schedule.Id": "schedule_id", "ScheduleDetail.Schedule.Date": "schedule_date", "ScheduleDetail.Resource.ResourceType.Name": "resource_name", "Items": "items",
            **{f"SpecialEvent.{m}": c for m, c in _camel(SPECIAL_EVENT).items()}, "SpecialEvent.EmailAddress": "holder_email", "Park.Id": "park_id", "Park.CurrencyId": "currency_id",
            "Park.ParkEx.PaymentProcessorVersion": "payment_processor_version", "Park.SubAccountLocation.SubAccountId": "sub_account_id", "Invoice.Id": "second_invoice_id",
            "Invoice.Payments": "second_payments", "InvoiceHeader.Id": "invoice_header_id", "InvoiceHeader.Payments": "first_payments",
        },
        ["booking_id"],
    )
