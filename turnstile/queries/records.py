"""Documents and audit snapshots over the derived domain, flattened for the comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnstile.plans import audit, documents
from turnstile.queries.base import AS_OF, ORACLE, query
from turnstile.queries.people import valid_tokens  # noqa: F401
from turnstile.queries.reports import catalog, plain
from turnstile.session import ensure_checkpoint_dir
from turnstile.sources import sinks
from turnstile.sources.derived import with_tables


def _text(array, *fields):
    """Array of objects as 'a:b;c:d'; missing members are empty."""
    def cell(x):
        return F.concat_ws(":", *[F.coalesce(f(x).cast("string"), F.lit("")) for f in fields])

    return F.array_join(F.transform(array, cell), ";")


def _f(*path):
    def pick(x):
        for p in path:
            x = x[p]
        return x

    return pick


def _d(pick):
    return lambda x: pick(x).cast("double")


@query("invoice_documents", with_tables("""WITH d AS (SELECT invoice_header_id AS h, string_agg(id || ':' || CAST(unit_principle AS DOUBLE) || ':' || quantity || ':' || coalesce(related_invoice_detail_id, ''), ';' ORDER BY id) AS v FROM invoice_invoice_detail WHERE invoice_detail_status_id = 1 GROUP BY 1),
a AS (SELECT payment_id, string_agg(id || '/' || CAST(paid_principle AS DOUBLE), '+' ORDER BY id) AS v FROM invoice_payment_invoice_detail WHERE payment_invoice_detail_status_id = 1 GROUP BY 1),
p AS (SELECT invoice_header_id AS h, string_agg(x.id || ':' || coalesce(m.last_four, '') || ':' || coalesce(CASE WHEN x.payment_status_id IN (2, 3) THEN a.v END, ''), ';' ORDER BY x.id) AS v FROM invoice_payment x LEFT JOIN a ON a.payment_id = x.id LEFT JOIN acct_payment_method m ON m.id = x.payment_method_id GROUP BY 1)
SELECT h.id AS invoice_header_id, h.confirmation_code, c.code AS currency, k.name AS location, b.name AS brand, pe.first_name, pe.email_address, d.v AS details, p.v AS payments
FROM invoice_invoice_header h JOIN currency_currency c ON c.id = h.currency_id JOIN park_park k ON k.id = h.location_id JOIN dbo_brands b ON b.id = k.brand_id JOIN acct_account ac ON ac.id = h.account_id JOIN acct_person pe ON pe.id = ac.person_id
LEFT JOIN d ON d.h = h.id LEFT JOIN p ON p.h = h.id"""))
def invoice_documents(t):
    return _invoice_fields(documents.invoice_documents(catalog(t)))


def _invoice_fields(docs):
    holder = F.col("Account.PrimaryAccountHolder")
    allocations = lambda p: F.array_join(F.transform(p["PaymentInvoiceDetails"], lambda a: F.concat_ws("/", a["Id"], a["PaidPrinciple"].cast("double"))), "+")
    return docs.select(
        "invoice_header_id", F.col("ConfirmationCode").alias("confirmation_code"), F.col("Currency.Code").alias("currency"), F.col("Location.Name").alias("location"),
        F.col("Location.Brand.Name").alias("brand"), holder["FirstName"].alias("first_name"), holder["EmailAddress"].alias("email_address"),
        _text("InvoiceDetails", _f("Id"), _d(_f("UnitPrinciple")), _f("Quantity"), _f("RelatedInvoiceDetailId")).alias("details"),
        _text("Payments", _f("Id"), _f("PaymentMethod", "LastFour"), allocations).alias("payments"),
    )


@query("json_documents", ORACLE["invoice_documents"])
def json_documents(t):
    """Invoice documents written as JSON in a folder for each currency, and read back with their schema."""
    docs = documents.invoice_documents(catalog(t))
    folder = f"{ensure_checkpoint_dir(t.spark)}/documents-{uuid.uuid4().hex}"
    sinks.write_json_documents(docs.withColumn("currency_code", F.col("Currency.Code")), folder, ["currency_code"])
    return _invoice_fields(t.spark.read.schema(docs.schema).json(folder))


@query("invoice_documents_by_code", with_tables("""WITH a AS (SELECT x.invoice_detail_id, p.invoice_header_id AS h, string_agg(x.payment_id || '/' || CAST(x.paid_tax AS DOUBLE), '+' ORDER BY x.payment_id, x.paid_principle) AS v FROM invoice_payment_invoice_detail x JOIN invoice_payment p ON p.id = x.payment_id WHERE x.payment_invoice_detail_status_id = 1 GROUP BY 1, 2),
s AS (SELECT s.*, pr.name AS product_name, coalesce(pr.is_combo, false) AS combo, tp.product_type_id, t.name AS ticket_name, lv.web_color AS ticket_color, pe.first_name FROM acct_subscription s LEFT JOIN prdct_park_product pr ON pr.id = s.product_id LEFT JOIN prdct_product_template tp ON tp.id = pr.product_template_id
   LEFT JOIN product_ticket t ON t.id = s.ticket_id LEFT JOIN prdct_product_level lv ON lv.id = t.product_level_id LEFT JOIN acct_person pe ON pe.id = s.person_id),
d AS (SELECT i.invoice_header_id AS h, string_agg(i.id || ':' || coalesce(s.combo, false) || ':' || coalesce(CAST(s.id AS VARCHAR), '') || ':' || coalesce(s.product_name, '') || ':' || coalesce(CAST(s.product_type_id AS VARCHAR), '') || ':' || coalesce(s.ticket_color, '') || ':' || coalesce(s.first_name, '') || ':' || coalesce(a.v, ''), ';'
   ORDER BY CASE WHEN i.subscription_id IS NULL THEN 1 ELSE 0 END, i.id) AS v FROM invoice_invoice_detail i LEFT JOIN s ON s.id = i.subscription_id LEFT JOIN a ON a.invoice_detail_id = i.id AND a.h = i.invoice_header_id WHERE i.invoice_detail_status_id = 1 GROUP BY 1),
r AS (SELECT x.invoice_header_id AS h, string_agg(s.id || ':' || s.account_id || ':' || coalesce(s.ticket_name, ''), ';' ORDER BY s.id) AS v FROM invoice_invoice_redemption_detail x JOIN s ON s.id = x.subscription_id GROUP BY 1),
g AS (SELECT x.invoice_header_id AS h, string_agg(pe.id || ':' || coalesce(pe.last_name, ''), ';' ORDER BY pe.id) AS v FROM invoice_invoice_header_participant x JOIN acct_person pe ON pe.id = x.participant_id GROUP BY 1),
p AS (SELECT invoice_header_id AS h, string_agg(x.id || ':' || coalesce(x.failure_message, '') || ':' || coalesce(m.last_four, ''), ';' ORDER BY x.id) AS v FROM invoice_payment x LEFT JOIN acct_payment_method m ON m.id = x.payment_method_id GROUP BY 1)
SELECT h.id AS invoice_header_id, h.notes, h.tax_exempt_id, h.booking_id, k.brand_id, p.v AS payments, d.v AS details, r.v AS redemptions, g.v AS guests
FROM invoice_invoice_header h LEFT JOIN park_park k ON k.id = h.location_id LEFT JOIN p ON p.h = h.id LEFT JOIN d ON d.h = h.id LEFT JOIN r ON r.h = h.id LEFT JOIN g ON g.h = h.id"""))
def invoice_documents_by_code(t):
    cat = catalog(t)
    docs = documents.invoice_documents_by_code(cat, cat.table("invoice.InvoiceHeader", "confirmation_code", "account_id"))
    allocations = lambda d: F.array_join(F.transform(d["PaymentInvoiceDetails"], lambda a: F.concat_ws("/", a["PaymentId"], a["PaidTax"].cast("double"))), "+")
    return docs.select(
        "invoice_header_id", F.col("Notes").alias("notes"), F.col("TaxExemptId").alias("tax_exempt_id"), F.col("BookingId").alias("booking_id"), F.col("InvoiceHeader.Location.Brand.Id").alias("brand_id"),
        _text("Payments", _f("Id"), _f("FailureMessage"), _f("PaymentMethod", "LastFour")).alias("payments"),
        _text(
            "InvoiceDetails", _f("Id"), _f("IsComboItem"), _f("Subscription", "Id"), _f("Subscription", "ParkProduct", "Name"), _f("Subscription", "ParkProduct", "ProductTemplate", "ProductTypeId"),
            _f("Subscription", "Ticket", "ProductLevel", "WebColor"), _f("Subscription", "Person", "FirstName"), allocations,
        ).alias("details"),
        _text("InvoiceRedemptionDetails", _f("Subscription", "Id"), _f("Subscription", "AccountId"), _f("Subscription", "Ticket", "Name")).alias("redemptions"),
        _text("SelfServiceInvoiceParticipants", _f("Id"), _f("LastName")).alias("guests"),
    )


@query("payment_documents", with_tables("""WITH fee AS (SELECT payment_id, string_agg(id || '=' || CAST(unit_principle AS DOUBLE), '+' ORDER BY id) AS v FROM invoice_application_fee_detail GROUP BY 1),
shop AS (SELECT i.id, i.invoice_header_id FROM invoice_invoice_detail i JOIN acct_subscription s ON s.id = i.subscription_id JOIN product_bundle b ON b.id = s.bundle_id AND b.bundle_type_id = 1),
line AS (SELECT i.* FROM invoice_invoice_detail i WHERE i.invoice_detail_status_id = 1 AND (i.related_invoice_detail_id IS NULL OR i.subscription_id IS NULL OR EXISTS (SELECT 1 FROM shop WHERE shop.id = i.related_invoice_detail_id AND shop.invoice_header_id = i.invoice_header_id))),
lines AS (SELECT invoice_header_id AS h, string_agg(id || ':' || detail_type_id, ';' ORDER BY id) AS v FROM line GROUP BY 1),
alloc AS (SELECT a.payment_id, string_agg(a.id || ':' || CAST(a.paid_principle AS DOUBLE) || ':' || l.id || ':' || coalesce(CAST(l.item_fee_id AS VARCHAR), ''), ';' ORDER BY a.id) AS v FROM invoice_payment_invoice_detail a JOIN line l ON l.id = a.invoice_detail_id
   WHERE a.payment_invoice_detail_status_id = 1 AND (a.paid_principle <> 0 OR a.paid_tax <> 0) GROUP BY 1),
refunds AS (SELECT ap.adjustment_invoice_id AS ai, r.refunded_payment_id AS pid, bool_or(r.payment_status_id IN (2, 3)) AS kept, string_agg(ap.id || ',' || r.id || ',' || coalesce(fee.v, ''), '|' ORDER BY ap.id) AS v FROM invoice_adjustment_payment ap JOIN invoice_payment r ON r.id = ap.payment_id LEFT JOIN fee ON fee.payment_id = r.id
   WHERE r.refunded_payment_id IS NOT NULL GROUP BY 1, 2),
adj AS (SELECT d.adjustment_invoice_id AS ai, string_agg(d.id || ',' || CAST(d.principle_adjustment AS DOUBLE), '|' ORDER BY d.id) AS v FROM invoice_adjustment_detail d JOIN invoice_invoice_detail i ON i.id = d.invoice_detail_id AND i.invoice_detail_status_id = 1 GROUP BY 1),
ainv AS (SELECT p.id AS pid, string_agg(x.id || ':' || coalesce(r.v, '') || ':' || coalesce(CASE WHEN r.kept THEN adj.v END, ''), ';' ORDER BY x.id) AS v FROM invoice_payment p JOIN invoice_adjustment_invoice x ON x.invoice_header_id = p.invoice_header_id LEFT JOIN refunds r ON r.ai = x.id AND r.pid = p.id LEFT JOIN adj ON adj.ai = x.id GROUP BY 1)
SELECT p.id AS payment_id, p.external_id, m.last_four, h.location_id, k.brand_id, ainv.v AS adjustments, lines.v AS details, alloc.v AS allocations, fee.v AS fees
FROM invoice_payment p LEFT JOIN acct_payment_method m ON m.id = p.payment_method_id LEFT JOIN invoice_invoice_header h ON h.id = p.invoice_header_id LEFT JOIN park_park k ON k.id = h.location_id LEFT JOIN ainv ON ainv.pid = p.id LEFT JOIN lines ON lines.h = p.invoice_header_id
LEFT JOIN alloc ON alloc.payment_id = p.id LEFT JOIN fee ON fee.payment_id = p.id"""))
def payment_documents(t):
    docs = documents.payment_documents(catalog(t))
    fees = lambda a: F.array_join(F.transform(a, lambda f: F.concat_ws("=", f["Id"], f["UnitPrinciple"].cast("double"))), "+")
    blank = lambda c: F.coalesce(c, F.lit(""))
    refunds = lambda a: F.array_join(F.transform(a["AdjustmentPayments"], lambda r: F.concat_ws(",", r["Id"], r["Payment"]["Id"], blank(fees(r["Payment"]["ApplicationFeeDetails"])))), "|")
    adjusted = lambda a: F.array_join(F.transform(a["AdjustmentDetails"], lambda d: F.concat_ws(",", d["Id"], d["PrincipleAdjustment"].cast("double"))), "|")
    return docs.select(
        "payment_id", F.col("ExternalId").alias("external_id"), F.col("PaymentMethod.LastFour").alias("last_four"), F.col("InvoiceHeader.Location.Id").alias("location_id"),
        F.col("InvoiceHeader.Location.Brand.Id").alias("brand_id"), _text("InvoiceHeader.AdjustmentInvoices", _f("Id"), refunds, adjusted).alias("adjustments"),
        _text("InvoiceHeader.InvoiceDetails", _f("Id"), _f("DetailTypeId")).alias("details"),
        _text("PaymentInvoiceDetails", _f("Id"), _d(_f("PaidPrinciple")), _f("InvoiceDetail", "Id"), _f("InvoiceDetail", "ItemFeeId")).alias("allocations"),
        fees("ApplicationFeeDetails").alias("fees"),
    )


@query("special_event_documents", with_tables("""WITH it AS (SELECT booking_id, string_agg(park_product_id || ':' || quantity || ':' || included, ';' ORDER BY id) AS v FROM booking_booking_item WHERE deleted IS NULL GROUP BY 1),
p2 AS (SELECT invoice_id, string_agg(CAST(amount AS DOUBLE) || ':' || payment_status_id, ';' ORDER BY id) AS v FROM payment_payment WHERE payment_status_id IN (2, 3) GROUP BY 1),
p1 AS (SELECT invoice_header_id AS h, string_agg(CAST(amount AS DOUBLE) || ':' || payment_status_id, ';' ORDER BY id) AS v FROM invoice_payment WHERE payment_status_id IN (2, 3) GROUP BY 1)
SELECT b.id AS booking_id, s.date AS schedule_date, r.name AS resource_name, it.v AS items, e.organization_name, pe.email_address, px.payment_processor_version AS processor, sa.sub_account_id, i.id AS second_invoice_id, p2.v AS second_payments, h.id AS invoice_header_id, p1.v AS first_payments
FROM booking_booking b JOIN booking_schedule_details sd ON sd.id = b.schedule_detail_id JOIN booking_schedule s ON s.id = sd.schedule_id AND s.deleted IS NULL JOIN booking_resource r ON r.id = sd.resource_id JOIN booking_resource_type rt ON rt.id = r.resource_type_id
JOIN booking_booking_special_event e ON e.booking_id = b.id LEFT JOIN payment_invoice i ON i.id = b.invoice_id LEFT JOIN invoice_invoice_header h ON h.booking_id = b.id JOIN acct_account a ON a.id = b.account_id JOIN acct_person pe ON pe.id = a.person_id
JOIN park_park_ex px ON px.park_id = b.park_id LEFT JOIN invoice_sub_account_location sa ON sa.location_id = b.park_id LEFT JOIN it ON it.booking_id = b.id LEFT JOIN p2 ON p2.invoice_id = i.id LEFT JOIN p1 ON p1.h = h.id"""))
def special_event_documents(t):
    docs = documents.special_event_documents(catalog(t))
    return docs.select(
        "booking_id", F.col("ScheduleDetail.Schedule.Date").alias("schedule_date"), F.col("ScheduleDetail.Resource.ResourceType.Name").alias("resource_name"),
        _text("Items", _f("ParkProductId"), _f("Quantity"), _f("Included")).alias("items"), F.col("SpecialEvent.OrganizationName").alias("organization_name"),
        F.col("SpecialEvent.EmailAddress").alias("email_address"), F.col("Park.ParkEx.PaymentProcessorVersion").alias("processor"),
        F.col("Park.SubAccountLocation.SubAccountId").alias("sub_account_id"), F.col("Invoice.Id").alias("second_invoice_id"),
        _text("Invoice.Payments", _d(_f("Amount")), _f("PaymentStatusId")).alias("second_payments"), F.col("InvoiceHeader.Id").alias("invoice_header_id"),
        _text("InvoiceHeader.Payments", _d(_f("Amount")), _f("PaymentStatusId")).alias("first_payments"),
    )


@query("booking_audit", with_tables(f"""WITH x AS (SELECT booking_id, sum(CASE WHEN participant_type_id IN (2, 3) THEN price * count END) AS extra FROM booking_booking_participant GROUP BY 1),
it AS (SELECT booking_id, sum(price * quantity) AS v FROM booking_booking_item WHERE included = false AND deleted IS NULL GROUP BY 1),
f AS (SELECT booking_id, count(*) AS n FROM booking_booking_fee GROUP BY 1), i AS (SELECT booking_id, count(*) AS n FROM booking_booking_item WHERE deleted IS NULL GROUP BY 1)
SELECT b.id AS booking_id, CAST(coalesce(bp.price, e.base_price, 0) AS DOUBLE) AS package_price, CAST(coalesce(r.price, 0) AS DOUBLE) AS resource_price, CAST(coalesce(x.extra, e.extra_price * e.extra_participant_count, 0) AS DOUBLE) AS participant_total,
  CAST(coalesce(it.v, 0) AS DOUBLE) AS addon_total, TIMESTAMP '{AS_OF}' AS created_date, CASE WHEN s.id IS NOT NULL THEN b.id || '/' || l.name || '/' || coalesce(e.organization_name, '') || '/' || coalesce(f.n, 0) || '/' || coalesce(i.n, 0) END AS snapshot
FROM booking_booking b LEFT JOIN booking_booking_participant bp ON bp.booking_id = b.id AND bp.participant_type_id = 1 LEFT JOIN booking_booking_special_event e ON e.booking_id = b.id LEFT JOIN booking_booking_resource r ON r.booking_id = b.id LEFT JOIN x ON x.booking_id = b.id
LEFT JOIN it ON it.booking_id = b.id LEFT JOIN prdct_product_level l ON l.id = b.product_level_id LEFT JOIN booking_schedule_details sd ON sd.id = b.schedule_detail_id LEFT JOIN booking_schedule s ON s.id = sd.schedule_id AND s.deleted IS NULL AND l.id IS NOT NULL
LEFT JOIN acct_account_person ap ON ap.account_id = b.account_id AND ap.account_role_id = 2 AND s.id IS NOT NULL LEFT JOIN f ON f.booking_id = b.id LEFT JOIN i ON i.booking_id = b.id"""))
def booking_audit(t):
    rows = audit.booking_audit(catalog(t), None, "auditor", AS_OF)
    parsed = F.from_json("booking_json", "Id long, ProductLevel struct<Name: string>, SpecialEvent struct<OrganizationName: string>, Fees array<struct<Id: long>>, Items array<struct<Id: long>>")
    seen = rows.withColumn("j", parsed)
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    snapshot = F.when(
        F.col("booking_json").isNotNull(),
        F.concat_ws("/", "j.Id", "j.ProductLevel.Name", F.coalesce("j.SpecialEvent.OrganizationName", F.lit("")), size("j.Fees"), size("j.Items")),
    )
    totals = ["package_price", "resource_price", "participant_total", "addon_total"]
    return plain(seen.select("booking_id", *totals, "created_date", snapshot.alias("snapshot")), *totals)
