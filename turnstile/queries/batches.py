"""Batch changes over the derived domain, with independent SQL for what they leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators import joins as jn
from turnstile.plans import carts, invoice_batch, payment_batch, special_events
from turnstile.queries.base import AS_OF, query
from turnstile.queries.reports import catalog, plain
from turnstile.sources.catalog import FrameCatalog
from turnstile.sources.derived import SPARK_TABLES, DerivedCatalog, with_tables
from turnstile.sources.sinks import materialise, stage


def _json(**members):
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]))


# --- payments -----------------------------------------------------------------------------------------

def payment_requests(t):
    """Every order makes a request: those ending in 0, 4 or 8 change their payment, all others (and 0) make a new one."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,6)")
    changed = (key % 10).isin(0, 4, 8) & (key > 0)
    fees = F.array(
        F.struct(F.lit(1).alias("ApplicationFeeTypeId"), F.lit(2.5).cast("decimal(18,6)").alias("UnitPrinciple"), F.lit(0.5).cast("decimal(18,6)").alias("UnitTax")),
        F.struct(F.lit(9).alias("ApplicationFeeTypeId"), F.lit(1).cast("decimal(18,6)").alias("UnitPrinciple"), F.lit(0).cast("decimal(18,6)").alias("UnitTax")),
    )
    return t.orders.select(
        key.alias("request_id"), F.when(changed, key).alias("payment_id"),
        _json(
            InvoiceHeaderId=key, ExternalId=F.concat(F.lit("new_"), key), Amount=price, PaymentStatusId=F.lit(3), IsDeposit=F.lit(False),
            ApplicationFeeTotal=F.when(key % 4 == 0, F.lit(2).cast("decimal(18,6)")), FailureMessage=F.when(key % 8 == 0, F.lit("late")),
        ).alias("payment"),
        F.when(changed, F.to_json(F.array(F.struct(key.alias("PaymentId"), F.concat(F.lit("n"), key).alias("InvoiceDetailId"), price.alias("PaidPrinciple"), F.lit(1).cast("decimal(18,6)").alias("PaidTax"))))).alias("allocations"),
        F.when(key % 3 != 0, F.to_json(fees)).alias("fees"),
    )


@query("apply_payments", with_tables("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 IN (0, 4, 8) AND o_orderkey > 0 AS changed, CASE WHEN o_orderkey % 4 = 0 THEN 2 END AS stated, o_orderkey % 3 <> 0 AS with_fees, CAST(o_totalprice AS DECIMAL(18,6)) AS amount, CASE WHEN o_orderkey % 8 = 0 THEN 'late' END AS failure FROM orders),
f AS (SELECT payment_id, sum(unit_principle + unit_tax) AS total, sum(CASE WHEN application_fee_type_id = 1 THEN unit_principle + unit_tax END) AS first FROM invoice_application_fee_detail GROUP BY 1),
c AS (SELECT r.*, CASE WHEN r.with_fees THEN CASE WHEN r.changed THEN coalesce(f.total, 0) - coalesce(f.first, 0) ELSE 0 END + 4 WHEN r.changed THEN f.total END AS fee_sum FROM r LEFT JOIN f ON f.payment_id = r.k)
SELECT p.external_id, CAST(p.amount AS DOUBLE) AS amount, p.payment_status_id, p.failure_message, p.invoice_header_id, CAST(p.application_fee_total AS DOUBLE) AS application_fee_total FROM invoice_payment p WHERE p.id NOT IN (SELECT k FROM r WHERE changed)
UNION ALL SELECT 'new_' || k, CAST(amount AS DOUBLE), 3, failure, k, CAST(CASE WHEN stated < fee_sum THEN fee_sum ELSE stated END AS DOUBLE) FROM c WHERE changed
UNION ALL SELECT 'new_' || k, CAST(amount AS DOUBLE), 3, failure, k, CAST(CASE WHEN stated < fee_sum THEN fee_sum ELSE stated END AS DOUBLE) FROM c WHERE NOT changed"""))
def apply_payments(t):
    tables = payment_batch.apply_payment_batch(catalog(t), payment_requests(t), "batch", AS_OF)
    rows = tables["invoice.Payment"].select("external_id", "amount", "payment_status_id", "failure_message", "invoice_header_id", "application_fee_total")
    return plain(rows, "amount", "application_fee_total")


PAID = """r AS (SELECT o_orderkey AS k, o_orderkey % 10 IN (0, 4, 8) AND o_orderkey > 0 AS changed, o_orderkey % 3 <> 0 AS with_fees FROM orders), t(type, amount) AS (VALUES (1, 2.5), (9, 1.0)),
fee AS (SELECT f.payment_id, CAST(NULL AS BIGINT) AS request_id, f.application_fee_type_id AS type, CAST(coalesce(t.amount, f.unit_principle) AS DOUBLE) AS amount
     FROM invoice_application_fee_detail f LEFT JOIN r ON r.k = f.payment_id AND r.changed AND r.with_fees LEFT JOIN t ON r.k IS NOT NULL AND t.type = f.application_fee_type_id
   UNION ALL SELECT CASE WHEN changed THEN k END, CASE WHEN NOT changed THEN k END, t.type, CAST(t.amount AS DOUBLE) FROM r CROSS JOIN t
     WHERE with_fees AND (NOT changed OR NOT EXISTS (SELECT 1 FROM invoice_application_fee_detail f WHERE f.payment_id = r.k AND f.application_fee_type_id = t.type)))"""


def by_request(rows, made, requests):
    """Rows of new payments under their request, as their ids are assigned; all others under their payment."""
    fresh = made.join(requests.filter(F.col("payment_id").isNull()).select("request_id"), "request_id", "left_semi")
    joined = rows.join(fresh, "payment_id", "left")
    return joined.withColumn("payment_id", F.when(F.col("request_id").isNull(), F.col("payment_id")))


@query("apply_payment_fees", with_tables(f"""WITH {PAID}
SELECT payment_id, request_id, type AS application_fee_type_id, amount AS unit_principle FROM fee"""))
def apply_payment_fees(t):
    """Fee rows after the batch."""
    requests = payment_requests(t)
    tables = payment_batch.apply_payment_batch(catalog(t), requests, "batch", AS_OF)
    rows = by_request(tables["invoice.ApplicationFeeDetail"], tables["requests"], requests)
    return plain(rows.select("payment_id", "request_id", "application_fee_type_id", "unit_principle"), "unit_principle")


@query("apply_payment_documents", with_tables(f"""WITH {PAID},
s AS (SELECT payment_id, request_id, count(*) AS fees, sum(amount) AS total FROM fee GROUP BY 1, 2)
SELECT CASE WHEN r.changed THEN r.k END AS payment_id, CASE WHEN NOT r.changed THEN r.k END AS request_id, 'new_' || r.k AS external_id, 3 AS status, k.brand_id, coalesce(s.fees, 0) AS fees, CAST(coalesce(s.total, 0) AS DOUBLE) AS fee_principle
FROM r LEFT JOIN invoice_payment p ON r.changed AND p.id = r.k LEFT JOIN invoice_invoice_header i ON i.id = CASE WHEN r.changed THEN p.invoice_header_id ELSE r.k END LEFT JOIN park_park k ON k.id = i.location_id
LEFT JOIN s ON CASE WHEN r.changed THEN s.payment_id ELSE s.request_id END = r.k WHERE NOT r.changed OR p.id IS NOT NULL"""))
def apply_payment_documents(t):
    """Documents of all payments concerned, read from what the batch left behind."""
    cat, requests = catalog(t), payment_requests(t)
    result = payment_batch.apply_payment_batch(cat, requests, "batch", AS_OF)
    docs = by_request(payment_batch.documents_after(cat, result), result["requests"], requests)
    total = F.aggregate("ApplicationFeeDetails", F.lit(0).cast("double"), lambda acc, f: acc + f["UnitPrinciple"].cast("double"))
    return docs.select(
        "payment_id", "request_id", F.col("ExternalId").alias("external_id"), F.col("PaymentStatusId").alias("status"), F.col("InvoiceHeader.Location.Brand.Id").alias("brand_id"),
        F.coalesce(F.array_size("ApplicationFeeDetails"), F.lit(0)).cast("long").alias("fees"), F.coalesce(total, F.lit(0.0)).alias("fee_principle"),
    )


def payment_corrections(done):
    """A second batch: every payment that the first one made or changed gets a new name and half the amount."""
    named = done["invoice.Payment"].join(done["requests"].select(F.col("payment_id").alias("id"), "request_id"), "id")
    body = _json(ExternalId=F.concat(F.lit("again_"), F.col("request_id")), Amount=(F.col("amount") / 2).cast("decimal(18,6)"), PaymentStatusId=F.lit(4), ApplicationFeeTotal=F.lit(1).cast("decimal(18,6)"))
    none = F.lit(None).cast("string")
    return named.select("request_id", F.col("id").alias("payment_id"), body.alias("payment"), none.alias("allocations"), none.alias("fees"))


@query("apply_payments_twice", with_tables(f"""WITH {PAID},
f AS (SELECT payment_id, sum(unit_principle + unit_tax) AS total, sum(CASE WHEN application_fee_type_id IN (1, 9) THEN unit_principle + unit_tax END) AS stated FROM invoice_application_fee_detail GROUP BY 1),
c AS (SELECT r.*, o_totalprice, CASE WHEN with_fees THEN coalesce(f.total, 0) - coalesce(f.stated, 0) + 4 ELSE f.total END AS fee_sum FROM r JOIN orders ON o_orderkey = r.k LEFT JOIN f ON r.changed AND f.payment_id = r.k)
SELECT external_id, CAST(amount AS DOUBLE) AS amount, payment_status_id, failure_message, CAST(application_fee_total AS DOUBLE) AS application_fee_total FROM invoice_payment WHERE id NOT IN (SELECT k FROM r WHERE changed)
UNION ALL SELECT 'again_' || k, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,6)) / 2 AS DECIMAL(18,6)) AS DOUBLE), 4, NULL, CAST(CASE WHEN fee_sum > 1 THEN fee_sum ELSE 1 END AS DOUBLE) FROM c WHERE NOT changed OR k IN (SELECT id FROM invoice_payment)"""))
def apply_payments_twice(t):
    """A second batch over the tables that the first one left behind."""
    cat = catalog(t)
    first = payment_batch.apply_payment_batch(cat, payment_requests(t), "batch", AS_OF)
    first = {name: materialise(rows) for name, rows in first.items()}
    second = payment_batch.apply_payment_batch(FrameCatalog(t.spark, first, cat), payment_corrections(first), "again", AS_OF)
    return plain(second["invoice.Payment"].select("external_id", "amount", "payment_status_id", "failure_message", "application_fee_total"), "amount", "application_fee_total")


# --- invoices -----------------------------------------------------------------------------------------

def invoice_requests(t):
    """For every order with lines: a changed part line, a promotion on it and a new line. Orders without an invoice come to nothing; 0 stands for a new invoice."""
    key = F.col("o_orderkey")
    line = lambda ident, ext, desc, parent=None, resource=None: F.struct(
        F.lit(ident).alias("Id"), desc.alias("Description"), F.lit(9).cast("decimal(18,6)").alias("UnitPrinciple"), F.lit(2).alias("Quantity"), ext.alias("ExternalId"),
        F.lit(parent).cast("string").alias("RelatedInvoiceDetailId"), F.lit(resource).cast("bigint").alias("BookingResourceId"),
    )
    part = F.concat(F.lit("X"), F.col("part"))
    details = F.array(
        line("1", part, F.when(key % 4 == 0, F.lit("changed"))), line("2", F.concat(part, F.lit("-Promo")), F.lit("promo")),
        line("3", F.concat(F.lit("N"), key), F.lit("new"), parent="1"),
    )
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("part"))
    return t.orders.join(parts, "o_orderkey").select(
        key.alias("request_id"), key.alias("invoice_header_id"), _json(InvoiceStatusId=F.lit(5), RefundedInvoiceId=F.when(key % 4 == 0, key)).alias("header"), F.to_json(details).alias("details")
    )


@query("apply_invoices", with_tables("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey = 0 THEN (SELECT max(id) + 1 FROM invoice_invoice_header) ELSE o_orderkey END AS h, 'X' || min(l_partkey) AS ext FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN invoice_invoice_header i ON i.id = o_orderkey GROUP BY o_orderkey),
paid AS (SELECT invoice_detail_id FROM invoice_payment_invoice_detail WHERE payment_invoice_detail_status_id = 1),
d AS (SELECT i.id, i.invoice_header_id, i.external_id, i.description, i.unit_principle, i.quantity, i.related_invoice_detail_id, r.h IS NOT NULL AS mine, r.ext,
   CASE WHEN r.h IS NOT NULL AND i.invoice_detail_status_id = 1 AND i.id NOT IN (SELECT invoice_detail_id FROM paid) THEN 2 ELSE i.invoice_detail_status_id END AS st FROM invoice_invoice_detail i LEFT JOIN r ON r.h = i.invoice_header_id),
u AS (SELECT *, mine AND st = 1 AND external_id = ext AS hit FROM d),
fresh AS (SELECT r.h, 'X' AS tag, r.ext AS external_id, CASE WHEN r.k % 4 = 0 THEN 'changed' END AS description FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.hit AND u.invoice_header_id = r.h)
   UNION ALL SELECT h, 'P', ext || '-Promo', 'promo' FROM r UNION ALL SELECT h, 'N', 'N' || k, 'new' FROM r)
SELECT invoice_header_id, external_id, CASE WHEN hit AND invoice_header_id % 4 = 0 THEN 'changed' ELSE description END AS description, CAST(CASE WHEN hit THEN 9 ELSE unit_principle END AS DOUBLE) AS unit_principle, CASE WHEN hit THEN 2 ELSE quantity END AS quantity,
  st AS invoice_detail_status_id, (SELECT p.external_id FROM invoice_invoice_detail p WHERE p.id = u.related_invoice_detail_id) AS parent FROM u
UNION ALL SELECT h, external_id, description, 9, 2, 1, CASE tag WHEN 'P' THEN replace(external_id, '-Promo', '') WHEN 'N' THEN (SELECT ext FROM r WHERE r.h = fresh.h) END FROM fresh"""))
def apply_invoices(t):
    tables = invoice_batch.apply_invoice_batch(catalog(t), invoice_requests(t), "batch", AS_OF)
    shown = ["invoice_header_id", "external_id", "description", "unit_principle", "quantity", "invoice_detail_status_id"]
    lines = stage(tables["invoice.InvoiceDetail"].select("id", "related_invoice_detail_id", *shown))
    parents = lines.select(F.col("id").alias("related_invoice_detail_id"), F.col("external_id").alias("parent"))
    rows = jn.left_lookup(lines, parents, "related_invoice_detail_id").select(*shown, "parent")
    return plain(rows, "unit_principle")


# --- special events -----------------------------------------------------------------------------------

def event_requests(t):
    """Every ninth order changes its special event; orders with remainder 1 open one."""
    key = F.col("o_orderkey")
    known = key % 9 == 0
    item = F.array(
        *[
            F.struct(
                (key % 200).cast("int").alias("ParkProductId"), F.lit(name).alias("ParkProductName"), F.lit(included).alias("Included"), F.lit(1).alias("Quantity"),
                F.lit(12).cast("decimal(18,6)").alias("Price"), F.lit(True).alias("IsTaxable"),
            )
            for name, included in (("cake", False), ("table", True))
        ]
    )
    base = F.when(key % 2 == 0, F.lit(0)).otherwise(F.lit(300)).cast("decimal(18,6)")
    return t.orders.filter((key % 9).isin(0, 1)).select(
        key.alias("request_id"), F.when(known, key).alias("booking_id"), F.when(key % 4 != 0, key % 1000).alias("row_ver"), (key % 5 == 0).alias("is_tax_exempt"),
        _json(
            Id=F.when(known, key), ParkId=(key % 25).cast("long"), AccountId=F.col("o_custkey"), ScheduleDetailId=F.lit(None).cast("long"), ProductLevelId=F.lit(3),
            InternalNotes=F.lit("event"), IsSpecialEvent=F.lit(True),
        ).alias("booking"),
        _json(OrganizationName=F.concat(F.lit("New "), key), BasePrice=base, ExtraPrice=F.lit(0).cast("decimal(18,6)"), ExtraParticipantCount=F.lit(3)).alias("special_event"),
        F.to_json(item).alias("items"),
    )


ADMIT = """r AS (SELECT o_orderkey AS k, o_orderkey % 9 = 0 AND o_orderkey > 0 AS known, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 1000 END AS rv, o_orderkey % 5 = 0 AS exempt, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 300 END AS base, o_orderkey % 25 AS park FROM orders WHERE o_orderkey % 9 IN (0, 1)),
ok AS (SELECT r.* FROM r LEFT JOIN booking_booking b ON b.id = r.k AND r.known WHERE NOT r.known OR (b.id IS NOT NULL AND b.paid IS NULL AND b.canceled IS NULL AND b.deleted IS NULL AND b.row_ver = r.rv))"""


@query("apply_special_events", with_tables(f"""WITH {ADMIT}
SELECT organization_name, CAST(base_price AS DOUBLE) AS base_price, base_participant_count, tax_code FROM booking_booking_special_event WHERE booking_id NOT IN (SELECT k FROM ok WHERE known)
UNION ALL SELECT 'New ' || k, CAST(base AS DOUBLE), NULL, NULL FROM ok WHERE NOT known OR k IN (SELECT booking_id FROM booking_booking_special_event)"""))
def apply_special_events(t):
    tables = special_events.apply_special_event_batch(catalog(t), event_requests(t), "batch", AS_OF)
    return plain(tables["booking.BookingSpecialEvent"].select("organization_name", "base_price", "base_participant_count", "tax_code"), "base_price")


@query("apply_special_event_rejects", with_tables(f"""WITH {ADMIT}
SELECT r.k AS request_id, CASE WHEN b.paid IS NOT NULL OR b.canceled IS NOT NULL OR b.deleted IS NOT NULL THEN 'finalised' WHEN b.id IS NULL THEN 'not found' ELSE 'stale copy' END AS reject_reason
FROM r LEFT JOIN booking_booking b ON b.id = r.k WHERE r.k NOT IN (SELECT k FROM ok)"""))
def apply_special_event_rejects(t):
    tables = special_events.apply_special_event_batch(catalog(t), event_requests(t), "batch", AS_OF)
    return tables["rejected"].select("request_id", "reject_reason")


@query("apply_special_event_fees", with_tables(f"""WITH {ADMIT},
pf AS (SELECT * FROM prdct_product_fee WHERE product_type_id = 9 AND TIMESTAMP '{AS_OF}' BETWEEN valid_from AND valid_to),
place AS (SELECT ok.*, CASE WHEN ok.known THEN b.park_id ELSE ok.park END AS at FROM ok LEFT JOIN booking_booking b ON b.id = ok.k AND ok.known)
SELECT CASE WHEN known THEN k END AS booking_id, product_fee_id, CAST(price AS DOUBLE) AS price, is_taxable FROM (
  SELECT true AS known, f.booking_id AS k, f.product_fee_id, f.price, CASE WHEN ok.k IS NOT NULL AND b.invoice_id IS NULL THEN NOT ok.exempt ELSE f.is_taxable END AS is_taxable FROM booking_booking_fee f LEFT JOIN ok ON ok.k = f.booking_id AND ok.known LEFT JOIN booking_booking b ON b.id = f.booking_id
  WHERE ok.k IS NULL OR ok.base <> 0 OR NOT EXISTS (SELECT 1 FROM booking_booking_special_event e WHERE e.booking_id = ok.k) OR ok.base <> 0
  UNION ALL SELECT p.known, p.k, pf.id, pf.amount, NOT p.exempt FROM place p JOIN pf ON pf.park_id = p.at WHERE p.base <> 0 AND (NOT p.known OR NOT EXISTS (SELECT 1 FROM booking_booking_fee f WHERE f.booking_id = p.k))) x"""))
def apply_special_event_fees(t):
    cat = catalog(t)
    tables = special_events.apply_special_event_batch(cat, event_requests(t), "batch", AS_OF)
    made = tables["requests"].join(event_requests(t).filter(F.col("booking_id").isNull()).select("request_id"), "request_id", "left_semi").select("booking_id", F.lit(True).alias("fresh"))
    fees = tables["booking.BookingFee"].join(made, "booking_id", "left")
    # Ids of new bookings are assigned, so they are not compared.
    return plain(fees.select(F.when(F.col("fresh").isNull(), F.col("booking_id")).alias("booking_id"), "product_fee_id", "price", "is_taxable"), "price")


@query("apply_special_event_audit", with_tables(f"""WITH {ADMIT},
x AS (SELECT booking_id, sum(CASE WHEN participant_type_id IN (2, 3) THEN price * count END) AS extra FROM booking_booking_participant GROUP BY 1)
SELECT CASE WHEN ok.known THEN ok.k END AS booking_id, CAST(coalesce(bp.price, CASE WHEN NOT ok.known OR e.booking_id IS NOT NULL THEN ok.base END, 0) AS DOUBLE) AS package_price,
  CAST(coalesce(r.price, 0) AS DOUBLE) AS resource_price, CAST(coalesce(x.extra, 0) AS DOUBLE) AS participant_total, CAST(12 AS DOUBLE) AS addon_total, 'batch' AS created_by
FROM ok LEFT JOIN booking_booking_participant bp ON ok.known AND bp.booking_id = ok.k AND bp.participant_type_id = 1 LEFT JOIN booking_booking_resource r ON ok.known AND r.booking_id = ok.k
LEFT JOIN booking_booking_special_event e ON ok.known AND e.booking_id = ok.k LEFT JOIN x ON ok.known AND x.booking_id = ok.k"""))
def apply_special_event_audit(t):
    """Audit rows of the batch; ids of new bookings are assigned, so they are not compared. Booking 0 stands for a new one."""
    requests = event_requests(t)
    result = special_events.apply_special_event_batch(catalog(t), requests, "batch", AS_OF)
    known = result["requests"].join(requests.filter(F.col("booking_id") > 0).select("request_id"), "request_id", "left_semi").select("booking_id", F.lit(True).alias("known"))
    totals = ["package_price", "resource_price", "participant_total", "addon_total"]
    rows = result["booking.BookingAudit"].join(known, "booking_id", "left")
    return plain(rows.select(F.when(F.col("known"), F.col("booking_id")).alias("booking_id"), *totals, "created_by"), *totals)


# --- carts --------------------------------------------------------------------------------------------

def cart_requests(t):
    """Every caller converts the first of its carts."""
    user = F.col("user_id")
    return t.events.select(user).distinct().select(
        user.alias("request_id"), user.alias("cookie_id"), user.alias("account_id"), F.lit("clerk").alias("modified_by"), F.lit(None).cast("long").alias("row_ver"),
        F.when(user % 3 == 0, F.lit(33)).cast("decimal(18,6)").alias("deposit_price"), F.lit(None).cast("long").alias("invoice_header_id"), F.lit(None).cast("int").alias("account_entitlement_id"),
        F.lit(False).alias("clear_party_host"),
    )


CART = f"""first AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY cookie_id ORDER BY booking_id NULLS FIRST, id) AS rn FROM booking_cart c WHERE cookie_id IS NOT NULL) x WHERE rn = 1),
opened AS (SELECT f.*, b.id AS bundle, b.deposit_price AS bd FROM first f JOIN product_bundle_schedule s ON s.id = f.base_bundle_schedule_id JOIN product_bundle b ON b.id = s.bundle_id WHERE f.booking_id IS NULL)"""


@query("convert_carts", with_tables(f"""WITH {CART}
SELECT o.park_id, o.cookie_id AS account_id, o.schedule_detail_id, (SELECT arg_min(t.product_level_id, t.id) FROM product_bundle_product bp JOIN product_ticket t ON t.id = bp.ticket_id WHERE bp.bundle_id = o.bundle) AS product_level_id,
  CAST(coalesce(CASE WHEN o.cookie_id % 3 = 0 THEN 33 END, o.bd, p.booking_deposit_amount) AS DOUBLE) AS deposit_price, o.promotion_id, o.internal_notes, TIMESTAMP '{AS_OF}' AS booked
FROM opened o JOIN park_park p ON p.id = o.park_id"""))
def convert_carts(t):
    """Bookings opened by the batch."""
    cat = catalog(t)
    tables = carts.convert_carts(cat, cart_requests(t), AS_OF)
    new = tables["converted"].filter("is_new").select(F.col("booking_id").alias("id"))
    rows = tables["booking.Booking"].join(new, "id", "left_semi")
    return plain(rows.select("park_id", "account_id", "schedule_detail_id", "product_level_id", "deposit_price", "promotion_id", "internal_notes", "booked"), "deposit_price")


@query("convert_cart_participants", with_tables(f"""WITH {CART},
want AS (SELECT id, 1 AS kind, base_bundle_schedule_id AS bs, base_participant_count AS n FROM opened UNION ALL SELECT id, 2, extra_bundle_schedule_id, extra_participant_count FROM opened UNION ALL SELECT id, 3, adult_bundle_schedule_id, adult_participant_count FROM opened),
p AS (SELECT w.*, s.amount, b.name, b.external_id, c.is_taxable FROM want w JOIN product_bundle_schedule s ON s.id = w.bs JOIN product_bundle b ON b.id = s.bundle_id JOIN product_category c ON c.id = b.category_id)
SELECT p.kind AS participant_type_id, p.bs AS bundle_schedule_id, p.name AS bundle_name, p.n AS count, p.external_id, p.is_taxable,
  CAST(CASE WHEN p.kind = 3 THEN coalesce(CASE WHEN p.amount = 0 THEN round(e.amount * CAST(0.5 AS DECIMAL(2,1)), 2) ELSE p.amount END, 0) ELSE p.amount END AS DOUBLE) AS price
FROM p LEFT JOIN p e ON e.id = p.id AND e.kind = 2"""))
def convert_cart_participants(t):
    """Participants of the opened bookings."""
    tables = carts.convert_carts(catalog(t), cart_requests(t), AS_OF)
    new = tables["converted"].filter("is_new").select("booking_id")
    rows = tables["booking.BookingParticipant"].join(new, "booking_id", "left_semi")
    return plain(rows.select("participant_type_id", "bundle_schedule_id", "bundle_name", "count", "external_id", "is_taxable", "price"), "price")


@query("convert_cart_items", with_tables(f"""WITH {CART}
SELECT coalesce(pp.name, t.name) AS park_product_name, i.included, i.quantity, CAST(i.price AS DOUBLE) AS price, coalesce(pp.tax_code, c.tax_code) AS tax_code, coalesce(ch.external_id, t.external_id, '') || '-C' || i.id AS external_id,
  CAST(coalesce(bp.percent_allocation, CAST(CAST(m.percent_allocation AS DOUBLE) / CAST(m.quantity AS DOUBLE) * i.quantity AS DECIMAL(18,6))) AS DOUBLE) AS percent_allocation, i.related_schedule_detail_id IS NOT NULL AS on_resource
FROM opened o JOIN booking_cart_item i ON i.cart_id = o.id LEFT JOIN prdct_park_product pp ON pp.id = i.park_product_id LEFT JOIN prdct_product_channel_product ch ON ch.park_product_id = pp.id LEFT JOIN product_bundle_schedule s ON s.id = i.related_bundle_schedule_id
LEFT JOIN product_bundle_product bp ON bp.bundle_id = s.bundle_id AND (bp.park_product_id = pp.id OR bp.ticket_id = i.ticket_id) LEFT JOIN product_ticket t ON t.id = i.ticket_id LEFT JOIN product_category c ON c.id = t.category_id
LEFT JOIN booking_schedule_details sd ON sd.id = i.related_schedule_detail_id LEFT JOIN booking_resource r ON r.id = sd.resource_id LEFT JOIN booking_park_resource_type_modifier m ON m.resource_type_id = r.resource_type_id AND m.park_id = pp.park_id
  AND m.product_modifier_type_id = pp.product_modifier_type_id AND m.deleted IS NULL"""))
def convert_cart_items(t):
    """Items of the opened bookings."""
    tables = carts.convert_carts(DerivedCatalog(t.spark, t.sf_dir, SPARK_TABLES), cart_requests(t), AS_OF)
    new = tables["converted"].filter("is_new").select("booking_id")
    rows = tables["booking.BookingItem"].join(new, "booking_id", "left_semi")
    return plain(
        rows.select("park_product_name", "included", "quantity", "price", "tax_code", "external_id", "percent_allocation", F.col("related_booking_resource_id").isNotNull().alias("on_resource")),
        "price", "percent_allocation",
    )
