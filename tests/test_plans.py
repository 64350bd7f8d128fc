"""Whole jobs on hand-made tables: rules the derived domain does not reach, and known divergences."""

import datetime as dt
import json
from decimal import Decimal as D

from frames import values
from pyspark.sql import functions as F

from turnstile.plans import audit, carts, contacts, enrolment, invoice_batch, occupancy, payment_batch, timeslots
from turnstile.plans.revenue import revenue_ledger
from turnstile.queries.availability import slot_requests
from turnstile.queries.base import Tables
from turnstile.queries.reports import END, START
from turnstile.sources import catalog, sinks
from turnstile.sources.derived import DerivedCatalog
from turnstile.streaming import jobs

AS_OF = "2024-01-15 12:00:00"
NOW = dt.datetime(2024, 1, 15, 12)


def frames(spark, tables, base=None):
    """{name: (schema, rows)} as a catalog."""
    return catalog.FrameCatalog(spark, {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in tables.items()}, base)


def test_names_of_source_columns():
    assert [catalog.snake(n) for n in ("InvoiceHeaderId", "IsAI", "RowVer", "park_id", "ValidFromHour")] == ["invoice_header_id", "is_ai", "row_ver", "park_id", "valid_from_hour"]


def test_parquet_catalog_reads_source_names(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "Id int, UrlSlug string").write.parquet(str(tmp_path / "dbo_Brands"))
    cat = catalog.ParquetCatalog(spark, str(tmp_path))
    assert values(cat.table("dbo.Brands", "url_slug")) == [("x",)]
    try:
        cat.table("dbo.Brands", "name")
        raise AssertionError("missing column was not noticed")
    except KeyError as error:
        assert "name" in str(error)


# --- enrolment ------------------------------------------------------------------------------------------

def enrolled(spark):
    return frames(spark, {
        "events.EventReservations": ("franchise_schedule_detail_id int, subscription_id int, canceled timestamp_ntz", [(1, 10, None), (2, 11, None), (3, 12, None), (1, 13, NOW)]),
        "acct.Subscription": ("id int, account_id int, person_id int", [(10, 100, 1), (11, 101, 2), (12, 102, None), (13, 103, 4)]),
        "events.FranchiseScheduleDetails": ("id int, franchise_schedule_id int", [(1, 7), (2, 8), (3, 8)]),
        "events.FranchiseScheduleExclusions": ("id int, franchise_schedule_detail_id int", [(5, 2)]),
    })


def test_detail_and_schedule_together_mean_either(spark):
    schema = "request_id int, schedule_detail_id int, schedule_id int, exclusion_id int"
    requests = [(1, 1, None, None), (2, None, 8, None), (3, 1, 8, None), (4, 1, None, 5), (5, None, None, None), (6, 1, None, 99)]
    all_at_once = enrolment.enrolled_accounts(enrolled(spark), spark.createDataFrame(requests, schema))
    assert values(all_at_once) == [(1, 100, 1), (2, 101, 2), (3, 100, 1), (3, 101, 2), (4, 101, 2), (6, 100, 1)]
    one_by_one = [r for q in requests for r in values(enrolment.enrolled_accounts(enrolled(spark), spark.createDataFrame([q], schema)))]
    assert sorted(one_by_one) == values(all_at_once)


# --- contacts -------------------------------------------------------------------------------------------

def people(spark):
    end = dt.datetime(9999, 12, 31)
    person = "id int, first_name string, last_name string, date_of_birth date, row_start timestamp_ntz, row_end timestamp_ntz"
    return frames(spark, {
        "acct.Person": (person, [(1, "A/B", None, dt.date(1850, 1, 1), dt.datetime(2024, 1, 3), end), (2, "B", "C", None, dt.datetime(2024, 1, 5), end), (3, "old", "x", None, dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 10))]),
        "acct.AccountPerson": ("account_id int, person_id int, account_role_id int", [(9, 1, 1), (9, 2, 3), (9, 3, 1)]),
    })


def test_delta_load_twice_adds_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "person_row_start_date timestamp_ntz")
    rows, log = contacts.child_contacts_delta(people(spark), empty, AS_OF)
    assert values(rows, "person_id", "first_name", "last_name", "date_of_birth") == [(1, "A/B", "Customer", dt.date(1900, 1, 1)), (2, "B", "C", None)]
    assert log.first()["record_count"] == 2
    sinks.append(rows, str(tmp_path / "t"))
    again, log = contacts.child_contacts_delta(people(spark), spark.read.parquet(str(tmp_path / "t")), AS_OF)
    assert again.count() == 0 and log.first()["record_count"] == 0


def test_stamp_equal_to_the_watermark_is_not_loaded(spark):
    loaded = spark.createDataFrame([(dt.datetime(2024, 1, 3),)], "person_row_start_date timestamp_ntz")
    assert values(contacts.child_contacts_delta(people(spark), loaded, AS_OF)[0], "person_id") == [(2,)]


def test_contact_stream_resumes_where_it_stopped(spark, tmp_path):
    joined = people(spark).table("acct.Person").withColumnRenamed("id", "person_id").join(people(spark).table("acct.AccountPerson"), "person_id")
    source = str(tmp_path / "in")
    run = lambda: jobs.load_contacts(jobs.read_stream(spark, source, joined), str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "cp"), AS_OF).awaitTermination()
    joined.filter("person_id = 1").write.mode("append").parquet(source)
    run()
    joined.filter("person_id > 1").write.mode("append").parquet(source)
    run()
    run()
    assert values(spark.read.parquet(str(tmp_path / "out" / "*")), "person_id") == [(1,), (2,)]
    assert sorted(r["record_count"] for r in spark.read.parquet(str(tmp_path / "log" / "*")).collect()) == [1, 1]
    joined.filter("person_id = 1").write.parquet(str(tmp_path / "later"))
    later = jobs.read_stream(spark, str(tmp_path / "later"), joined)
    jobs.load_contacts(later, str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "cp2"), AS_OF).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out" / "*")), "person_id") == [(1,), (1,), (2,)]
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("batch=None")]


def test_contact_stream_repeats_a_batch_without_copies(spark, tmp_path):
    """A batch whose commit is lost is run again: its rows and its log row replace those of the first run."""
    joined = people(spark).table("acct.Person").withColumnRenamed("id", "person_id").join(people(spark).table("acct.AccountPerson"), "person_id")
    source, state = str(tmp_path / "in"), tmp_path / "cp"
    run = lambda: jobs.load_contacts(jobs.read_stream(spark, source, joined), str(tmp_path / "out"), str(tmp_path / "log"), str(state), AS_OF).awaitTermination()
    for drop in ("person_id = 1", "person_id > 1"):
        joined.filter(drop).write.mode("append").parquet(source)
        run()
    rows = lambda: (values(spark.read.parquet(str(tmp_path / "out" / "*")), "person_id"), values(spark.read.parquet(str(tmp_path / "log" / "*")), "record_count", "newest"))
    before = rows()
    for commit in (state / "commits").glob("*1*"):
        commit.unlink()
    run()
    assert rows() == before and before[0] == [(1,), (2,)]


def test_contact_load_starts_from_its_log(spark, tmp_path):
    """Repeated loads find nothing new; a load that lost its log row replaces its own rows."""
    target, log = str(tmp_path / "out"), str(tmp_path / "log")
    contacts.load_child_contacts(people(spark), target, log, AS_OF)
    once = values(spark.read.parquet(f"{target}/*"), "person_id")
    contacts.load_child_contacts(people(spark), target, log, AS_OF)
    assert values(spark.read.parquet(f"{target}/*"), "person_id") == once and once
    assert sorted(r["record_count"] for r in spark.read.parquet(f"{log}/*").collect()) == [0, len(once)]
    contacts.load_child_contacts(people(spark), target, str(tmp_path / "lost"), AS_OF)  # as if the first log row had not been written
    assert values(spark.read.parquet(f"{target}/*"), "person_id") == once


def test_callers_without_a_stake_share_an_answer(spark):
    """Requests that nothing of their callers' own concerns shrink to their views; each still gets its rows."""
    rows = [(1, 10, 5, "x"), (2, 11, 5, "x"), (3, None, 5, "x"), (4, 12, 5, "x"), (5, 12, None, "x"), (6, 13, None, "x")]
    requests = spark.createDataFrame(rows, "request_id long, cookie_id long, park_id long, level string")
    seen = []

    def answer(asked):
        seen.extend(values(asked, "cookie_id", "park_id", "level"))
        return asked.select("request_id", F.coalesce("cookie_id", F.lit(0)).alias("who"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("slot"))

    out = occupancy.shared_answers(requests, spark.createDataFrame([(4,), (4,)], "request_id long"), ["park_id", "level"], answer)
    want = sorted((r, 12 if r == 4 else 0, slot) for r in range(1, 7) for slot in "ab")
    assert values(out, "request_id", "who", "slot") == want
    assert seen == sorted([(12, 5, "x"), (None, 5, "x"), (None, None, "x")], key=repr)


# --- payments -------------------------------------------------------------------------------------------

PAYMENT = "id long, external_id string, invoice_header_id long, amount decimal(18,6), payment_status_id int, application_fee_total decimal(18,6), failure_message string, modified_by string, modified_date timestamp_ntz"


def paid(spark):
    return frames(spark, {
        "invoice.Payment": (PAYMENT, [(1, "a", 10, D(5), 1, D(2), "x", "load", NOW), (2, "b", 11, D(6), 1, None, None, "load", NOW), (3, "c", 12, D(7), 1, D(99), None, "load", NOW)]),
        "invoice.PaymentInvoiceDetail": ("id string, payment_id long, invoice_detail_id string, paid_principle decimal(18,6), paid_tax decimal(18,6), payment_invoice_detail_status_id int", [("p1", 1, "d1", D(1), D(0), 1), ("p2", 1, "d2", D(1), D(0), 2)]),
        "invoice.ApplicationFeeDetail": ("id long, payment_id long, application_fee_type_id int, unit_principle decimal(18,6), unit_tax decimal(18,6)", [(1, 1, 1, D(1), D(0))]),
    })


def test_payment_batch(spark):
    fees = json.dumps([{"ApplicationFeeTypeId": 1, "UnitPrinciple": 3, "UnitTax": 1}, {"ApplicationFeeTypeId": 2, "UnitPrinciple": 2, "UnitTax": 0}])
    allocations = json.dumps([{"PaymentId": 1, "InvoiceDetailId": d, "PaidPrinciple": 4, "PaidTax": 1} for d in ("d1", "d2")])
    new = json.dumps({"ExternalId": "n", "Amount": 8, "PaymentStatusId": 2, "ApplicationFeeTotal": 1})
    change = json.dumps({"ExternalId": "z", "Amount": 5, "PaymentStatusId": 3, "ApplicationFeeTotal": 4})
    batch = spark.createDataFrame(
        [(1, 1, change, allocations, fees), (2, None, new, allocations, fees), (3, 3, json.dumps({"ExternalId": "c", "ApplicationFeeTotal": 99}), None, fees), (4, 2, json.dumps({"ExternalId": "b"}), None, fees)],
        "request_id int, payment_id long, payment string, allocations string, fees string",
    )
    out = payment_batch.apply_payment_batch(paid(spark), batch, "me", AS_OF)
    totals = {r["external_id"]: (r["id"], r["failure_message"], r["application_fee_total"]) for r in out["invoice.Payment"].collect()}
    # absent members become null, totals are raised, higher and unknown ones stay
    assert totals == {"z": (1, None, D(6)), "n": (4, None, D(6)), "c": (3, None, D(99)), "b": (2, None, None)}
    live = out["invoice.PaymentInvoiceDetail"].filter("payment_invoice_detail_status_id = 1")
    assert values(live, "payment_id", "invoice_detail_id", "paid_principle") == [(1, "d1", D(1)), (1, "d2", D(4))]
    assert out["invoice.ApplicationFeeDetail"].groupBy("payment_id").count().filter("count <> 2").count() == 0


# --- invoices -------------------------------------------------------------------------------------------

DETAIL = (
    "id long, invoice_header_id long, invoice_detail_status_id int, description string, unit_principle decimal(18,6), external_id string, booking_item_id long, booking_fee_id long, "
    "booking_participant_id long, booking_resource_id long, related_invoice_detail_id long"
)


def invoices(spark, details):
    return frames(spark, {
        "invoice.InvoiceHeader": ("id long, confirmation_code string, account_id long, invoice_status_id int, refunded_invoice_id long", [(1, "c", 5, 1, None), (2, "d", 5, 1, None)]),
        "invoice.InvoiceDetail": (DETAIL, details),
        "invoice.PaymentInvoiceDetail": ("id long, invoice_detail_id long, payment_invoice_detail_status_id int", [(1, 11, 1), (2, 13, 1), (3, 14, 1), (4, 15, 1), (5, 16, 1), (6, 20, 1)]),
        "booking.BookingParticipant": ("external_id string, participant_type_id int", [("base", 1), ("other", 2)]),
    })


def line(i, external=None, status=1, header=1, **ids):
    return (i, header, status, f"line {i}", D(1), external, ids.get("item"), ids.get("fee"), ids.get("participant"), ids.get("resource"), None)


def test_invoice_batch(spark):
    details = [line(11, "base"), line(12, "gone"), line(13, None, item=7), line(14, "r", resource=9), line(15, "y", status=2), line(16, "Discount"), line(20, "gone", header=2)]
    sent = [
        {"Id": 1, "Description": "by item", "BookingItemId": 7, "ExternalId": "seven"}, {"Id": 2, "Description": "by resource", "BookingResourceId": 9},
        {"Id": 3, "Description": "promo", "ExternalId": "base-Promo"}, {"Id": 4, "ExternalId": "Entitlement - x"}, {"Id": 5, "ExternalId": "child", "RelatedInvoiceDetailId": "1"},
        {"Id": 6, "Description": "again", "ExternalId": "gone"},
    ]
    batch = spark.createDataFrame(
        [(1, 1, json.dumps({"InvoiceStatusId": 4}), json.dumps(sent)), (2, None, json.dumps({"ConfirmationCode": "new", "AccountId": 6, "InvoiceStatusId": 1}), None)],
        "request_id int, invoice_header_id long, header string, details string",
    )
    out = invoice_batch.apply_invoice_batch(invoices(spark, details), batch, "me", AS_OF)
    assert values(out["invoice.InvoiceHeader"], "id", "confirmation_code", "invoice_status_id") == [(1, "c", 4), (2, "d", 1), (3, "new", 1)]
    rows = out["invoice.InvoiceDetail"].collect()
    old = {r["id"]: r for r in rows if r["id"] <= 20}
    new = {(r["external_id"], r["description"]): r for r in rows if r["id"] > 20}
    # unpaid line 12 is voided and comes back as a new line; other invoices are left alone
    assert (old[12]["invoice_detail_status_id"], old[20]["invoice_detail_status_id"]) == (2, 1)
    assert ("gone", "again") in new
    # matched by item: updated, null members keep the old values
    assert (old[13]["description"], old[13]["unit_principle"], old[13]["external_id"]) == ("by item", D(1), "seven")
    # matched by resource alone: updated and inserted again
    assert old[14]["description"] == "by resource" and (None, "by resource") in new
    assert new[("base-Promo", "promo")]["related_invoice_detail_id"] == 11
    assert old[16]["related_invoice_detail_id"] == 11 and new[("Entitlement - x", None)]["related_invoice_detail_id"] == 11
    assert new[("child", None)]["related_invoice_detail_id"] == 13
    # the allocation of the line that was void before is voided too
    assert values(out["invoice.PaymentInvoiceDetail"].filter("payment_invoice_detail_status_id = 2"), "id") == [(4,)]


def test_batches_with_equal_request_ids_make_different_lines(spark, sf):
    cat = DerivedCatalog.of(spark, sf)
    one, two = [r["id"] for r in cat.table("invoice.InvoiceHeader").filter("id > 0").orderBy("id").limit(2).collect()]
    schema = "request_id int, invoice_header_id long, header string, details string"
    sent = lambda invoice, name: spark.createDataFrame([(1, invoice, json.dumps({"InvoiceStatusId": 5}), json.dumps([{"Id": "1", "Description": "new", "ExternalId": name, "Quantity": 1}]))], schema)
    first = invoice_batch.apply_invoice_batch(cat, sent(one, "fresh-a"), "me", AS_OF)
    after = catalog.FrameCatalog(spark, first, cat)
    second = invoice_batch.apply_invoice_batch(after, sent(two, "fresh-b"), "me", AS_OF)
    made = second["invoice.InvoiceDetail"].filter("external_id like 'fresh-%'")
    assert values(made, "invoice_header_id", "external_id") == [(one, "fresh-a"), (two, "fresh-b")]
    assert made.select("id").distinct().count() == 2
    docs = invoice_batch.documents_after(after, second).select("invoice_header_id", F.transform("InvoiceDetails", lambda d: d["Description"]).alias("lines")).collect()
    assert [r["invoice_header_id"] for r in docs] in ([two], []) and all("new" in r["lines"] for r in docs)


# --- carts ----------------------------------------------------------------------------------------------

def test_known_bookings_keep_prices_and_lose_old_items(spark, sf):
    base = DerivedCatalog.of(spark, sf)
    open_booking = base.table("booking.Booking").filter("paid is null and canceled is null and deleted is null and promotion_id < 40 and id % 2 = 0 and id % 9 <> 0")
    picked = open_booking.join(base.table("booking.BookingParticipant").filter("participant_type_id = 1").select(F.col("booking_id").alias("id"), "bundle_schedule_id"), "id").orderBy("id").limit(2).collect()
    b1, b2 = picked
    cart = base.table("booking.Cart")
    mine = cart.limit(1).collect()[0].asDict()
    schedule = base.table("product.BundleSchedule", "id", "bundle_id").filter("bundle_id % 4 = 1").orderBy("id").limit(2).collect()[1]["id"]
    rows = [
        {**mine, "id": 1000000001, "cookie_id": 500, "booking_id": b1["id"], "base_bundle_schedule_id": b1["bundle_schedule_id"], "promotion_id": 2},
        {**mine, "id": 1000000002, "cookie_id": 501, "booking_id": b2["id"], "base_bundle_schedule_id": schedule, "promotion_id": None},
        {**mine, "id": 1000000003, "cookie_id": 502, "booking_id": b2["id"]},
        {**mine, "id": 1000000004, "cookie_id": 503, "booking_id": b1["id"]},
    ]
    cat = catalog.FrameCatalog(spark, {"booking.Cart": spark.createDataFrame([tuple(r[c] for c in cart.columns) for r in rows], cart.schema)}, base)
    requests = spark.createDataFrame(
        [(1, 500, 9, "me", b1["row_ver"], None, None, 31, True), (2, 501, 9, "me", b2["row_ver"], None, None, None, False), (3, 502, 9, "me", b2["row_ver"] + 1, None, None, None, False), (4, 999, 9, "me", None, None, None, None, False), (5, 503, 9, "me", b1["row_ver"], None, None, None, False)],
        "request_id int, cookie_id long, account_id long, modified_by string, row_ver long, deposit_price decimal(18,6), invoice_header_id long, account_entitlement_id int, clear_party_host boolean",
    )
    out = carts.convert_carts(cat, requests, AS_OF)
    assert values(out["rejected"], "request_id", "reject_reason") == [(3, "stale copy"), (4, "not found"), (5, "stale copy")]
    assert values(out["converted"], "request_id", "booking_id", "is_new") == [(1, b1["id"], False), (2, b2["id"], False)]
    before = {r["booking_id"]: r["price"] for r in base.table("booking.BookingParticipant").filter("participant_type_id = 1").collect()}
    after = {r["booking_id"]: r["price"] for r in out["booking.BookingParticipant"].filter("participant_type_id = 1").collect()}
    listed = base.table("product.BundleSchedule").filter(F.col("id") == schedule).first()["amount"]
    assert after[b1["id"]] == before[b1["id"]] and after[b2["id"]] == listed
    assert {k: v for k, v in after.items() if k not in (b1["id"], b2["id"])} == {k: v for k, v in before.items() if k not in (b1["id"], b2["id"])}
    assert out["booking.BookingItem"].filter(F.col("booking_id").isin(b1["id"], b2["id"]) & F.col("deleted").isNull()).count() == 0
    live = out["booking.BookingDiscount"].filter(F.col("booking_id").isin(b1["id"], b2["id"]) & F.col("deleted").isNull())
    assert set(values(live.filter("promotion_id is not null"), "booking_id", "description")) == {(b1["id"], "Promotion - CODE2")}
    assert out["booking.Booking"].filter(F.col("id") == b1["id"]).first()["party_host_id"] is None
    assert out["booking.Booking"].count() == base.table("booking.Booking").count()
    assert out["invoice.InvoiceDetail"].count() == base.table("invoice.InvoiceDetail").count()
    assert out["booking.BookingAudit"].select("booking_id").distinct().count() == 2


# --- jobs over many keys -----------------------------------------------------------------------------------

def test_slots_of_one_request_equal_its_share_of_all(spark, sf):
    cat, t = DerivedCatalog.of(spark, sf), Tables(spark, sf)
    requests = slot_requests(t)
    together = timeslots.timeslots(cat, requests, AS_OF).cache()
    some = [r["request_id"] for r in together.select("request_id").distinct().orderBy("request_id").limit(1).collect()]
    for request in some:
        alone = timeslots.timeslots(cat, requests.filter(F.col("request_id") == request), AS_OF)
        assert values(alone) == values(together.filter(F.col("request_id") == request))


def test_ledger_totals_are_the_sum_of_their_parts(spark, sf):
    ledger = revenue_ledger(DerivedCatalog.of(spark, sf), START, END)
    parts = ["item_price", "discount", "zee_tax", "corp_fee_tax", "corp_membership_tax"]
    detail = ledger.detail().select(*parts, "total_price").collect()
    assert all(abs(sum(r[p] for p in parts) - r["total_price"]) <= D("0.03") for r in detail)
    kinds = {(r["category"], r["transaction_type"]) for r in ledger.results.select("category", "transaction_type").distinct().collect()}
    assert {("Booking Deposit", "Purchase"), ("Booking", "Refund"), ("Tip", "Refund"), ("Booking Deposit", "Refund")} <= kinds
    ledger.release()


def test_brand_and_location_narrow_the_ledger(spark, sf):
    cat = DerivedCatalog.of(spark, sf)
    park = cat.table("park.Park").join(cat.table("dbo.Brands").toDF("brand_id", "brand", "brand_slug", "store"), "brand_id").first()
    whole = revenue_ledger(cat, START, END).aggregate()
    narrow = revenue_ledger(cat, START, END, brand=park["brand_slug"], location=park["url_slug"]).aggregate()
    assert values(narrow) == values(whole.filter(F.col("location") == park["name"]))


def test_audit_of_some_bookings(spark, sf):
    cat = DerivedCatalog.of(spark, sf)
    ids = cat.table("booking.Booking").select(F.col("id").alias("booking_id")).orderBy("booking_id").limit(5)
    some = audit.booking_audit(cat, ids, "me", AS_OF)
    every = audit.booking_audit(cat, None, "me", AS_OF)
    assert values(some) == values(every.join(ids, "booking_id", "left_semi").select(*some.columns))


def test_nothing_is_shuffled_after_slots_meet_bundles(spark, sf):
    """a request's slots and bundles are multiplied in its own row; no grouping or join follows."""
    from turnstile.queries import registry

    for name in ("timeslots", "timeslot_documents"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("flatten")] and "Join" not in plan[: plan.index("flatten")]


def test_a_caller_lifts_only_what_the_caller_has_taken(spark):
    """the choice made for everybody, and callers who hold the last of a bundle or of its schedule."""
    day = dt.date(2024, 1, 15)  # a Monday
    cat = frames(spark, {
        "product.Bundle": ("id long, park_id long, bundle_type_id int, start_date date, end_date date, is_active boolean", [(b, 1, 2, None, None, True) for b in (1, 2, 3)]),
        "product.BundleSchedule": ("id long, bundle_id long, category_schedule_id long, amount decimal(18,6), quantity int", [(11, 1, 5, D(10), 1), (12, 2, 5, D(20), 9), (13, 3, 6, D(30), 9)]),
        "product.CategorySchedule": ("id long, category_id long, day_of_week int, start_hour decimal(9,4), quantity int", [(5, 1, 1, D(9), 9), (6, 2, 1, D(13), 1)]),
        "product.Category": ("id long, start_date date, end_date date, is_active boolean", [(1, day, day, True), (2, day, day, True)]),
        "product.BundleProduct": ("bundle_id long, ticket_id long, quantity int, percent_allocation decimal(18,6)", [(b, 1, 10, D(100)) for b in (1, 2, 3)]),
        "product.Ticket": ("id long, product_level_id long", [(1, 7)]),
        "prdct.ProductLevel": ("id long, ordinal long", [(7, 1)]),
        "booking.Booking": ("id long, schedule_detail_id long, canceled timestamp_ntz, deleted timestamp_ntz", []),
        "booking.BookingParticipant": ("booking_id long, participant_type_id int, bundle_schedule_id long, price decimal(18,6)", []),
        "booking.Cart": ("booking_id long, cookie_id long, schedule_detail_id long, base_bundle_schedule_id long, time_began timestamp_ntz, cart_released timestamp_ntz", [(None, 100, None, 11, NOW, None), (None, 200, None, 13, NOW, None)]),
    })
    asked = spark.createDataFrame([(r, c, 1, day, 7, False, False) for r, c in ((1, 100), (2, 200), (3, 300))], "request_id long, cookie_id long, park_id long, date date, product_level_id long, accessible boolean, use_percent boolean")
    got = values(timeslots.base_bundles(cat, asked, F.lit(NOW)), "request_id", "bundle_schedule_id")
    assert got == [(1, 11), (2, 12), (2, 13), (3, 12)]


def test_nothing_is_shuffled_after_requests_meet_packages(spark, sf):
    """packages are grouped before requests multiply them; no grouping follows the last join, no lists are joined on requests."""
    from turnstile.queries import registry

    for name in ("packages", "package_documents"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")] and "__share" in plan[plan.index("Join") :].splitlines()[0]


def test_notification_pairs_meet_once_and_are_never_shuffled(spark):
    """Several ways to one user, read ones, equal ids: one row each; the join that makes pairs is the last shuffle."""
    from turnstile.plans import notifications

    day, at = dt.date(2024, 1, 5), dt.datetime(2024, 1, 10, 8)
    cat = frames(spark, {
        "auth.AdminUsers": ("id long, username string, notification_start_date date, deleted timestamp_ntz", [
            (1, "one", day, None), (2, "two", day, None), (3, "three", dt.date(2024, 1, 11), None), (4, "four", day, at), (5, "five", day, None), (None, "six", day, None), (7, "seven", None, None)]),
        "auth.AdminUserRoles": ("admin_user_id long, deleted timestamp_ntz", [(2, None), (5, at)]),
        "auth.AdminUserRoleBrands": ("admin_user_id long, brand_id int, deleted timestamp_ntz", [(1, 10, None), (1, 11, None), (5, 11, at)]),
        "auth.AdminUserRoleLocations": ("admin_user_id long, location_id int, deleted timestamp_ntz", [(1, 100, None)]),
        "park.Park": ("id int, brand_id int", [(100, 10)]),
        "notification.UserNotification": ("admin_user_id int, notification_id int", [(2, 21), (2, 99), (None, 20)]),
        "releases.ReleaseImages": ("id int, image_extension string", []),
        "releases.Releases": ("id int, version string, has_pdf boolean, release_image_id int", [(7, "v7", True, None), (8, "v8", False, None)]),
        "releases.ReleaseBrands": ("release_id int, brand_id int", [(7, 10), (7, 11), (7, 11), (7, None)]),
        "invoice.Chargeback": ("id long, external_id string, created_date timestamp_ntz", [(50, "py", at)]),
        "invoice.Payment": ("external_id string, invoice_header_id long", [("py", 60)]),
        "invoice.InvoiceHeader": ("id long, location_id int", [(60, 100)]),
        "notification.Notification": (
            "id long, title string, body string, notification_type_id int, release_id int, chargeback_id long, deleted timestamp_ntz, created_date timestamp_ntz",
            [(20, "all", "", 2, None, None, None, at), (21, "both", "", 1, 7, 50, None, at), (22, "no pdf", "", 1, 8, None, None, at), (23, "gone", "", 2, None, None, at, at),
             (24, "twice", "", 2, None, None, None, at), (24, "twice", "", 2, None, None, None, at), (25, "undated", "", 2, None, None, None, None)]),
    })
    users = spark.createDataFrame([("one",), ("two",), ("three",), ("four",), ("five",), ("six",), ("six",), ("seven",)], "username string")
    rows = notifications.notifications(cat, users)
    everybody = [(name, n) for name in ("one", "two", "five", "six") for n in (20, 24, 24)]
    assert values(rows, "username", "notification_id") == sorted([*everybody, ("one", 21)], key=repr)
    text = rows._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in text.split("== Initial Plan ==")[-1].splitlines() if any(word in line for word in ("Join", "Exchange", "Aggregate", "Generate"))]
    # Read from the top: chunks are unpacked, then their join; no shuffle and no grouping above it.
    assert "Generate explode(notes" in steps[0] and "Join" in steps[1]
    assert not any("Aggregate" in line for line in steps[:2])


def test_payment_batch_parses_its_payloads_once(spark, sf):
    """What a batch leaves behind goes on from parsed rows: only updates and their allocations are read from JSON again, no fee is."""
    from turnstile.queries.batches import payment_requests

    t = Tables(spark, sf)
    tables = payment_batch.apply_payment_batch(DerivedCatalog.of(spark, sf), payment_requests(t), "batch", AS_OF)
    parsed = {name: df._jdf.queryExecution().optimizedPlan().toString().count("from_json") for name, df in tables.items()}
    assert parsed["requests"] == parsed["invoice.ApplicationFeeDetail"] == 0
    assert parsed["invoice.Payment"] == 1


def test_detail_table_for_spark_gives_the_rows_of_the_portable_text(spark, tmp_path):
    """Third lines name their order's first line, whatever lines are missing, unnumbered or there twice; only they meet it."""
    from turnstile.sources import derived

    money = {c: 1.0 for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    numbers = [(2, 1), (2, 3), (4, 3), (6, 1), (6, 1), (6, 3), (6, 3), (8, None), (8, 2), (3, 1), (3, 3), (None, 3), (10, 1), (10, 4)]
    rows = [{"l_orderkey": o, "l_linenumber": n, "l_partkey": 5, "l_suppkey": 6, **money, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": "1996-01-01"} for o, n in numbers]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = derived.DerivedCatalog(spark, str(tmp_path), derived.SPARK_TABLES)
    texts = {n: derived.TABLES[n] for n in ("x_line", "x_first", "invoice_invoice_detail")}
    portable = spark.sql(texts["invoice_invoice_detail"].replace("x_line", "{x_line}").replace("x_first", "{x_first}"), x_line=plain._frame("x_line"), x_first=plain._frame("x_first"))
    listed = lambda df: sorted(map(str, df.collect()))
    expected = listed(portable)
    assert len(expected) == 11
    for cat in (plain, derived.DerivedCatalog.staged(spark, str(tmp_path), "x_line")):
        details = cat.table("invoice.InvoiceDetail")
        assert details.columns == portable.columns and listed(details) == expected
        top = details._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
        assert top.startswith("Union"), top
    copied = derived.DerivedCatalog.staged(spark, str(tmp_path), "x_line").table("payment.LineItem")
    assert listed(copied) == listed(plain.table("payment.LineItem"))
    assert "md5" not in copied._jdf.queryExecution().optimizedPlan().toString()
