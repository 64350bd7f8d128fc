"""Payment transactions: one row per payment or refund of the second stack, sums per booking of the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, LongType, StringType, StructField, StructType

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators import filters as flt
from turnstile.operators import sets
from turnstile.plans import ledger
from turnstile.sources.catalog import Catalog

PAYMENT_ROWS = StructType(
    [StructField(n, StringType()) for n in ("brand", "location")]
    + [StructField("account_id", LongType())]
    + [StructField(n, StringType()) for n in ("account_holder", "category")]
    + [StructField("booking_id", LongType()), StructField("confirmation_code", StringType()), StructField("invoice_refund_id", LongType())]
    + [StructField("is_refund", BooleanType()), StructField("transaction_type", StringType())]
    + [StructField(n, DateType()) for n in ("transaction_date", "disbursement_date")]
    + [StructField("payment_amount", DecimalType(18, 6))]
)


def payment_transactions(cat: Catalog, start, end, brand: str | None = None, location: str | None = None) -> DataFrame:
    parks = ledger.scope(cat, brand, location)
    branches = [*_second_stack(cat, start, end, parks), _first_stack(cat, start, end, parks)]
    return sets.union_branches(branches, PAYMENT_ROWS)


def deposit_refund_amount(is_deposit: Column, amount: Column, refund_fee: Column, original_fee: Column) -> Column:
    """A balance refund loses the refunded fee; a deposit refund that is not negative gains the original one.

    An unknown deposit flag counts as a deposit.
    """
    return F.when(is_deposit == F.lit(False), amount - refund_fee).when(amount >= 0, amount + original_fee).otherwise(amount)


def _second_stack(cat, start, end, parks) -> list[DataFrame]:
    holders = ledger.holders(cat)
    places = parks.select("park_id", "brand", "location")
    excluded = F.col("account_id").isin(codes.REPORT_EXCLUDED_ACCOUNTS)
    payments = flt.between_dates(
        cat.table("payment.Payment", "id", "invoice_id", "amount", "created_date", "payment_provider_id", "payment_status_id", "is_deposit"), "created_date", start, end
    ).filter(F.col("payment_provider_id").isin(codes.PAYMENT_PROVIDER_CARD) & F.col("payment_status_id").isin(codes.PAYMENT_KEPT))
    payments = payments.withColumnRenamed("id", "payment_id").join(ledger.disbursements(cat, start, end), "payment_id", "left").withColumn(
        "transaction_date", F.to_date("created_date")
    )
    codes_of = cat.table("payment.Invoice", "id", "confirmation_code").withColumnRenamed("id", "invoice_id")
    lines = cat.table("payment.LineItem", "id", "invoice_id", "item_type_id", "amount", "tax")
    fees = lines.filter(F.col("item_type_id") == codes.LINE_FEE).groupBy("invoice_id").agg(F.sum(F.col("amount") + F.col("tax")).alias("fee"))
    memberships = (
        cat.table("payment.LineItemSubscription", "line_item_id", "subscription_id")
        .join(ledger.subscription_kinds(cat).filter(F.col("product_type_id").isin(codes.PRODUCT_MEMBERSHIPS)), "subscription_id")
        .select(F.col("line_item_id").alias("id"))
    )
    membership_tax = lines.join(memberships, "id").groupBy("invoice_id").agg(F.sum("tax").alias("membership_tax"))
    bookings = (
        cat.table("booking.Booking", "id", "invoice_id", "park_id", "account_id").withColumnRenamed("id", "booking_id").filter(F.col("invoice_id").isNotNull() & ~excluded)
        .join(places, "park_id").join(holders, "account_id").withColumn("category", F.lit("Booking"))
    )
    owned = (
        cat.table("acct.AccountInvoices", "invoice_id", "park_id", "account_id").filter(~excluded).join(places, "park_id").join(holders, "account_id")
        .withColumn("category", F.lit("Non-Booking"))
    )
    refunds = (
        cat.table("payment.InvoiceRefund", "id", "invoice_id", "refund_invoice_id", "refund_payment_id")
        .toDF("invoice_refund_id", "original_invoice_id", "refund_invoice_id", "payment_id")
        .join(payments.drop("invoice_id"), "payment_id")
    )
    named_refunds = refunds.withColumn("invoice_id", F.col("refund_invoice_id")).join(codes_of, "invoice_id").join(fees, "invoice_id", "left")

    def purchase(df, amount):
        return df.withColumns({"payment_amount": amount, "is_refund": F.lit(False), "transaction_type": F.lit("Purchase")})

    def refund(df, amount):
        return df.withColumns({"payment_amount": amount, "is_refund": F.lit(True), "transaction_type": F.lit("Refund")})

    named = payments.join(codes_of, "invoice_id").join(fees, "invoice_id", "left")
    deposit_net = F.when(F.col("is_deposit"), F.col("amount") - X.or_zero("fee")).otherwise(F.col("amount"))
    sale_net = F.col("amount") - X.or_zero("fee") - X.or_zero("membership_tax")
    original_fees = fees.toDF("original_invoice_id", "original_fee")
    return [
        purchase(named.filter(F.col("amount") > 0).join(bookings, "invoice_id"), deposit_net),
        refund(
            named_refunds.join(bookings.withColumnRenamed("invoice_id", "original_invoice_id"), "original_invoice_id").join(original_fees, "original_invoice_id", "left"),
            deposit_refund_amount(F.col("is_deposit"), F.col("amount"), X.or_zero("fee"), X.or_zero("original_fee")),
        ),
        purchase(named.join(owned, "invoice_id").join(membership_tax, "invoice_id", "left"), sale_net),
        refund(
            named_refunds.join(owned.withColumnRenamed("invoice_id", "original_invoice_id"), "original_invoice_id").join(membership_tax, "invoice_id", "left"),
            sale_net,
        ),
    ]


def _first_stack(cat, start, end, parks) -> DataFrame:
    """Line totals of the first stack summed per booking, day and kind of transaction."""
    paid = ledger.first_payments(cat, start, end, parks, payout_prefix="py_%").join(ledger.counted_holders(cat), "account_id")
    labelled = ledger.first_labels(cat, paid)
    fee = F.col("is_fee_line")
    purchases = ledger.first_purchases(cat, labelled).filter(~fee).withColumns(
        {
            "total": F.col("paid_principle") + F.col("discount") + F.col("line_tax"), "is_refund": F.lit(False),
            "transaction_type": X.iif(F.col("recurring_billing_period_id").isNull(), "Purchase", "Recurring"), "transaction_date": F.col("local_date"),
        }
    )
    refunds = ledger.first_refunds(cat, labelled).withColumns(
        {
            "total": X.money(F.col("refund_price")) + X.money(F.col("refund_tax")), "is_refund": F.lit(True), "transaction_type": F.lit("Refund"),
            "transaction_date": F.col("stored_date"),
        }
    )
    keys = [
        "brand", "location", "account_id", "account_holder", "category", "booking_id", "confirmation_code", "is_refund", "transaction_type", "transaction_date",
        "disbursement_date",
    ]
    rows = [
        df.withColumns(
            {"category": F.when(F.col("booking_id").isNotNull(), "Booking").otherwise("Non-Booking"), "confirmation_code": F.col("printed_code")}
        ).select(*keys, X.money(F.col("total")).alias("total"))
        for df in (purchases, refunds)
    ]
    return rows[0].unionByName(rows[1]).groupBy(*keys).agg(F.sum("total").alias("payment_amount"))
