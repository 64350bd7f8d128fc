"""Accounts enrolled in a schedule detail, a schedule, or the detail behind an exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.sources.catalog import Catalog


def enrolled_accounts(cat: Catalog, requests: DataFrame) -> DataFrame:
    """(request_id, account, person), distinct.

    `requests`: request_id, schedule_detail_id, schedule_id, exclusion_id; an exclusion stands for its
    detail, and detail and schedule given together mean either of them.
    """
    exclusions = cat.table("events.FranchiseScheduleExclusions", "id", "franchise_schedule_detail_id").toDF("exclusion_id", "excluded_detail_id")
    asked = requests.join(exclusions, "exclusion_id", "left").withColumn("schedule_detail_id", F.coalesce("excluded_detail_id", "schedule_detail_id"))
    details = cat.table("events.FranchiseScheduleDetails", "id", "franchise_schedule_id").toDF("schedule_detail_id", "schedule_id")
    subscriptions = cat.table("acct.Subscription", "id", "account_id", "person_id").filter(F.col("account_id").isNotNull() & F.col("person_id").isNotNull())
    # One row per detail and person is all the two look-ups need.
    enrolled = (
        cat.table("events.EventReservations", "franchise_schedule_detail_id", "subscription_id", "canceled").filter(F.col("canceled").isNull())
        .select(F.col("franchise_schedule_detail_id").alias("schedule_detail_id"), F.col("subscription_id").alias("id")).distinct()
        .join(subscriptions, "id").select("schedule_detail_id", "account_id", "person_id").distinct().join(details, "schedule_detail_id")
    )
    result = ["request_id", "account_id", "person_id"]
    by_detail = asked.filter(F.col("schedule_detail_id").isNotNull()).select("request_id", "schedule_detail_id").join(enrolled, "schedule_detail_id").select(*result)
    by_schedule = asked.filter(F.col("schedule_id").isNotNull()).select("request_id", "schedule_id").join(enrolled, "schedule_id").select(*result)
    return by_detail.unionByName(by_schedule).distinct()
