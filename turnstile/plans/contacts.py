"""Monthly contact extracts and the incremental load of child contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.sources import sinks
from turnstile.sources.catalog import Catalog

ADDRESS = ["country", "street_address", "city", "state", "zip_code"]


def _local_now(as_of) -> Column:
    return X.local_time(X.clock(as_of), F.lit(codes.OPERATIONS_ZONE))


def _created_this_month(cat: Catalog, as_of, role: int, *extra: str) -> DataFrame:
    """People of a role whose row began in the month of the operations zone."""
    now = _local_now(as_of)
    people = cat.table("acct.Person", "id", "first_name", "last_name", "date_of_birth", "row_start", "row_end", *extra).withColumnRenamed("id", "person_id")
    fresh = people.filter(
        (F.col("row_start") >= X.month_start(now).cast("timestamp_ntz")) & (F.col("row_start") < X.next_month_start(now).cast("timestamp_ntz"))
    )
    links = cat.table("acct.AccountPerson", "account_id", "person_id", "account_role_id").filter(F.col("account_role_id") == role)
    return fresh.join(links.drop("account_role_id"), "person_id")


def _printed(strip_slashes: bool = True) -> dict[str, Column]:
    return {
        "first_name": X.clean_name("first_name", strip_slashes), "last_name": X.clean_name("last_name", strip_slashes), "date_of_birth": X.floor_1900("date_of_birth"),
    }


def primary_contacts_month(cat: Catalog, as_of=None) -> DataFrame:
    owners = _created_this_month(cat, as_of, codes.ROLE_OWNER, "address_id", "email_address", "phone_number")
    addresses = cat.table("addr.Address", "id", *ADDRESS).withColumnRenamed("id", "address_id")
    return (
        owners.withColumns({**_printed(), "email_address": X.email_or_blank("email_address")}).join(addresses, "address_id", "left")
        .select(
            "account_id", "person_id", "first_name", "last_name", "email_address", "phone_number", "date_of_birth", *ADDRESS, F.lit("True").alias("primary_contact"),
            F.col("row_start").alias("person_row_start_date"), F.col("row_end").alias("person_row_end_date"), _local_now(as_of).alias("dataload_create_date"),
        )
    )


def child_contacts_month(cat: Catalog, as_of=None) -> DataFrame:
    """New children, once per owner of their account."""
    children = _created_this_month(cat, as_of, codes.ROLE_CHILD)
    owners = cat.table("acct.AccountPerson", "account_id", "person_id", "account_role_id").filter(F.col("account_role_id") == codes.ROLE_OWNER).select(
        "account_id", F.col("person_id").alias("household_owner_person_id")
    ).distinct()
    emails = cat.table("acct.Person", "id", "email_address").select(F.col("id").alias("household_owner_person_id"), X.email_or_blank("email_address").alias("household_email"))
    household = owners.join(children.select("account_id"), "account_id", "left_semi").join(emails, "household_owner_person_id")
    return children.withColumns(_printed()).join(household, "account_id", "left").select(
        "account_id", "person_id", "first_name", "last_name", "date_of_birth", F.col("row_start").alias("person_row_start_date"),
        F.col("row_end").alias("person_row_end_date"), _local_now(as_of).alias("dataload_create_date"), "household_owner_person_id", "household_email",
    )


def watermark(loaded: DataFrame, col: str = "person_row_start_date") -> DataFrame:
    """Newest loaded stamp as a one-row table; the start of history for an empty target."""
    return loaded.agg(F.coalesce(F.max(col), X.clock(codes.FIRST_WATERMARK)).alias("watermark"))


def child_contacts_delta(cat: Catalog, loaded: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, run-log row): current non-owner rows strictly newer than what is loaded.

    A row that arrives later with exactly the watermark's stamp is not picked up.
    """
    rows = _newer(cat, watermark(loaded).scalar(), as_of)
    return rows, sinks.run_log(rows, X.clock(as_of))


def loaded_until(cat: Catalog, log: str):
    """Newest stamp that any logged load has written: the log is read, not the target."""
    stamp = sinks.read_loads(cat.spark, log, sinks.LOG).agg(F.max("newest").alias("newest")).first()["newest"]
    return codes.FIRST_WATERMARK if stamp is None else stamp


def load_child_contacts(cat: Catalog, target: str, log: str, as_of=None) -> None:
    """One incremental load: what is newer than the log's newest stamp, in a folder named by that stamp.

    A load that failed before its log row was written starts from the same stamp again and replaces itself.
    """
    since = loaded_until(cat, log)
    name = f"since={since}".replace(" ", "T").replace(":", "")
    sinks.logged_load(_newer(cat, X.clock(since), as_of), f"{target}/{name}", f"{log}/{name}", X.clock(as_of), newest="person_row_start_date")


def _newer(cat: Catalog, since: Column, as_of) -> DataFrame:
    people = cat.table("acct.Person", "id", "first_name", "last_name", "date_of_birth", "row_start", "row_end").withColumnRenamed("id", "person_id")
    links = cat.table("acct.AccountPerson", "account_id", "person_id", "account_role_id").filter(F.col("account_role_id") != codes.ROLE_OWNER).drop("account_role_id")
    fresh = people.filter((F.col("row_start") > since) & (F.col("row_end") >= X.clock(codes.OPEN_END)))
    return fresh.join(links, "person_id").withColumns(_printed(strip_slashes=False)).select(
        "account_id", "person_id", "first_name", "last_name", "date_of_birth", F.col("row_start").alias("person_row_start_date"),
        F.col("row_end").alias("person_row_end_date"), X.clock(as_of).alias("dataload_create_date"),
    )
