"""Newest valid token of the person behind an e-mail address or a token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import documents as doc
from turnstile.operators.windows import keep_first
from turnstile.sources.catalog import Catalog


def valid_tokens(cat: Catalog, requests: DataFrame) -> DataFrame:
    """One row per request that finds a token; `requests`: request_id, email_address, token, type.

    Secrets of the person's login are not read.
    """
    people = cat.table("acct.Person", "id", "email_address").toDF("person_id", "person_email")
    tokens = cat.table("auth.UserToken", "id", "token", "person_id", "effective_end_date", "status", "type")
    by_email = requests.filter(F.col("email_address").isNotNull()).join(people, F.col("email_address") == F.col("person_email")).select("request_id", "type", "person_id")
    # Tokens are long: the join compares fingerprints and then the text itself.
    printed = tokens.select("person_id", F.col("token").alias("held_token"), X.fingerprint("token").alias("print"))
    by_token = (
        requests.filter(F.col("token").isNotNull()).withColumn("print", X.fingerprint("token")).join(printed, "print").filter(F.col("token") == F.col("held_token"))
        .select("request_id", "type", "person_id")
    )
    matched = by_email.unionByName(by_token).distinct()
    logins = cat.table("auth.UserAuthentication", "id", "person_id").toDF("user_authentication_id", "person_id")
    valid = tokens.filter(F.col("status") == 0)
    newest = keep_first(
        matched.join(valid, ["person_id", "type"]), "request_id", [F.col("effective_end_date").desc(), F.col("id").desc()]
    )
    return newest.join(people, "person_id").join(logins, "person_id", "left").select(
        "request_id", "id", "token", "person_id", "effective_end_date", "status", F.col("person_email").alias("email_address"), "user_authentication_id"
    )


def token_documents(cat: Catalog, requests: DataFrame) -> DataFrame:
    paths = {
        "Id": "id", "Token": "token", "PersonId": "person_id", "EffectiveEndDate": "effective_end_date", "Status": "status", "Person.EmailAddress": "email_address",
        "Person.UserAuthentication.Id": "user_authentication_id",
    }
    return doc.as_json(doc.nest_paths(valid_tokens(cat, requests), paths, keep=["request_id"]), ["request_id"])
