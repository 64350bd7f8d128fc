"""Null, blank, date and price rules on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest
from frames import values
from pyspark.sql import functions as F

from turnstile.functions import scalars as X
from turnstile.operators import documents as doc
from turnstile.operators import filters as flt
from turnstile.plans.payments import deposit_refund_amount


@pytest.mark.parametrize(
    "name, stripped, plain",
    [(None, "Customer", "Customer"), ("", "Customer", "Customer"), ("  ", "Customer", "Customer"), ("A/B", "AB", "A/B"), ("A\\B", "AB", "A\\B"), ("A/B\\C", "AB\\C", "A/B\\C"), ("/", "", "/"), ("Al", "Al", "Al")],
)
def test_names(spark, name, stripped, plain):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(X.clean_name("n"), X.clean_name("n", False)).first()[:] == (stripped, plain)


def test_birth_dates(spark):
    d = dt.date
    df = spark.createDataFrame([(d(1899, 12, 31),), (d(1900, 1, 1),), (None,)], "d date")
    assert [r[0] for r in df.select(X.floor_1900("d")).collect()] == [d(1900, 1, 1), d(1900, 1, 1), None]


def test_concat_reads_null_as_empty(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.concat_nn("a", F.lit(" "), "b")).collect()] == ["a ", " "]


def test_effective_window_keeps_the_outer_end_when_one_is_unknown(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d, None), (None, d), (d, dt.date(2024, 2, 1))], "a date, b date")
    assert [r[0] for r in df.select(X.effective_start("a", "b")).collect()] == [d, None, dt.date(2024, 2, 1)]


def test_holds_of_24_25_and_26_minutes(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(None,)] + [(now - dt.timedelta(minutes=m),) for m in (24, 25, 26)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    assert [r[0] for r in df.select(X.not_expired("t", 25, X.clock("2024-01-01 12:00:00"))).collect()] == [True, True, False, False]


def test_local_dates_have_a_bracket_that_reaches_the_scan(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), z) for i in range(96) for z in ("America/Los_Angeles", "Pacific/Honolulu", "UTC")]
    spark.createDataFrame(rows, "id int, ts timestamp_ntz, z string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    exact = df.filter(X.local_date("ts", "z").between("2024-01-02", "2024-01-02"))
    fast = flt.between_local_dates(df, "ts", "z", "2024-01-02", "2024-01-02")
    assert values(fast) == values(exact)
    assert "GreaterThanOrEqual(ts" in fast._jdf.queryExecution().executedPlan().toString()


def test_not_mine_in_both_forms(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "o int")
    assert values(flt.not_mine(df, "o", 1, True)) == [(2,), (None,)]
    assert values(flt.not_mine(df, "o", 1, False)) == [(2,)]


def test_reject_reason_is_the_first_broken_rule(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, bad boolean")
    ok, rejected = flt.split_rejects(df, [("bad", F.col("bad")), ("three", F.col("id") == 3)])
    assert values(ok, "id") == [(1,)]
    assert values(rejected, "id", "reject_reason") == [(2, "bad"), (3, "three")]


@pytest.mark.parametrize("flag, amount, expected", [(False, 10, 7), (True, 10, 15), (True, 0, 5), (True, -10, -10), (None, 10, 15), (None, -10, -10), (False, -10, -13)])
def test_refund_amounts(spark, flag, amount, expected):
    df = spark.createDataFrame([(flag, amount)], "f boolean, a int")
    assert df.select(deposit_refund_amount(F.col("f"), F.col("a"), F.lit(3), F.lit(5))).first()[0] == expected


def test_half_price_only_for_a_zero_list_price(spark):
    df = spark.createDataFrame([(Decimal(0), Decimal("5.05")), (Decimal(3), Decimal(9)), (Decimal(0), None)], "l decimal(18,6), e decimal(18,6)")
    assert [r[0] for r in df.select(X.half_price("l", "e")).collect()] == [Decimal("2.53"), Decimal(3), None]


def test_objects_without_members_are_left_out(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "k int, a string, b string")
    out = doc.as_json(doc.nest_paths(df, {"Id": "k", "P.Q.A": "a", "P.B": "b"}, keep=["k"]), ["k"])
    assert values(out, "document") == [('{"Id":1}',), ('{"Id":2,"P":{"Q":{"A":"x"}}}',)]


def test_zone_names_of_the_source(spark):
    df = spark.createDataFrame([("Central Standard Time",), ("Europe/Paris",), (None,)], "z string")
    assert [r[0] for r in df.select(X.iana_zone("z")).collect()] == ["America/Chicago", "Europe/Paris", None]
