"""Column expressions whose null, blank and clock rules differ from Spark's defaults."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstile import codes

MONEY = "decimal(18,6)"
# Our own reading of a well-formed address: local part, '@', dotted host, alphabetic suffix.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def clock(as_of) -> Column:
    """A point in time as a zone-less UTC timestamp; the session clock only when none is given."""
    if as_of is None:
        return F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime) and as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc)
    text = as_of.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(as_of, dt.datetime) else str(as_of)
    return F.lit(text).cast("timestamp_ntz")


def day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


# --- text -------------------------------------------------------------------------------------

def concat_nn(*cols) -> Column:
    """Concatenate with NULL read as the empty string."""
    return F.concat(*[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols])


def is_blank(col) -> Column:
    """NULL, empty or only trailing blanks."""
    return F.coalesce(F.rtrim(as_col(col)) == "", F.lit(True))


def clean_name(col, strip_slashes: bool = True) -> Column:
    """Printable contact name: one kind of slash removed, blanks become 'Customer'."""
    name = as_col(col)
    result = F.when(is_blank(name), F.lit("Customer")).otherwise(name)
    if strip_slashes:
        # A name holding both slashes only loses the forward ones.
        result = (
            F.when(name.contains("/"), F.replace(name, F.lit("/"), F.lit("")))
            .when(name.contains("\\"), F.replace(name, F.lit("\\"), F.lit("")))
            .otherwise(result)
        )
    return result


def valid_email(col) -> Column:
    return F.coalesce(as_col(col).rlike(EMAIL_PATTERN), F.lit(False))


def email_or_blank(col) -> Column:
    return F.when(valid_email(col), as_col(col)).otherwise(F.lit(""))


def after_last(col, marker: str) -> Column:
    """Text behind the last marker; all of it where the marker is missing."""
    return F.substring_index(as_col(col), marker, -1)


def before_last(col, marker: str) -> Column:
    """Text in front of the last marker; empty where the marker is missing."""
    text = as_col(col)
    tail = F.substring_index(text, marker, -1)
    return F.when(
        text.contains(marker), F.left(text, F.length(text) - F.length(tail) - F.lit(len(marker)))
    ).otherwise(F.lit(""))


# --- conditions -------------------------------------------------------------------------------

def iif(condition: Column, then, otherwise) -> Column:
    """Two-way choice in which an unknown condition takes the second value."""
    return F.when(condition, then).otherwise(otherwise)


def isnull_as(col, default, dtype: str) -> Column:
    """First value or its default, in the type of the first value."""
    return F.coalesce(as_col(col).cast(dtype), F.lit(default).cast(dtype) if not isinstance(default, Column) else default.cast(dtype))


# --- money ------------------------------------------------------------------------------------

def money(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(MONEY)


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def or_zero(col) -> Column:
    return F.coalesce(as_col(col), zero())


def half_price(list_price, extra_price) -> Column:
    """List price, or half the extra price (to the cent) where the list price is 0."""
    return F.when(as_col(list_price) == 0, F.round(as_col(extra_price) * F.lit(0.5).cast("decimal(2,1)"), 2).cast(MONEY)).otherwise(
        as_col(list_price)
    )


def keep_price(new_key, old_key, old_price, list_price) -> Column:
    """An unchanged reference keeps the agreed price; a new one takes the list price."""
    return F.when(as_col(new_key) == as_col(old_key), as_col(old_price)).otherwise(as_col(list_price))


# --- dates and clocks -------------------------------------------------------------------------

def iana_zone(col) -> Column:
    """Zone names of the source data as IANA ids; ids pass through."""
    zone = as_col(col)
    pairs = F.create_map(*[F.lit(x) for pair in codes.ZONES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, zone), zone)


def local_time(ts, zone) -> Column:
    """Wall clock in a zone for a zone-less UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), iana_zone(zone), as_col(ts))


def local_date(ts, zone) -> Column:
    return F.to_date(local_time(ts, zone))


def stored_date(ts, offset_minutes=None) -> Column:
    """Date as written: shifted by the offset kept next to the instant, if there is one."""
    if offset_minutes is None:
        return F.to_date(as_col(ts))
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(as_col(offset_minutes), F.lit(0)).cast("int"), F.lit(0))
    return F.to_date(as_col(ts) + shift)


def dow0(date) -> Column:
    """Day of week, Sunday = 0."""
    return F.dayofweek(as_col(date)) - F.lit(1)


def month_start(ts) -> Column:
    return F.trunc(F.to_date(as_col(ts)), "MM")


def next_month_start(ts) -> Column:
    return F.date_add(F.last_day(F.to_date(as_col(ts))), 1)


def floor_1900(date) -> Column:
    d = as_col(date)
    return F.when(F.year(d) < 1900, F.lit("1900-01-01").cast("date")).otherwise(d)


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} MINUTES")


def not_expired(ts, ttl_minutes: int, as_of) -> Column:
    """A hold still counts until its minutes are over, or for ever when it has no start."""
    t = as_col(ts)
    return t.isNull() | ((t + minutes(ttl_minutes)) > as_of)


def effective_start(outer, inner) -> Column:
    """Later of two starts; the outer one where either is unknown."""
    a, b = as_col(outer), as_col(inner)
    return F.when(a < b, b).otherwise(a)


def effective_end(outer, inner) -> Column:
    a, b = as_col(outer), as_col(inner)
    return F.when(a > b, b).otherwise(a)


def overlaps(start, end, low, high) -> Column:
    """Closed interval [start, end] meets [low, high]; an open end stands for one day."""
    s, lo, hi = as_col(start), as_col(low), as_col(high)
    e = F.coalesce(as_col(end), s)
    return lo.between(s, e) | hi.between(s, e) | ((lo <= s) & (hi >= e))


# --- keys -------------------------------------------------------------------------------------

def fingerprint(col) -> Column:
    """64-bit pre-filter for long text; equality must still be tested."""
    return F.xxhash64(as_col(col))


def derived_uuid(*cols) -> Column:
    """Identifier in UUID form that a re-run of the same rows repeats; each part is written with its length, so that
    different keys differ, nulls and separators included."""
    texts = [as_col(c).cast("string") for c in cols]
    digest = F.upper(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))
    cut = lambda start, size: F.substring(digest, start, size)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
