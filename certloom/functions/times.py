"""UTC seconds: parsing, bucketing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400

# Fixed forms of a time value.
DATE_FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
MONTH_FORM = r"\A[0-9]{4}-[0-9]{2}\z"
DIGITS_FORM = r"\A[0-9]+\z"
ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})"
DATE_TIME_FORM = rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\.[0-9]{{1,9}})?)?{ZONE}?\z"


def seen_at(c: Column, now: Column | int) -> Column:
    """Whole seconds of a JSON number, `now` where it is missing."""
    return F.coalesce(F.floor(c).cast("long"), F.lit(now).cast("long"))


def bucket(c: Column, step: int, origin: int = 0) -> Column:
    """Start of the period of length `step` that holds second `c`."""
    return c - F.pmod(c - F.lit(origin).cast("long"), F.lit(step).cast("long"))


def hour_bucket(c: Column) -> Column:
    return bucket(c, HOUR)


def day_bucket(c: Column) -> Column:
    return bucket(c, DAY)


def bucket_index(c: Column, step: int, origin: Column | int = 0) -> Column:
    """Number of the period counted from `origin`."""
    origin = origin if isinstance(origin, Column) else F.lit(origin)
    offset = c - origin
    return F.call_function("div", offset - F.pmod(offset, F.lit(step).cast("long")), F.lit(step))


def seen_date(c: Column) -> Column:
    """UTC day of second `c`, without use of the session time zone."""
    return F.date_from_unix_date(bucket_index(c, DAY).cast("int"))


def parse_time(c: Column) -> Column:
    """`YYYY-MM-DD` is UTC midnight, digits are seconds, else an ISO date-time; null when unparsable.

    A date-time without a zone is read as UTC.
    """
    # Seconds and the colon of the zone are filled in where they are left out.
    clock = F.regexp_replace(c, rf"([T ][0-9]{{2}}:[0-9]{{2}}){ZONE}?\z", "$1:00$2")
    clock = F.regexp_replace(clock, r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2")
    text = (
        F.when(c.rlike(DATE_FORM), F.concat(c, F.lit("T00:00:00Z")))
        .when(c.rlike(MONTH_FORM), F.concat(c, F.lit("-01T00:00:00Z")))
        .when(c.rlike(DATE_TIME_FORM) & c.rlike(ZONE + r"\z"), clock)
        .when(c.rlike(DATE_TIME_FORM), F.concat(clock, F.lit("Z")))
    )
    return F.when(c.rlike(DIGITS_FORM), c.try_cast("long")).otherwise(F.unix_seconds(F.try_to_timestamp(text)))


def created_range(c: Column) -> Column:
    """`A..B` as struct(after, before); a plain end date includes that whole day."""
    parts = F.split(c, r"\.\.", 2)
    end = F.get(parts, F.lit(1))
    before = parse_time(end) + F.when(end.rlike(DATE_FORM), F.lit(DAY)).otherwise(F.lit(0))
    return F.struct(parse_time(F.get(parts, F.lit(0))).alias("after"), before.alias("before"))


def utc_text(c: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_seconds(c), pattern)


def iso_millis(c: Column) -> Column:
    return utc_text(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
