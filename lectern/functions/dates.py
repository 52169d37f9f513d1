"""Date scalars: .NET ticks, Unix seconds, ISO strings; empty text stands for no date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_TO_UNIX = 621355968000000000
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# The layouts a feed's date may have.
FEED_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def iso(seconds: Column) -> Column:
    """Whole seconds since 1970 as RFC 3339 in UTC, whatever the session's zone."""
    t = F.timestamp_seconds(seconds)
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), ISO)


def ticks_to_iso(ticks: Column) -> Column:
    seconds = F.floor((ticks.cast("decimal(20,0)") - TICKS_TO_UNIX) / 10_000_000).cast("long")
    return F.when(F.coalesce(ticks, F.lit(0)) == 0, F.lit("")).otherwise(iso(seconds))


def iso_to_ticks(text: Column) -> Column:
    """Ticks of a date or RFC 3339 time; 0 where it can't be read, which turns a filter off."""
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), text)
    return F.coalesce(F.unix_seconds(zoned.try_cast("timestamp")) * 10_000_000 + TICKS_TO_UNIX, F.lit(0).cast("long"))


def seconds_to_iso(seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, F.lit("")).otherwise(iso(seconds.cast("long")))


def feed_seconds(value: Column) -> Column:
    """Seconds of a number or of one of four layouts, else 0."""
    parsed = [F.unix_seconds(F.try_to_timestamp(value, F.lit(x))).cast("double") for x in FEED_LAYOUTS]
    return F.coalesce(value.try_cast("double"), *parsed, F.lit(0.0))


def utc_now() -> Column:
    return iso(F.unix_seconds(F.current_timestamp()))
