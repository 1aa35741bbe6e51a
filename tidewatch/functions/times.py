"""UTC conversion, ISO text and ISO parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_utc(column: Column) -> Column:
    """Naive timestamps are taken as UTC (the session time zone); zoned ones keep their instant."""
    return column.cast("timestamp")


def iso_utc(column: Column) -> Column:
    """ISO-8601 text in UTC; the fraction is written only when there is one."""
    stamp = column.cast("timestamp")
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(stamp) % 1_000_000 == 0, whole).otherwise(fraction)


def is_iso_text(text: Column) -> Column:
    """Full dates only: a cast alone would also take a bare number as a year."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}")


def parse_iso(text: Column) -> Column:
    """ISO text to an instant, null when it is not a full date or does not parse."""
    return F.when(is_iso_text(text), text.try_cast("timestamp"))
