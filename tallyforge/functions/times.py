"""Time functions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAS_ZONE = r"(?i)(z|[+-]\d{2}:?\d{2})$"


def iso_micros(col: Column) -> Column:
    """Microseconds since 1970 UTC of ISO text; text without a zone is UTC, unusable text is NULL."""
    text = F.trim(col)
    return F.unix_micros(F.when(text.rlike(HAS_ZONE), text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))


def micros_text(col: Column) -> Column:
    """`yyyy-MM-ddTHH:mm:ssZ` of microseconds since 1970, in UTC whatever the session's zone."""
    seconds = F.floor(col / 1_000_000)
    day = F.floor(seconds / 86400).cast("int")
    rest = (seconds - F.floor(seconds / 86400) * 86400).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60))
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def local_to_utc_micros(date: Column, time: Column, zone: str = "America/New_York") -> Column:
    """Kickoff text `yyyy-MM-dd` and `HH:mm` of a wall clock in `zone`, as microseconds UTC; bad text is NULL."""
    local = F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm"))
    return F.unix_micros(F.to_utc_timestamp(local, zone))
