"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eastern_minutes(ts: Column) -> Column:
    """Minutes of the day in New York of a UTC timestamp (session time zone UTC)."""
    t = F.from_utc_timestamp(ts, "America/New_York")
    return F.hour(t) * 60 + F.minute(t)


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def last_quarter_end(date: Column, exact: bool = True) -> Column:
    """The latest quarter's last day up to the date. With exact=False only 31 December counts on its own day, and
    31 March, 30 June and 30 September give the previous 31 December, 31 March and 30 June."""
    ended = F.date_sub(F.date_trunc("quarter", date).cast("date"), 1)
    own = F.last_day(date) == date
    is_end = own & F.month(date).isin(*((3, 6, 9, 12) if exact else (12,)))
    return F.when(is_end, date).otherwise(ended)


def publication(settlement: Column, lag: int = 14) -> Column:
    return F.date_add(settlement, lag)


def announcement(effective: Column, lead: int = 5) -> Column:
    return F.date_sub(effective, lead)
