"""Market calendars (Column to Column). Instants are UTC; dates are those of a venue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The local venue's zone and session.
LOCAL_ZONE, SESSION_OPEN, SESSION_CLOSE = "America/Argentina/Buenos_Aires", "11:30:00", "18:00:00"
# End of fixed values.


def to_zone(instant: Column, zone: Column | str) -> Column:
    """The wall clock of a zone, as a timestamp without zone."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), zone, instant.cast("timestamp_ntz"))


def market_date(instant: Column, zone: Column | str = LOCAL_ZONE) -> Column:
    return to_zone(instant, zone).cast("date")


def is_within_session(instant: Column, zone: str = LOCAL_ZONE, opens: str = SESSION_OPEN, closes: str = SESSION_CLOSE) -> Column:
    clock = F.date_format(to_zone(instant, zone), "HH:mm:ss")
    return (clock >= opens) & (clock < closes)


def session_bound(day: Column, clock: str, zone: str = LOCAL_ZONE) -> Column:
    """The UTC instant of a local clock time on a day."""
    local = F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(f" {clock}")))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def business_days(start: Column, end: Column) -> Column:
    """Monday to Friday in [start, end]; none where the end comes first."""
    days = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def epoch_market_date(seconds: Column, zone: Column) -> Column:
    return market_date(F.timestamp_seconds(seconds), zone)


def parse_instant(text: Column) -> Column:
    """An ISO-8601 instant with an offset, as UTC; null for malformed ones and those without an offset."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
