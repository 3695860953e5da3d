"""Date expressions; bad dates become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ISO_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd"]
_FREE_FORMATS = ["dd MMM yyyy HH:mm:ss X", "dd MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss z", "MMM d, yyyy", "MMMM d, yyyy"]


def parse_lenient(c: Column) -> Column:
    """Timestamp from ISO, RFC-822 (weekday dropped) or "Mar 5, 2024"."""
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s+(?=\d)", "")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in _ISO_FORMATS + _FREE_FORMATS]
    return F.coalesce(*tries)


def iso(ts: Column) -> Column:
    """ISO-8601 text with milliseconds and a Z, as stored in ledgers."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_day(ts_ntz: Column, zone: str = "America/Chicago") -> Column:
    """Calendar day of a UTC wall-clock timestamp in a named zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_ntz))


def within_days(ts: Column, start: str, end: str) -> Column:
    """Inclusive day range, written as a half-open range so that it is
    pushed to the scan."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (
        ts < (F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    )


def next_check(ts: Column, attempt: Column) -> Column:
    """Exponential backoff: 5 minutes doubling to a day."""
    minutes = F.least(F.lit(1440.0), 5 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))
