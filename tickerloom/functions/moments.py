"""Timezone-free time expressions on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a bar frequency. Anything else means daily bars.
FREQUENCY_ALIASES = {
    "daily": "day",
    "1D": "day",
    "1H": "hour",
    "1Min": "minute",
}

BUCKETS = {"day": "1 day", "hour": "1 hour", "minute": "1 minute"}


def canonical_frequency(name: str | None) -> str:
    """``day``, ``hour`` or ``minute`` for any accepted spelling."""
    if name in BUCKETS:
        return name
    return FREQUENCY_ALIASES.get(name, "day")


def naive_utc(moment: datetime) -> datetime:
    """The UTC wall-clock time of ``moment``; naive values are taken as UTC already."""
    if moment.tzinfo is None:
        return moment
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def moment_literal(moment: datetime) -> Column:
    """A TIMESTAMP_NTZ literal, so that comparisons are pushed down to the scan."""
    return F.expr(f"TIMESTAMP_NTZ '{naive_utc(moment):%Y-%m-%d %H:%M:%S.%f}'")


def utc_wall_clock(instant: str) -> Column:
    """TIMESTAMP column to the TIMESTAMP_NTZ a UTC clock shows, in any session time zone.

    A plain cast would go through local time, where the hour a clock is set back is
    ambiguous.
    """
    seconds = f"cast(cast(unix_micros({instant}) as decimal(20, 0)) / 1000000 as decimal(18, 6))"
    return F.expr(f"TIMESTAMP_NTZ '1970-01-01' + make_dt_interval(0, 0, 0, {seconds})")


def utc_instant(wall_clock: str) -> Column:
    """TIMESTAMP_NTZ column, read as UTC, to a TIMESTAMP; inverse of ``utc_wall_clock``."""
    minutes = f"hour({wall_clock}) * 60L + minute({wall_clock})"
    micros = f"cast(extract(second from {wall_clock}) * 1000000 as bigint)"
    return F.expr(
        f"timestamp_micros((unix_date(cast({wall_clock} as date)) * 1440L + {minutes})"
        f" * 60000000L + {micros})"
    )


def delayed_as_of(run_ts: datetime, minutes: int = 20) -> datetime:
    """The latest moment the data can be complete for, given the feed's delay."""
    return naive_utc(run_ts) - timedelta(minutes=minutes)


def lookback_start(as_of: datetime, days_back: float) -> datetime:
    return naive_utc(as_of) - timedelta(days=days_back)


def in_lookback(ts: Column, as_of: datetime, days_back: float) -> Column:
    """``ts`` within ``days_back`` days up to ``as_of``, both ends included."""
    return ts.between(
        moment_literal(lookback_start(as_of, days_back)), moment_literal(as_of)
    )


def bucket_start(ts: Column, frequency: str) -> Column:
    """Start of the day, hour or minute ``ts`` falls in, as TIMESTAMP_NTZ."""
    return F.window(ts, BUCKETS[canonical_frequency(frequency)])["start"]
