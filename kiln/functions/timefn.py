"""Time scalars: epoch to hour of day, floor-modulo shift, recency, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kiln.functions._col import as_col

__all__ = ["epoch_to_hour", "shift_hour", "recent", "format_in_zone", "epoch_seconds"]


def epoch_seconds(ts) -> Column:
    """Timestamp (or timestamp_ntz read as UTC) -> epoch seconds as double."""
    return F.unix_micros(as_col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def epoch_to_hour(epoch, legacy_float32: bool = False) -> Column:
    """Hour of day plus minute/60 from epoch seconds (UTC session)."""
    e = as_col(epoch)
    if legacy_float32:
        e = e.cast("float").cast("double")
    ts = F.timestamp_seconds(e)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def shift_hour(hour, shift: float = -18) -> Column:
    """(hour + shift) with floor modulo 24, never negative."""
    return F.pmod(as_col(hour) + F.lit(shift), F.lit(24))


def recent(ts, as_of: str, days: int) -> Column:
    """Rows younger than ``days`` exact days before ``as_of`` (later rows pass)."""
    return as_col(ts) > (F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def format_in_zone(ts, zone: str = "America/New_York") -> Column:
    """UTC timestamp rendered as wall time in ``zone`` to microseconds."""
    return F.date_format(F.from_utc_timestamp(as_col(ts).cast("timestamp"), zone),
                         "yyyy-MM-dd HH:mm:ss.SSSSSS")
