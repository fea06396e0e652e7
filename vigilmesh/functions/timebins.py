"""Event-time bins as integer arithmetic on columns: no UDF, usable in filters and groupings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilmesh import policies


def floor_to(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bin of ``seconds`` that contains ``ts``."""
    epoch = F.unix_seconds(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def ceil_to(ts: Column, seconds: int) -> Column:
    micros = F.unix_micros(ts)
    rest = F.pmod(micros, F.lit(seconds * 1_000_000))
    return F.timestamp_micros(F.when(rest == 0, micros).otherwise(micros - rest + seconds * 1_000_000))


def shift(ts: Column, seconds) -> Column:
    """``ts`` moved by whole seconds; ``seconds`` may be a column."""
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.unix_seconds(later) - F.unix_seconds(earlier)


def hour_of_week(ts: Column) -> Column:
    """0 for Monday 00:00–00:59 UTC, 167 for Sunday 23:00."""
    return F.weekday(ts) * 24 + F.hour(ts)


def local_slot(ts: Column, timezone: str = policies.BASELINE["timezone"], minutes: int = 5) -> dict[str, Column]:
    """Civil slot, weekday class and date. The repeated hour of a clock change shares its slots."""
    local = F.from_utc_timestamp(ts, timezone)
    return {
        "slot": ((F.hour(local) * 60 + F.minute(local)) / minutes).cast("int"),
        "weekday_class": F.when(F.weekday(local) >= 5, "WEEKEND").otherwise("WEEKDAY"),
        "local_date": F.to_date(local),
    }


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def request_bounds(start: str, end: str, resolution: str) -> dict:
    """Bucket-aligned bounds of a request, whether its edges are partial, and its point count."""
    if resolution not in policies.RESOLUTIONS:
        raise ValueError(f"unsupported resolution {resolution}")
    seconds = policies.RESOLUTIONS[resolution]
    lo, hi = (datetime.fromisoformat(x) for x in (start, end))
    if hi <= lo or hi - lo > timedelta(days=policies.MAX_RANGE_DAYS):
        raise ValueError("a query covers more than zero and at most 30 days")
    epoch = datetime(1970, 1, 1)
    lo_s, hi_s = ((x - epoch).total_seconds() for x in (lo, hi))
    eff_lo = int(lo_s // seconds * seconds)
    eff_hi = int(-(-hi_s // seconds) * seconds)
    points = (eff_hi - eff_lo) // seconds
    if points > policies.MAX_POINTS:
        raise ValueError("too many points")
    return {
        "seconds": seconds,
        "effective_from": epoch + timedelta(seconds=eff_lo),
        "effective_to": epoch + timedelta(seconds=eff_hi),
        "partial_start": eff_lo < lo_s,
        "partial_end": eff_hi > hi_s,
        "points": points,
    }
