"""Request predicates and projections. All are plain column expressions, so they push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh.functions.timebins import ceil_to, floor_to


def half_open(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    return (from_a < to_b) & (from_b < to_a)


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; a value of None means any, a callable builds its own predicate."""
    for name, value in wanted.items():
        if value is None:
            continue
        df = df.where(value(F.col(name)) if callable(value) else F.col(name) == value)
    return df


def bucket_bounds(start: Column, end: Column, seconds: int) -> dict[str, Column]:
    lo, hi = floor_to(start, seconds), ceil_to(end, seconds)
    return {
        "effective_from": lo,
        "effective_to": hi,
        "partial_start": lo < start,
        "partial_end": hi > end,
        "points": ((F.unix_seconds(hi) - F.unix_seconds(lo)) / seconds).cast("bigint"),
    }


def kpi_value(kpis: Column, name: str, field: str = "observed") -> Column:
    """One field of the named entry of a KPI array; null when the entry is absent."""
    return F.get(F.filter(kpis, lambda k: k["name"] == name), F.lit(0))[field]


def kpi_columns(df: DataFrame, names: list[str], kpis: str = "kpis") -> DataFrame:
    return df.select("*", *[kpi_value(F.col(kpis), n).alias(n) for n in names])
