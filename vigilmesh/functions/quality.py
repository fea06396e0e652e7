"""Quality states and the three folds of the domain, kept apart because they disagree on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilmesh import policies


def rank(state: Column) -> Column:
    expr = F.lit(None).cast("int")
    for name, position in policies.QUALITY_RANK.items():
        expr = F.when(state == name, F.lit(position)).otherwise(expr)
    return expr


def from_rank(position: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, value in policies.QUALITY_RANK.items():
        expr = F.when(position == value, F.lit(name)).otherwise(expr)
    return expr


def native_quality(source_quality: Column, source_coverage: Column) -> Column:
    """Quality of one native row from what its source declared."""
    return (
        F.when(source_quality.isNotNull() & (source_quality != "VALID"), source_quality)
        .when(source_quality.isNull() | source_coverage.isNull(), "INSUFFICIENT_EVIDENCE")
        .when(source_coverage < 1, "PARTIAL")
        .otherwise("VALID")
    )


def native_reason(source_quality: Column, source_coverage: Column) -> Column:
    return (
        F.when(source_quality.isNull(), "SOURCE_QUALITY_UNAVAILABLE")
        .when(source_coverage.isNull(), "SOURCE_COVERAGE_UNAVAILABLE")
        .when(source_quality != "VALID", F.concat(F.lit("SOURCE_"), source_quality))
        .when(source_coverage < 1, "SOURCE_COVERAGE_PARTIAL")
    )


def api_fold(coverage: Column, stale: Column, invalid: Column, source_unknown: Column, denominator: Column) -> Column:
    """Quality of a bucket in the stored-window series."""
    return (
        F.when((coverage > 0) & (denominator == 0), "INSUFFICIENT_EVIDENCE")
        .when((coverage > 0) & source_unknown, "INSUFFICIENT_EVIDENCE")
        .when((coverage == 0) & stale, "STALE")
        .when(coverage == 0, "MISSING")
        .when((coverage < 1) | invalid, "PARTIAL")
        .otherwise("VALID")
    )


def producer_fold(worst: Column, received: Column, expected: Column, denominator: Column) -> Column:
    """Quality rank of a producer bucket: the worst member, lifted by missing slots or no population."""
    base = F.when((received < expected) & (worst < 1), F.lit(1)).otherwise(worst)
    base = F.when((denominator == 0) & (base < 2), F.lit(2)).otherwise(base)
    return F.when(received == 0, F.lit(4)).otherwise(base)


def reference_fold(received: Column, expected: Column, snapshot_age: Column, reason: Column) -> Column:
    """Quality of a reference-series bucket. Source quality is unknown, so it is never VALID."""
    return (
        F.when((received == 0) & snapshot_age.isNull(), "MISSING")
        .when(snapshot_age > policies.SNAPSHOT_MAX_AGE_SECONDS, "STALE")
        .when(reason.isNotNull(), "INSUFFICIENT_EVIDENCE")
        .when(received < expected, "PARTIAL")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


def reference_reason(received: Column, expected: Column, snapshot_age: Column, reason: Column) -> Column:
    return (
        F.when(reason.isNotNull(), reason)
        .when(snapshot_age > policies.SNAPSHOT_MAX_AGE_SECONDS, "RETAINED_SNAPSHOT_STALE")
        .when(received < expected, "MISSING_SOURCE_SLOTS")
        .otherwise("SOURCE_QUALITY_UNAVAILABLE")
    )
