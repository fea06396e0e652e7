"""Row validation: each validator adds one ``reason`` column, null for a valid row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """Reason of the first check that is true, in order."""
    reason = None
    for condition, name in checks:
        reason = F.when(condition, name) if reason is None else reason.when(condition, name)
    return reason


def split(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows). Both read the same plan; cache or write upstream if it is costly."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def _total(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0).cast("bigint"), lambda a, x: a + x)


#: Fixed value: the largest integer that every JSON reader keeps exactly.
MAX_COUNTER = 9_007_199_254_740_991


def unless(good: Column) -> Column:
    """The failed check of a condition that has to hold: a null condition has not held."""
    return ~F.coalesce(good, F.lit(False))


def bad_time(start: Column, end: Column) -> list[tuple[Column, str]]:
    ts = F.col("ts")
    return [
        (ts.isNull(), "MALFORMED"),
        (F.pmod(F.unix_seconds(ts), F.lit(policies.SLOT_SECONDS)) != 0, "UNALIGNED"),
        (unless((ts >= start) & (ts < end)), "OUT_OF_BOUNDS"),
    ]


def bad_counters(*names: str) -> list[tuple[Column, str]]:
    return [(unless(F.col(n).between(0, MAX_COUNTER)), f"COUNTER_RANGE:{n}") for n in names]


def bad_amounts(*names: str) -> list[tuple[Column, str]]:
    return [(unless(F.col(n) >= 0), f"NEGATIVE:{n}") for n in names]


def subset(numerator: str, denominator: str) -> Column:
    return unless(F.col(numerator) <= F.col(denominator))


def bad_histogram(name: str, cohort: str, label: str) -> list[tuple[Column, str]]:
    bins = F.col(name)
    return [
        (unless(F.size(bins) == 9), f"HISTOGRAM_WIDTH:{label}"),
        (unless(F.forall(bins, lambda n: F.coalesce(n.between(0, MAX_COUNTER), F.lit(False)))), f"HISTOGRAM_COUNT:{label}"),
        (unless(_total(bins) == F.col(cohort)), f"HISTOGRAM_COHORT:{label}"),
    ]


def native_city_reason(start: Column, end: Column) -> Column:
    pairs = ("voice", "data", "dns", "ho")
    counters = [f"{p}_{part}" for p in pairs for part in ("attempts", "success")]
    return first_reason([
        *bad_time(start, end),
        *bad_counters(*counters, "voice_drops", "sms_submitted", "sms_delivered", "sms_expired", "sms_queue"),
        *bad_amounts("voice_holding_seconds", "voice_setup_elapsed_seconds", "sms_oldest_seconds", "user_throughput_mbps"),
        *[(subset(f"{p}_success", f"{p}_attempts"), f"SUCCESS_EXCEEDS_ATTEMPTS:{p}") for p in pairs],
        (subset("voice_drops", "voice_success"), "DROPS_EXCEED_SUCCESS"),
        *bad_histogram("voice_setup_hist", "voice_success", "voice"),
        *bad_histogram("sms_delay_hist", "sms_delivered", "sms"),
    ])


def native_link_reason(start: Column, end: Column) -> Column:
    return first_reason([
        *bad_time(start, end),
        (unless(F.col("effective_capacity_gbps") > 0), "ABSENT_CAPACITY"),
        (unless(F.col("loss_pct") <= 100), "INVALID_LOSS"),
        *bad_amounts("traffic_gbps", "loss_pct", "rtt_ms", "jitter_ms"),
        *bad_counters("interface_errors", "queue_drops"),
    ])


def native_roaming_reason(start: Column, end: Column) -> Column:
    pairs = ("reg", "data", "voice", "sms")
    return first_reason([
        *bad_time(start, end),
        (unless(F.col("direction").isin("in", "out")), "UNKNOWN_DIRECTION"),
        (unless(F.col("partner_id") == F.concat("country_id", F.lit("-DEMO-01"))), "UNKNOWN_PARTNER"),
        *bad_counters("active_users", *[f"{p}_{part}" for p in pairs for part in ("attempts", "success")]),
        *bad_amounts("rtt_ms"),
        *[(subset(f"{p}_success", f"{p}_attempts"), f"SUCCESS_EXCEEDS_ATTEMPTS:{p}") for p in pairs],
    ])


def against_dictionary(claims: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Claims with their definition and a reason for unknown metrics or other units and policies.

    The dictionary has 41 rows, so it is broadcast.
    """
    known = dictionary.select(
        "metric_id", F.col("unit").alias("d_unit"), F.col("policy_version").alias("d_policy"),
        "aggregation_type", "primitive_fields", F.col("domain").alias("d_domain"),
    )
    reason = first_reason([
        (F.col("d_unit").isNull(), "UNKNOWN_METRIC"),
        (F.col("d_unit") != F.col("unit"), "UNIT_MISMATCH"),
        (F.col("d_policy") != F.col("policy_version"), "POLICY_MISMATCH"),
    ])
    return claims.join(F.broadcast(known), "metric_id", "left").withColumn("reason", reason)


def measurement_reason() -> Column:
    """Reason of a five-minute domain measurement already joined to the dictionary.

    Columns: quality, coverage, numerator, denominator, weight, valid_seconds, snapshot_at, histogram,
    field_names and the dictionary's.
    """
    c = F.col
    missing, unavailable = c("quality") == "MISSING", c("quality") == "INSUFFICIENT_EVIDENCE"
    nothing = c("numerator").isNull() & c("denominator").isNull() & c("snapshot_at").isNull() & c("histogram").isNull()
    seen = ~missing
    return first_reason([
        (c("reason").isNotNull(), "DICTIONARY"),
        (F.array_sort("field_names") != F.array_sort("primitive_fields"), "PRIMITIVE_FIELDS"),
        (missing & (c("coverage") != 0), "MISSING_COVERAGE"),
        (missing & ~nothing, "MISSING_WITH_EVIDENCE"),
        (seen & unless(c("coverage") > 0), "NO_COVERAGE"),
        (seen & ~unavailable & nothing, "NO_PRIMITIVES"),
        (seen & (c("numerator").isNull() != c("denominator").isNull()), "HALF_A_RATIO"),
        (seen & ((c("numerator") < 0) | (c("denominator") < 0)), "NEGATIVE"),
        (c("quality").isNull() | ((c("quality") == "VALID") & (c("coverage") != 1)), "VALID_NEEDS_FULL_COVERAGE"),
        ((c("quality") == "PARTIAL") & (c("coverage") >= 1), "PARTIAL_NEEDS_PARTIAL_COVERAGE"),
        (seen & (c("numerator") > c("denominator")), "SUCCESS_EXCEEDS_ATTEMPTS"),
        (seen & (c("denominator") == 0) & ~unavailable, "ZERO_DENOMINATOR"),
        (seen & (c("valid_seconds") > policies.SLOT_SECONDS), "WEIGHT_EXCEEDS_DURATION"),
        (seen & (((c("quality") != "STALE") & (c("snapshot_at") < c("window_start")))
                 | (c("snapshot_at") >= c("window_end"))), "SAMPLE_OUTSIDE_WINDOW"),
        ((c("quality") == "STALE") & (c("aggregation_type") != "SNAPSHOT_LAST"), "STALE_NEEDS_SNAPSHOT"),
        (seen & c("histogram").isNotNull() & (F.size("histogram") != 9), "HISTOGRAM_EDGES"),
        (seen & c("histogram").isNotNull() & (_total(c("histogram")) == 0) & ~unavailable, "EMPTY_HISTOGRAM"),
    ])


def evidence_reason(tolerance: float = 1e-9) -> Column:
    """Reason of detector evidence: everything derived is recomputed from primitives and compared.

    Columns: kind (RATIO, SUM_COUNT, SNAPSHOT), numerator, denominator, actual, baseline,
    baseline_version, deviation, coverage, quality, quality_reason, freshness, observed_at, as_of,
    source_age_seconds, max_age_seconds, unit, window_start, window_end.
    """
    c = F.col
    hundred = F.when(c("kind") == "RATIO", 100.0).otherwise(1.0)
    expected = F.when(
        c("kind") == "SNAPSHOT", c("numerator").cast("double")
    ).otherwise(F.try_divide(c("numerator").cast("double") * hundred, c("denominator").cast("double")))
    age = F.unix_seconds("as_of") - F.unix_seconds("observed_at")
    fresh = age <= c("max_age_seconds")

    def differs(got: Column, want: Column) -> Column:
        return (got.isNull() != want.isNull()) | F.coalesce(F.abs(got - want) > tolerance, F.lit(False))

    computable = expected.isNotNull()
    usable = c("quality").isin("VALID", "PARTIAL")
    return first_reason([
        (c("window_start") >= c("window_end"), "INVALID_WINDOW"),
        ((c("freshness") == "UNKNOWN") & c("observed_at").isNotNull(), "UNKNOWN_FRESHNESS_HAS_AGE"),
        ((c("freshness") != "UNKNOWN") & c("observed_at").isNull(), "FRESHNESS_METADATA"),
        ((age < 0) | (age != c("source_age_seconds")), "SOURCE_AGE"),
        (c("observed_at").isNotNull() & ((c("freshness") == "FRESH") != fresh), "FRESHNESS_MISMATCH"),
        ((c("kind") == "RATIO") & (c("numerator") > c("denominator")), "NUMERATOR_EXCEEDS_POPULATION"),
        ((c("kind") == "SNAPSHOT") & ((c("observed_at") < c("window_start")) | (c("observed_at") >= c("window_end"))),
         "SNAPSHOT_TIME"),
        (differs(c("actual"), expected), "ACTUAL_MISMATCH"),
        ((c("unit") == "PERCENT") & ((expected < 0) | (expected > 100)), "PERCENT_RANGE"),
        (c("baseline").isNull() != c("baseline_version").isNull(), "BASELINE_VERSION_MISSING"),
        ((c("unit") == "PERCENT") & ((c("baseline") < 0) | (c("baseline") > 100)), "BASELINE_RANGE"),
        (differs(c("deviation"), expected - c("baseline")), "DEVIATION_MISMATCH"),
        (usable & ~(computable & (c("freshness") == "FRESH")), "USABLE_NEEDS_FRESH_VALUE"),
        ((c("quality") == "VALID") & (c("coverage") != 1), "VALID_COVERAGE"),
        ((c("quality") == "PARTIAL") & ((c("coverage") <= 0) | (c("coverage") >= 1)), "PARTIAL_COVERAGE"),
        ((c("quality") == "MISSING") & (computable | (c("coverage") != 0)), "MISSING_WITH_MEASUREMENT"),
        ((c("quality") == "STALE") & (c("freshness") != "STALE"), "STALE_MISMATCH"),
        ((c("quality") == "INSUFFICIENT_EVIDENCE") & computable, "INSUFFICIENT_HAS_ACTUAL"),
        ((c("quality") == "VALID") != c("quality_reason").isNull(), "QUALITY_REASON"),
    ])
