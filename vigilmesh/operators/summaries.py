"""Range summaries of cities, links and roaming partners, and the SMS queue balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.arithmetic import divide, half_up, histogram_quantile, percent
from vigilmesh.functions.timebins import seconds_between

# The summed columns of the city archive.
CITY_SUMS = [
    "voice_attempts", "voice_success", "voice_drops", "voice_holding_seconds", "voice_setup_elapsed_seconds",
    "sms_submitted", "sms_delivered", "sms_expired", "data_attempts", "data_success", "dns_attempts", "dns_success",
    "ho_attempts", "ho_success", "user_throughput_mbps",
]


def city_summary(rows: DataFrame, period: Column, expected_rows: int) -> DataFrame:
    """Per period: counters over all cities, eleven rates, and the newest queue of each city.

    One shuffle of partial sums per (period, city, bitmap of slots) serves both the sums over cities and
    the distinct slots; a bitmap holds 32,768 slots, so a period of any length has as many as it needs.
    """
    parts = (
        rows.withColumn("period", period)
        .groupBy("period", "city_id", F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket"))
        .agg(
            *[F.sum(c).alias(c) for c in CITY_SUMS],
            *[F.sum(F.col("voice_setup_hist")[i]).alias(f"v{i}") for i in range(9)],
            *[F.sum(F.col("sms_delay_hist")[i]).alias(f"s{i}") for i in range(9)],
            F.count("*").alias("row_count"),
            F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("slots"),
            F.max_by(F.struct("ts", "sms_queue", "sms_oldest_seconds"), "ts").alias("newest"),
        )
    )
    slots = (
        parts.groupBy("period", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("slots")).alias("slot_count"))
        .groupBy("period").agg(F.sum("slot_count").alias("slot_count"))
    )
    bins = [f"{kind}{i}" for kind in "vs" for i in range(9)]
    per_city = parts.groupBy("period", "city_id").agg(
        *[F.sum(c).alias(c) for c in [*CITY_SUMS, *bins, "row_count"]],
        F.max_by("newest", F.col("newest.ts")).alias("newest"),
    )
    total = per_city.groupBy("period").agg(
        *[F.sum(c).alias(c) for c in CITY_SUMS],
        F.array(*[F.sum(f"v{i}") for i in range(9)]).alias("voice"),
        F.array(*[F.sum(f"s{i}") for i in range(9)]).alias("sms"),
        F.sum("row_count").alias("row_count"),
        F.sum("newest.sms_queue").alias("queue"),
        F.max("newest.sms_oldest_seconds").alias("oldest"),
        F.max("newest.ts").alias("snapshot_at"),
        (F.min("newest.ts") != F.max("newest.ts")).alias("misaligned"),
    ).join(slots, "period")
    c = F.col
    coverage = c("row_count") / F.lit(expected_rows)
    return total.select(
        "period",
        *CITY_SUMS,
        "row_count",
        "slot_count",
        percent(c("voice_success"), c("voice_attempts")).alias("voice_sr"),
        percent(c("voice_drops"), c("voice_success")).alias("drop_rate"),
        divide(c("voice_holding_seconds"), c("slot_count") * 300).alias("erlang"),
        divide(c("voice_setup_elapsed_seconds"), c("voice_success")).alias("setup_mean_seconds"),
        histogram_quantile(c("voice"), policies.VOICE_EDGES).alias("setup_p95_seconds"),
        (histogram_quantile(c("sms"), policies.SMS_EDGES) * 1000).alias("sms_p95_ms"),
        percent(c("sms_delivered"), c("sms_delivered") + c("sms_expired")).alias("sms_sr"),
        percent(c("data_success"), c("data_attempts")).alias("data_sr"),
        percent(c("dns_success"), c("dns_attempts")).alias("dns_sr"),
        percent(c("ho_success"), c("ho_attempts")).alias("ho_sr"),
        divide(c("user_throughput_mbps"), c("row_count")).alias("throughput_mbps"),
        F.when(~c("misaligned"), c("queue")).alias("queue"),
        F.when(~c("misaligned"), c("oldest")).alias("oldest"),
        F.when(~c("misaligned"), c("snapshot_at")).alias("snapshot_at"),
        coverage.alias("coverage"),
        F.when(c("misaligned") | (coverage < 1), "PARTIAL").otherwise("VALID").alias("quality"),
        F.when(c("misaligned"), "SNAPSHOT_MISALIGNED").when(coverage < 1, "PARTIAL_COVERAGE").alias("null_reason"),
    )


def link_snapshot(
    probes: DataFrame, found: Column, at: Column, data_from: Column, data_to: Column, max_age: int
) -> DataFrame:
    """State of each probed (link, instant) from the newest row at that instant."""
    age = seconds_between(found["ts"], at)
    outside = (at < data_from) | (at >= data_to)
    present = ~outside & found.isNotNull()
    stale = age > max_age
    capacity = found["effective_capacity_gbps"]
    quality = (
        F.when(outside, "MISSING").when(found.isNull(), "MISSING").when(stale, "STALE")
        .when(capacity.isNull(), "INSUFFICIENT_DATA").otherwise("VALID")
    )
    reason = (
        F.when(outside, "OUTSIDE_DATASET").when(found.isNull(), "NO_OBSERVATIONS").when(stale, "STALE_SOURCE")
        .when(capacity.isNull(), "MISSING_CAPACITY")
    )
    return probes.select(
        "*",
        F.when(present, found["traffic_gbps"]).alias("traffic_gbps"),
        F.when(present, capacity).alias("effective_capacity_gbps"),
        F.when(present, found["ts"]).alias("snapshot_at"),
        F.when(present, age).alias("age_seconds"),
        F.when(quality == "VALID", percent(found["traffic_gbps"], capacity)).alias("utilization_pct"),
        quality.alias("quality"),
        reason.alias("null_reason"),
    )


# The roaming procedures.
PROCEDURES = ["reg", "data", "voice", "sms"]


def roaming_summary(rows: DataFrame, end: Column, city_share: float, max_age: int) -> DataFrame:
    """Per country over both directions: procedure rates and the city's share of the newest users.

    The share is rounded half up per partner before it is summed.
    """
    counters = [f"{p}_{k}" for p in PROCEDURES for k in ("attempts", "success")]
    partners = rows.groupBy("country_id", "partner_id", "direction").agg(
        *[F.sum(c).alias(c) for c in counters],
        F.max_by(F.struct("ts", "active_users"), "ts").alias("newest"),
    )
    users = F.col("newest.active_users")
    total = partners.groupBy("country_id").agg(
        *[F.sum(c).alias(c) for c in counters],
        F.sum(users).alias("users"),
        F.sum(half_up(users * F.lit(city_share))).alias("allocated"),
        F.bool_or(seconds_between(F.col("newest.ts"), end) > max_age).alias("stale"),
        (F.min("newest.ts") != F.max("newest.ts")).alias("misaligned"),
        F.max("newest.ts").alias("newest_at"),
    )
    stale, apart = F.col("stale"), F.col("misaligned") & ~F.col("stale")
    return total.select(
        "country_id",
        F.when(~apart, F.col("users")).alias("users"),
        F.when(~stale & ~apart, F.col("allocated")).alias("allocated_users"),
        *[percent(F.col(f"{p}_success"), F.col(f"{p}_attempts")).alias(f"{p}_sr") for p in PROCEDURES],
        F.when(stale, "STALE").when(apart, "PARTIAL").otherwise("VALID").alias("quality"),
        F.when(stale, "STALE_SOURCE").when(apart, "SNAPSHOT_MISALIGNED").alias("null_reason"),
        F.when(stale | apart, 0.0).otherwise(1.0).alias("coverage"),
        F.when(~apart, F.col("newest_at")).alias("snapshot_at"),
    )


def utilization(segments: DataFrame, keys: list[str], expected_seconds: int) -> DataFrame:
    """Mean and peak utilization over valid seconds only."""
    use = percent(F.col("traffic_gbps"), F.col("effective_capacity_gbps"))
    valid = (F.col("quality") == "VALID") & F.col("effective_capacity_gbps").isNotNull()
    seconds = F.col("valid_seconds")
    sums = segments.groupBy(*keys).agg(
        F.sum(F.when(valid, seconds)).alias("valid_seconds"),
        F.sum(F.when(valid, F.col("traffic_gbps") * seconds)).alias("traffic_time"),
        F.sum(F.when(valid, use * seconds)).alias("utilization_time"),
        F.max(F.when(valid, use)).alias("peak_pct"),
        F.bool_or(F.col("quality") == "STALE").alias("any_stale"),
    )
    some = F.col("valid_seconds") > 0
    coverage = F.coalesce(F.col("valid_seconds"), F.lit(0)) / F.lit(expected_seconds)
    none = F.when(F.col("any_stale"), "STALE").otherwise("INSUFFICIENT_DATA")
    return sums.select(
        *keys,
        F.coalesce("valid_seconds", F.lit(0)).alias("valid_seconds"),
        F.when(some, divide(F.col("utilization_time"), F.col("valid_seconds"))).alias("mean_pct"),
        "peak_pct",
        F.when(some, divide(F.col("traffic_time"), F.col("valid_seconds"))).alias("traffic_mean_gbps"),
        F.when(some, F.col("traffic_time")).cast("double").alias("transferred_gb"),
        coverage.alias("coverage"),
        F.when(~F.coalesce(some, F.lit(False)), none).when(coverage < 1, "PARTIAL").otherwise("VALID").alias("quality"),
        F.when(
            ~F.coalesce(some, F.lit(False)),
            F.when(F.col("any_stale"), "STALE_SOURCE").otherwise("MISSING_CAPACITY"),
        )
        .when(coverage < 1, "PARTIAL_COVERAGE")
        .alias("null_reason"),
    )


def queue_balance(rows: DataFrame) -> DataFrame:
    """Queue movement per row; a row whose closing queue does not balance is invalid, not corrected."""
    c = F.col
    ok = c("closing") == c("opening") + c("submitted") - c("delivered") - c("negative")
    finalized = c("delivered") + c("negative")
    growth = c("closing") - c("opening")
    return rows.select(
        "*",
        ok.alias("balanced"),
        F.when(ok, growth).alias("growth"),
        F.when(ok, divide(growth, c("duration_seconds"))).alias("growth_per_second"),
        F.when(ok, percent(c("delivered"), finalized)).alias("finalized_success_pct"),
        F.when(~ok, "INVALID_INPUT").when(finalized == 0, "INSUFFICIENT_DATA").otherwise("VALID").alias("quality"),
    )
