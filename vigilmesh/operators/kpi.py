"""Service KPIs and feature vectors of finalized windows; primitives and features of native slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.arithmetic import divide, nearest_rank, percent
from vigilmesh.functions.timebins import hour_of_week

FEATURE_VERSION = 2
BASELINE_FIELDS = ["b_cssr", "b_rrc", "b_bearer", "b_p95", "b_delivery"]


def with_baseline(windows: DataFrame, profile: DataFrame) -> DataFrame:
    """Windows with the hour-of-week profile of their scope (168 rows per scope)."""
    keyed = windows.withColumn("hour_of_week", hour_of_week(F.col("window_start")))
    return keyed.join(profile, ["scope_id", "hour_of_week"], "left")


def service_kpis(windows: DataFrame, ims: str, transport: str, smsc: str) -> DataFrame:
    """KPIs from the service receipt (only when COMPLETE) and from role nodes' evidence."""
    complete = F.col("quality") == "COMPLETE"

    def s(name: str) -> Column:
        return F.when(complete, F.col(f"s.{name}"))

    eligible = s("attempts") - s("user_outcomes")
    return windows.withColumns({
        "eligible_attempts": eligible,
        "technical_successes": s("technical_successes"),
        "cssr_pct": percent(s("technical_successes"), eligible),
        "sip503_count": s("sip503_count"),
        "sip503_ratio": divide(s("sip503_count"), eligible),
        "rrc_sr_pct": percent(s("rrc_successes"), s("rrc_attempts")),
        "bearer_sr_pct": percent(s("bearer_successes"), s("bearer_attempts")),
        "packet_loss_ratio": F.col(f"node_{transport}.packet_loss_ratio"),
        "ims_cpu_pct": F.col(f"node_{ims}.cpu_pct"),
        "p95_delivery_ms": nearest_rank(s("delivery_delay_ms")),
        "delivery_sr_pct": percent(s("delivery_successes"), s("delivery_attempts")),
        "delivered_messages": s("delivered_messages"),
        "queue_depth": F.col(f"node_{smsc}.queue_depth"),
        "oldest_pending_seconds": F.col(f"node_{smsc}.oldest_pending_seconds"),
        "service": F.col("s.service"),
    })


def feature_vector() -> Column:
    """Six features in fixed order; an empty array unless the window is complete and all are finite."""
    c = F.col
    voice = F.array(
        c("cssr_pct") - c("b_cssr"), c("sip503_ratio"), c("rrc_sr_pct") - c("b_rrc"), c("bearer_sr_pct") - c("b_bearer"),
        c("packet_loss_ratio"), c("ims_cpu_pct"),
    )
    ratio = F.when(c("b_p95") > 0, divide(c("p95_delivery_ms"), c("b_p95")))
    sms = F.array(*[x.cast("double") for x in (
        ratio, c("p95_delivery_ms"), c("queue_depth"), c("oldest_pending_seconds"), c("delivery_sr_pct") - c("b_delivery"),
        c("delivered_messages"),
    )])
    raw = F.when(c("service") == "VOLTE", voice).when(c("service") == "SMS", sms)
    finite = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= policies.FEATURE_BOUND))
    return F.when((c("quality") == "COMPLETE") & finite, raw).otherwise(F.array().cast("array<double>"))


def window_id(scope: Column, start: Column) -> Column:
    text = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.sha2(F.to_json(F.array(scope, text, F.lit(str(FEATURE_VERSION)))), 256)


def kpi_array() -> Column:
    """KPIs as (name, unit, observed, baseline, numerator, denominator) structs, by service."""
    def k(name: str, unit: str, observed: str, baseline: str | None = None, n: str | None = None, d: str | None = None):
        return F.struct(
            F.lit(name).alias("name"), F.lit(unit).alias("unit"), F.col(observed).cast("double").alias("observed"),
            (F.col(baseline) if baseline else F.lit(None)).cast("double").alias("baseline"),
            (F.col(n) if n else F.lit(None)).cast("bigint").alias("numerator"),
            (F.col(d) if d else F.lit(None)).cast("bigint").alias("denominator"),
        )

    voice = F.array(
        k("cssrPct", "PERCENT", "cssr_pct", "b_cssr", "technical_successes", "eligible_attempts"),
        k("eligibleAttempts", "COUNT", "eligible_attempts"),
        k("sip503Ratio", "RATIO", "sip503_ratio"),
        k("rrcSrPct", "PERCENT", "rrc_sr_pct", "b_rrc"),
        k("bearerSrPct", "PERCENT", "bearer_sr_pct", "b_bearer"),
        k("packetLossRatio", "RATIO", "packet_loss_ratio"),
        k("imsCpuPct", "PERCENT", "ims_cpu_pct"),
    )
    sms = F.array(
        k("p95DeliveryMs", "MILLISECONDS", "p95_delivery_ms", "b_p95"),
        k("deliverySrPct", "PERCENT", "delivery_sr_pct", "b_delivery"),
        k("deliveredMessages", "COUNT", "delivered_messages"),
        k("queueDepth", "COUNT", "queue_depth"),
        k("oldestPendingAgeSec", "SECONDS", "oldest_pending_seconds"),
    )
    return F.when(F.col("service") == "VOLTE", voice).otherwise(sms)


NATIVE = {
    # Metric → (primitive type, first field, second field) per native table.
    "LINK": [
        ("transport.traffic", "TIMED", "traffic_gbps", None),
        ("transport.link.utilization", "TIMED", "traffic_gbps", "effective_capacity_gbps"),
        ("transport.effectiveCapacity", "SNAPSHOT", "effective_capacity_gbps", None),
        ("transport.rtt.snapshot", "SNAPSHOT", "rtt_ms", None),
        ("transport.jitter", "SNAPSHOT", "jitter_ms", None),
    ],
    "ROAMING": [
        ("roaming.registration.success", "RATIO", "reg_success", "reg_attempts"),
        ("roaming.data.success", "RATIO", "data_success", "data_attempts"),
        ("roaming.voice.success", "RATIO", "voice_success", "voice_attempts"),
    ],
    "CITY": [
        ("mobileData.activation.success", "RATIO", "data_success", "data_attempts"),
        ("mobileData.dns.success", "RATIO", "dns_success", "dns_attempts"),
        ("mobileData.throughput", "SLOT_MEAN", "user_throughput_mbps", None),
    ],
}


def native_primitives(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """One row per native slot and metric: primitive pair, value and null reason."""
    entries = []
    for metric, how, first, second in NATIVE[kind]:
        a = F.col(first).cast("double")
        if how == "TIMED":
            level = percent(F.col(first), F.col(second)) if second else a
            pair = (level * policies.SLOT_SECONDS, F.lit(float(policies.SLOT_SECONDS)))
            value = divide(*pair)
        elif how == "RATIO":
            pair = (a, F.col(second).cast("double"))
            value = percent(*pair)
        elif how == "SLOT_MEAN":
            pair = (a, F.lit(1.0))
            value = a
        else:
            pair = (a, F.lit(None).cast("double"))
            value = a
        entries.append(F.struct(
            F.lit(metric).alias("metric_id"), F.lit(how).alias("primitive"), pair[0].alias("first"),
            pair[1].alias("second"), value.alias("value"),
            F.when(value.isNull(), "ZERO_DENOMINATOR").otherwise("NONE").alias("null_reason"),
        ))
    return rows.select(*keys, F.explode(F.array(*entries)).alias("p")).select(*keys, "p.*")


def domain_features(rows: DataFrame) -> DataFrame:
    """Model inputs of domain evidence: eight values, each with a presence flag.

    Columns: actual, numerator, denominator, sum_value, sample_count, center, coverage, age_seconds.
    """
    c = F.col
    residual = (c("actual") - c("center")) / F.greatest(F.abs(c("center")), F.lit(1.0))
    values = [
        c("actual"), c("numerator"), c("denominator"), c("sum_value"), c("sample_count"), residual, c("coverage"),
        c("age_seconds"),
    ]
    pairs = []
    for v in values:
        v = v.cast("double")
        pairs += [F.coalesce(v, F.lit(0.0)), F.when(v.isNotNull(), 1.0).otherwise(0.0)]
    return rows.withColumn("features", F.array(*pairs))
