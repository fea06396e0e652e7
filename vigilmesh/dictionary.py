"""The metric dictionary: what each metric measures and from which native fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Metric id, domain, unit, aggregation, availability, native fields.
METRICS = [
    ("volte.attempts", "VOLTE", "COUNT", "COUNT_SUM", "SUPPORTED", ["voice_attempts"]),
    ("volte.established", "VOLTE", "COUNT", "COUNT_SUM", "SUPPORTED", ["voice_success"]),
    ("volte.setup.success", "VOLTE", "PERCENT", "RATIO_OF_SUMS", "SUPPORTED", ["voice_success", "voice_attempts"]),
    ("volte.traffic.erlang", "VOLTE", "ERLANG", "WEIGHTED_MEAN", "APPROXIMATION", ["voice_holding_seconds"]),
    ("volte.setup.mean", "VOLTE", "SECONDS", "WEIGHTED_MEAN", "SUPPORTED",
     ["voice_setup_elapsed_seconds", "voice_success"]),
    ("volte.setup.p95", "VOLTE", "SECONDS", "HISTOGRAM_P95", "APPROXIMATION", ["voice_setup_hist"]),
    ("volte.abnormalReleases", "VOLTE", "COUNT", "COUNT_SUM", "SUPPORTED", ["voice_drops"]),
    ("volte.drop.rate", "VOLTE", "PERCENT", "RATIO_OF_SUMS", "SUPPORTED", ["voice_drops", "voice_success"]),
    ("volte.handover.success", "VOLTE", "PERCENT", "RATIO_OF_SUMS", "SUPPORTED", ["ho_success", "ho_attempts"]),
    ("transport.traffic", "TRANSPORT", "GBPS", "TIME_WEIGHTED_MEAN", "APPROXIMATION", ["traffic_gbps"]),
    ("transport.volume", "TRANSPORT", "BYTES", "COUNT_SUM", "APPROXIMATION", ["traffic_gbps"]),
    ("transport.effectiveCapacity", "TRANSPORT", "GBPS", "SNAPSHOT_LAST", "APPROXIMATION",
     ["effective_capacity_gbps"]),
    ("transport.link.utilization", "TRANSPORT", "PERCENT", "TIME_WEIGHTED_MEAN", "APPROXIMATION",
     ["traffic_gbps", "effective_capacity_gbps"]),
    ("transport.link.utilization.peak", "TRANSPORT", "PERCENT", "MAXIMUM", "APPROXIMATION",
     ["traffic_gbps", "effective_capacity_gbps"]),
    ("transport.packetLoss", "TRANSPORT", "PERCENT", "RATIO_OF_SUMS", "REQUIRES_ADDITIONAL_PRIMITIVES",
     ["loss_pct"]),
    ("transport.rtt.mean", "TRANSPORT", "MILLISECONDS", "WEIGHTED_MEAN", "REQUIRES_ADDITIONAL_PRIMITIVES",
     ["rtt_ms"]),
    ("transport.rtt.snapshot", "TRANSPORT", "MILLISECONDS", "SNAPSHOT_LAST", "APPROXIMATION", ["rtt_ms"]),
    ("transport.jitter", "TRANSPORT", "MILLISECONDS", "SNAPSHOT_LAST", "APPROXIMATION", ["jitter_ms"]),
    ("transport.interfaceErrors", "TRANSPORT", "COUNT", "COUNT_SUM", "APPROXIMATION", ["interface_errors"]),
    ("transport.queueDrops", "TRANSPORT", "COUNT", "COUNT_SUM", "APPROXIMATION", ["queue_drops"]),
    ("transport.link.state", "TRANSPORT", "STATE", "STATE_TIMELINE", "REQUIRES_ADDITIONAL_PRIMITIVES", []),
    ("roaming.activeOutbound", "ROAMING", "COUNT", "SNAPSHOT_LAST", "APPROXIMATION", ["active_users"]),
    ("roaming.activeInbound", "ROAMING", "COUNT", "SNAPSHOT_LAST", "APPROXIMATION", ["active_users"]),
    ("roaming.registration.success", "ROAMING", "PERCENT", "RATIO_OF_SUMS", "SUPPORTED",
     ["reg_success", "reg_attempts"]),
    ("roaming.data.success", "ROAMING", "PERCENT", "RATIO_OF_SUMS", "SUPPORTED", ["data_success", "data_attempts"]),
    ("roaming.voice.success", "ROAMING", "PERCENT", "RATIO_OF_SUMS", "SUPPORTED",
     ["voice_success", "voice_attempts"]),
    ("roaming.sms.finalizedSuccess", "ROAMING", "PERCENT", "RATIO_OF_SUMS", "REQUIRES_ADDITIONAL_PRIMITIVES",
     ["sms_success", "sms_attempts"]),
    ("roaming.partnerRtt", "ROAMING", "MILLISECONDS", "SNAPSHOT_LAST", "APPROXIMATION", ["rtt_ms"]),
    ("sms.submitted", "SMS", "COUNT", "COUNT_SUM", "SUPPORTED", ["sms_submitted"]),
    ("sms.delivered", "SMS", "COUNT", "COUNT_SUM", "SUPPORTED", ["sms_delivered"]),
    ("sms.terminalFailed", "SMS", "COUNT", "COUNT_SUM", "REQUIRES_ADDITIONAL_PRIMITIVES", ["sms_expired"]),
    ("sms.expired", "SMS", "COUNT", "COUNT_SUM", "REQUIRES_ADDITIONAL_PRIMITIVES", ["sms_expired"]),
    ("sms.finalizedSuccess", "SMS", "PERCENT", "RATIO_OF_SUMS", "APPROXIMATION", ["sms_delivered", "sms_expired"]),
    ("sms.queue", "SMS", "COUNT", "SNAPSHOT_LAST", "SUPPORTED", ["sms_queue"]),
    ("sms.oldestPending", "SMS", "SECONDS", "SNAPSHOT_LAST", "APPROXIMATION", ["sms_oldest_seconds"]),
    ("sms.delay.mean", "SMS", "MILLISECONDS", "WEIGHTED_MEAN", "REQUIRES_ADDITIONAL_PRIMITIVES",
     ["sms_delay_hist"]),
    ("sms.delay.p95", "SMS", "MILLISECONDS", "HISTOGRAM_P95", "APPROXIMATION", ["sms_delay_hist"]),
    ("sms.queueGrowth", "SMS", "COUNT", "SNAPSHOT_DIFFERENCE", "APPROXIMATION",
     ["sms_queue", "sms_submitted", "sms_delivered", "sms_expired"]),
    ("mobileData.activation.success", "MOBILE_DATA", "PERCENT", "RATIO_OF_SUMS", "APPROXIMATION",
     ["data_success", "data_attempts"]),
    ("mobileData.dns.success", "MOBILE_DATA", "PERCENT", "RATIO_OF_SUMS", "REQUIRES_ADDITIONAL_PRIMITIVES",
     ["dns_success", "dns_attempts"]),
    ("mobileData.throughput", "MOBILE_DATA", "MBPS", "WEIGHTED_MEAN", "APPROXIMATION", ["user_throughput_mbps"]),
]

# One Gb/s held for one five-minute slot, in bytes.
BYTES_PER_GBPS_SLOT = 37_500_000_000

# Primitive field names each aggregation type must carry.
PRIMITIVE_FIELDS = {
    "COUNT_SUM": ["count"],
    "RATIO_OF_SUMS": ["numerator", "denominator"],
    "WEIGHTED_MEAN": ["sum", "count"],
    "TIME_WEIGHTED_MEAN": ["weightedSum", "validSeconds"],
    "MAXIMUM": ["max"],
    "SNAPSHOT_LAST": ["value", "snapshotAt"],
    "SNAPSHOT_DIFFERENCE": ["start", "end"],
    "STATE_TIMELINE": ["state", "at"],
    "HISTOGRAM_P95": ["histogram"],
}

KPI_POLICY = "kpi-v1"
SMS_DELAY_POLICY = "sms-delay-ms-v1"


def kind_of(domain: str) -> str:
    """Which native table carries a domain's primitives."""
    return {"TRANSPORT": "LINK", "ROAMING": "ROAMING"}.get(domain, "CITY")


def policy_of(metric: str) -> str:
    return SMS_DELAY_POLICY if metric.startswith("sms.delay.") else KPI_POLICY


def definition(metric: str) -> dict:
    for name, domain, unit, aggregation, availability, fields in METRICS:
        if name == metric:
            return {
                "metric": name,
                "domain": domain,
                "unit": unit,
                "aggregation": aggregation,
                "availability": availability,
                "fields": fields,
                "kind": kind_of(domain),
                "policy": policy_of(name),
            }
    raise ValueError(f"unsupported metric {metric}")


def dictionary_df(spark: SparkSession) -> DataFrame:
    """The dictionary as a (41-row) dimension."""
    rows = [
        (m, d, u, a, v, f, PRIMITIVE_FIELDS[a], kind_of(d), policy_of(m)) for m, d, u, a, v, f in METRICS
    ]
    return spark.createDataFrame(
        rows,
        "metric_id string, domain string, unit string, aggregation_type string, availability string, "
        "fields array<string>, primitive_fields array<string>, kind string, policy_version string",
    )
