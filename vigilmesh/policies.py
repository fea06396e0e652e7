"""Policy values. Every number and code below is fixed: results depend on it."""

from __future__ import annotations

from decimal import Decimal

# Time grid and lateness.
MINUTE_SECONDS = 60
SLOT_SECONDS = 300
ALLOWED_LATENESS_SECONDS = 10
STALE_AFTER_SECONDS = 90
SNAPSHOT_MAX_AGE_SECONDS = 600
RESOLUTIONS = {"5m": 300, "15m": 900, "1h": 3600, "6h": 21600}
MAX_POINTS = 8641
MAX_RANGE_DAYS = 30
MAX_SAFE_COUNTER = 9_007_199_254_740_991

# Episode hysteresis.
OPEN_AFTER_BREACHED = 2
RECOVER_AFTER_HEALTHY = 3

#: How long a machine knows the content of the windows it has taken.
FINGERPRINTS_REMEMBERED_SECONDS = 7 * 86400

# Voice setup rule.
VOICE = {
    "min_attempts": 100,
    "drop_pp": Decimal("1.0"),
    "recovery_drop_pp": Decimal("0.5"),
    "high_extra": 50,
    "critical_extra": 200,
    "ims_cpu_pct": 90,
    "access_drop_pp": Decimal("0.5"),
    "parity": Decimal("0.000000001"),
}

# SMS delivery rule.
SMS = {
    "min_delivered": 30,
    "p95_ms": 20000,
    "baseline_multiplier": 3,
    "queue_depth": 100,
    "oldest_seconds": 60,
    "recovery_p95_ms": 10000,
    "recovery_multiplier": 2,
    "recovery_oldest_seconds": 30,
    "high_affected": 100,
    "critical_depth": 1000,
    "critical_oldest_seconds": 300,
}

# Five-minute domain rules.
DOMAIN_POLICY_VERSION = "domain-rules-v1"
DOMAIN_BASELINE_VERSION = "seasonal-v1"
DOMAIN_MIN_COVERAGE = 1
DOMAIN_MAX_AGE_SECONDS = 600
OVERLOAD_CANDIDATE_PCT = 85
LOSS = {"min_samples": 1000, "trigger": 2, "recovery": 1, "critical": 4}
RTT = {"min_samples": 30, "trigger": 100, "recovery": 80, "critical": 200}
RATE_DROP = {"min_attempts": 100, "trigger": Decimal("1"), "recovery": Decimal("0.5"), "critical": Decimal("2")}

# Minute policy for live domain windows.
LIVE = {
    "min_attempts": 100,
    "max_age_seconds": 120,
    "center_pct": 99,
    "trigger_pp": 5,
    "recovery_pp": 1,
    "critical_pp": 20,
    "utilization_pct": 85,
}

# Support thresholds of the cause policy (metric, comparison, value, minimum samples).
CAUSE_SUPPORT = [
    ("transport.packetLoss", "GT", 2, 1000),
    ("transport.rtt.mean", "GT", 100, 30),
    ("roaming.partnerRtt", "GT", 100, 30),
    ("roaming.registration.success", "DROP_PP_GT", 1, 100),
    ("roaming.data.success", "DROP_PP_GT", 1, 100),
    ("mobileData.activation.success", "DROP_PP_GT", 1, 100),
    ("mobileData.dns.success", "DROP_PP_GT", 1, 100),
    ("roaming.voice.success", "DROP_PP_GT", 1, 100),
]

# Seasonal baseline.
BASELINE = {
    "timezone": "Europe/Chisinau",
    "slot_minutes": 5,
    "min_days": 3,
    "min_coverage": 0.9,
    "min_attempts": 100,
    "static_center": 99.0,
}
STATIC_CENTER_METRICS = [
    "roaming.registration.success",
    "roaming.data.success",
    "roaming.voice.success",
    "mobileData.activation.success",
    "mobileData.dns.success",
]

# Histogram upper edges in seconds.
VOICE_EDGES = [0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 15.0, 30.0, 60.0]
SMS_EDGES = [1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 320.0]

# Order of the six model features per service.
FEATURE_ORDER = {
    "VOLTE": ["cssrDeltaPp", "sip503Ratio", "rrcDeltaPp", "bearerDeltaPp", "packetLossRatio", "imsCpuPct"],
    "SMS": [
        "p95DelayRatio",
        "p95DeliveryMs",
        "queueDepth",
        "oldestPendingAgeSec",
        "deliverySrDeltaPp",
        "deliveredMessages",
    ],
}
FEATURE_BOUND = 1e9

# Dead-letter bounds.
DEAD_LETTER_RAW_BYTES = 65536
DEAD_LETTER_ID_CHARS = 1024
DEAD_LETTER_DETAIL_CHARS = 2048

# Quality order, best first.
QUALITY_RANK = {"VALID": 0, "PARTIAL": 1, "INSUFFICIENT_EVIDENCE": 2, "STALE": 3, "MISSING": 4}

# Evidence codes that never support a cause.
NON_CAUSAL_CODES = ["PING_RESULT", "PROBE_WORKER_HEALTH"]

# Name fragments that mark evaluation truth, and the two names that are allowed.
TRUTH_FRAGMENTS = ["truth", "expected", "future", "scenario", "outcome"]
TRUTH_ALLOWED = ["expectedSeconds", "expectedRows"]
