"""Detection rules. Thresholds compare cross products in decimal, never rounded rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.arithmetic import divide, exact
from vigilmesh.functions.timebins import seconds_between


def _d(value) -> Column:
    return F.lit(value).cast("decimal(12,4)")


def voice_rule(rows: DataFrame) -> DataFrame:
    """VoLTE set-up rule over eligible_attempts, technical_successes, b_cssr and quality."""
    p, c = policies.VOICE, F.col
    n, ok, base = c("eligible_attempts").cast("decimal(18,0)"), c("technical_successes").cast("decimal(18,0)"), \
        c("b_cssr").cast("decimal(9,4)")
    drop = base * n - ok * _d(100)
    status = (
        F.when(c("quality") != "COMPLETE", "INSUFFICIENT_DATA")
        .when(c("b_cssr").isNull(), "BASELINE_MISSING")
        .when(n.isNull() | ok.isNull() | (n < p["min_attempts"]), "INSUFFICIENT_DATA")
        .otherwise("EVALUATED")
    )
    judged = status == "EVALUATED"
    breached = judged & (drop > _d(p["drop_pp"]) * n)
    healthy = judged & (drop <= _d(p["recovery_drop_pp"]) * n)
    extra = F.greatest(drop / _d(100), F.lit(0).cast("decimal(12,4)"))
    severity = F.when(
        breached,
        F.when(drop >= _d(p["critical_extra"] * 100), "CRITICAL").when(drop >= _d(p["high_extra"] * 100), "HIGH")
        .otherwise("MEDIUM"),
    )
    return rows.withColumns({
        "rule_status": status, "breached": breached, "healthy_now": healthy, "rule_severity": severity,
        "drop_pp": F.when(judged, divide(drop, n)), "extra_failures": F.when(judged, extra.cast("double")),
    })


def ims_capacity_hypothesis(rows: DataFrame) -> Column:
    """A breach with hot IMS, SIP 503 present, and healthy radio and bearer access."""
    p, c = policies.VOICE, F.col

    def near(observed: str, baseline: str) -> Column:
        return c(baseline).cast("decimal(12,6)") - c(observed).cast("decimal(12,6)") <= _d(p["access_drop_pp"])

    return F.coalesce(
        c("breached") & (c("ims_cpu_pct") >= p["ims_cpu_pct"]) & (c("sip503_count") > 0) & near("rrc_sr_pct", "b_rrc")
        & near("bearer_sr_pct", "b_bearer"),
        F.lit(False),
    )


def sms_rule(rows: DataFrame) -> DataFrame:
    """SMS delay and backlog rule over delivered_messages, p95_delivery_ms, b_p95, queue_depth, oldest_pending_seconds."""
    p, c = policies.SMS, F.col
    base = c("b_p95").cast("decimal(18,4)")
    p95 = c("p95_delivery_ms").cast("decimal(18,4)")
    complete = c("quality") == "COMPLETE"
    false = F.lit(False)
    delay_ready = F.coalesce(complete & (c("delivered_messages") >= p["min_delivered"]) & p95.isNotNull() & (base > 0), false)
    queue_ready = c("queue_depth").isNotNull() & c("oldest_pending_seconds").isNotNull()
    delay = F.coalesce(delay_ready & (p95 > p["p95_ms"]) & (p95 > base * p["baseline_multiplier"]), false)
    backlog = F.coalesce(
        queue_ready & (c("queue_depth") >= p["queue_depth"]) & (c("oldest_pending_seconds") > p["oldest_seconds"]), false)
    status = F.when(
        ~delay_ready & ~queue_ready, F.when(c("b_p95").isNull(), "BASELINE_MISSING").otherwise("INSUFFICIENT_DATA")
    ).otherwise("EVALUATED")
    calm = F.coalesce(
        delay_ready & (p95 <= p["recovery_p95_ms"]) & (p95 <= base * p["recovery_multiplier"]), false
    ) | F.coalesce((c("queue_depth") == 0) & (c("delivered_messages") == 0), false)
    healthy = F.coalesce(
        complete & queue_ready & (c("oldest_pending_seconds") <= p["recovery_oldest_seconds"]) & calm, false)
    breached = delay | backlog
    severity = F.when(
        breached,
        F.when(
            F.coalesce(queue_ready & (c("queue_depth") >= p["critical_depth"])
                       & (c("oldest_pending_seconds") >= p["critical_oldest_seconds"]), false), "CRITICAL")
        .when(backlog | F.coalesce(delay & (c("delivered_messages") >= p["high_affected"]), false), "HIGH")
        .otherwise("MEDIUM"),
    )
    return rows.withColumns({
        "rule_status": status, "breached": breached, "healthy_now": healthy & ~breached, "rule_severity": severity,
        "delay_breach": delay, "backlog_breach": backlog,
        "affected_deliveries": F.when(delay, c("delivered_messages")).otherwise(0),
        "queued_messages": F.when(backlog, c("queue_depth")).otherwise(0),
    })


def service_verdict(quality: Column, status: Column, breached: Column, healthy: Column) -> Column:
    usable = (status == "EVALUATED") & ((quality == "COMPLETE") | breached)
    return (
        F.when(~usable, "UNKNOWN").when(breached, "BREACH").when(healthy, "HEALTHY").otherwise("GRAY")
    )


def evidence_eligible(prefix: str = "") -> Column:
    """Valid, fresh, fully covered and young enough."""
    c = lambda n: F.col(prefix + n)
    age = seconds_between(c("observed_at"), c("as_of"))
    return F.coalesce(
        (c("quality") == "VALID") & (c("freshness") == "FRESH") & c("actual").isNotNull()
        & (c("coverage") >= policies.DOMAIN_MIN_COVERAGE) & age.between(0, policies.DOMAIN_MAX_AGE_SECONDS),
        F.lit(False),
    )


def _outcome(eligible: Column, enough: Column, over: Column, under: Column, critical: Column,
             missing: Column | None = None, missing_reason: str = "BASELINE_UNAVAILABLE") -> dict[str, Column]:
    judged = eligible & enough if missing is None else eligible & enough & ~missing
    verdict = (
        F.when(~judged, "UNKNOWN").when(over, "BREACH").when(under, "HEALTHY").otherwise("GRAY")
    )
    reason = (
        F.when(~eligible, "INSUFFICIENT_EVIDENCE").when(~enough, "LOW_VOLUME")
        .when(missing if missing is not None else F.lit(False), missing_reason)
        .when(over, "TRIGGER_EXCEEDED").when(under, "RECOVERY_BOUNDARY").otherwise("HYSTERESIS")
    )
    severity = F.when(judged & over, F.when(critical, "CRITICAL").otherwise("HIGH"))
    return {"verdict": verdict, "reason": reason, "severity": severity}


def absolute_rule(eligible: Column, total: Column, count: Column, policy: dict, scale: int = 1) -> dict[str, Column]:
    """Loss (scale 100) or RTT against absolute limits."""
    t, n = exact(total) * scale, exact(count)
    return _outcome(
        eligible, F.coalesce(count >= policy["min_samples"], F.lit(False)), t > n * policy["trigger"],
        t <= n * policy["recovery"], t > n * policy["critical"],
    )


def overload_candidate(eligible: Column, utilization: Column, capacity: Column) -> Column:
    """Full links are candidates only: load without impairment is no incident."""
    return F.coalesce(eligible & (capacity > 0) & (utilization >= policies.OVERLOAD_CANDIDATE_PCT), F.lit(False))


def rate_drop_rule(eligible: Column, numerator: Column, denominator: Column, center: Column,
                   baseline_version: Column) -> dict[str, Column]:
    """Success rate against its baseline, in percentage points of the population."""
    p = policies.RATE_DROP
    n, d = exact(numerator), exact(denominator)
    drop = center.cast("decimal(12,6)") * d - n * 100
    out = _outcome(
        eligible, F.coalesce(denominator >= p["min_attempts"], F.lit(False)), drop > _d(p["trigger"]) * d,
        drop <= _d(p["recovery"]) * d, drop > _d(p["critical"]) * d, center.isNull(),
    )
    other = F.coalesce(
        eligible & (denominator >= p["min_attempts"]) & center.isNotNull()
        & ~baseline_version.eqNullSafe(F.lit(policies.DOMAIN_BASELINE_VERSION)), F.lit(False))
    return {
        "verdict": F.when(other, "UNKNOWN").otherwise(out["verdict"]),
        "reason": F.when(other, "BASELINE_VERSION_MISMATCH").otherwise(out["reason"]),
        "severity": F.when(~other, out["severity"]),
    }


def minute_rate_rule(valid: Column, age_seconds: Column, numerator: Column, denominator: Column,
                     baseline_available: Column) -> dict[str, Column]:
    """Minute policy: success rate against the fixed center, trigger and recovery inclusive."""
    p = policies.LIVE
    n, d = exact(numerator), exact(denominator)
    drop = d * p["center_pct"] - n * 100
    fresh = age_seconds <= p["max_age_seconds"]
    enough = F.coalesce(denominator >= p["min_attempts"], F.lit(False))
    over, under = drop >= d * p["trigger_pp"], drop <= d * p["recovery_pp"]
    judged = valid & fresh & enough & baseline_available
    verdict = F.when(~judged, "UNKNOWN").when(over, "BREACH").when(under, "HEALTHY").otherwise("GRAY")
    reason = (
        F.when(~fresh, "STALE_SOURCE").when(~valid, "INSUFFICIENT_EVIDENCE").when(~enough, "MINIMUM_VOLUME")
        .when(~baseline_available, "BASELINE_UNAVAILABLE").when(over, "STATIC_RATE_DROP")
        .when(under, "OBSERVED_HEALTHY_POPULATION").otherwise("HYSTERESIS_BAND")
    )
    severity = F.when(judged & over, F.when(drop >= d * p["critical_pp"], "CRITICAL").otherwise("HIGH"))
    return {"verdict": verdict, "reason": reason, "severity": severity}


def minute_utilization_rule(valid: Column, age_seconds: Column, complete: Column, utilization: Column) -> dict[str, Column]:
    p = policies.LIVE
    fresh = age_seconds <= p["max_age_seconds"]
    over = utilization >= p["utilization_pct"]
    judged = valid & fresh & complete
    return {
        "verdict": F.when(~judged, "UNKNOWN").when(over, "CANDIDATE").otherwise("HEALTHY"),
        "reason": F.when(~fresh, "STALE_SOURCE").when(~valid, "INSUFFICIENT_EVIDENCE")
        .when(~complete, "TRANSPORT_EVIDENCE_INCOMPLETE").when(over, "UTILIZATION_ONLY")
        .otherwise("BELOW_OVERLOAD_CANDIDATE"),
    }


def overload_with_service(capacity_known: Column, overloaded: Column, service_verdict: Column, conflicting: Column,
                          mappings: Column, cause_supported: Column) -> dict[str, Column]:
    """Service-supported overload: the service verdict counts only through exactly one eligible mapping."""
    mapped = capacity_known & ~conflicting & (service_verdict != "UNKNOWN") & (mappings == 1)
    breach = service_verdict == "BREACH"
    verdict = (
        F.when(~mapped, "UNKNOWN")
        .when(breach & ~overloaded, "GRAY")
        .when(breach & ~cause_supported, "UNKNOWN")
        .otherwise(service_verdict)
    )
    reason = (
        F.when(~mapped, "MAPPED_SERVICE_EVIDENCE_UNAVAILABLE")
        .when(breach & ~overloaded, "OVERLOAD_NOT_PRESENT")
        .when(breach & ~cause_supported, "UNSUPPORTED_MAPPED_SERVICE")
        .otherwise(F.concat(F.lit("MAPPED_SERVICE_"), service_verdict))
    )
    return {"verdict": verdict, "reason": reason}


def baseline_deviation(actual: Column, center: Column, status: Column) -> Column:
    return F.when(center.isNotNull() & (status != "BASELINE_UNAVAILABLE"), actual - center)
