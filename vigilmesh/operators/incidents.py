"""Incidents: fold of each episode's gap-free detection prefix, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["MEDIUM", "HIGH", "CRITICAL"]


def severity_rank(severity: Column) -> Column:
    expr = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        expr = F.when(severity == name, F.lit(i)).otherwise(expr)
    return expr


def _ordered(keys=("episode_id",)):
    return Window.partitionBy(*keys).orderBy("sequence")


def with_prefix(detections: DataFrame) -> DataFrame:
    """Flag ``applied``: all earlier sequence numbers of the episode are present.

    ``detections`` has one row per (episode, sequence); an episode is at most one row per window long.
    """
    return detections.withColumn("applied", F.row_number().over(_ordered()) == F.col("sequence"))


def fold(detections: DataFrame) -> DataFrame:
    """Current incident per episode from its contiguous prefix, and how many detections wait behind a gap.

    The severity of an UNKNOWN detection is historical and never replaces the incident's.
    """
    flagged = with_prefix(detections)
    applied = F.col("applied")
    known = applied & (F.col("phase") != "UNKNOWN")

    def newest(column: str, condition: Column) -> Column:
        return F.max_by(column, F.when(condition, F.col("sequence")))

    return flagged.groupBy("episode_id").agg(
        F.max(F.when(applied, F.col("sequence"))).alias("latest_sequence"),
        F.count_if(~applied).alias("pending"),
        F.min_by("scope_id", "sequence").alias("scope_id"),
        F.min_by("service", "sequence").alias("service"),
        F.min_by("first_observed_at", "sequence").alias("first_observed_at"),
        F.min_by("window_end", "sequence").alias("detected_at"),
        newest("window_end", applied).alias("last_observed_at"),
        newest("technical_state", applied).alias("technical_state"),
        newest("episode_severity", known).alias("severity"),
    ).where(F.col("latest_sequence").isNotNull())


def pending_ready(detections: DataFrame, incidents: DataFrame) -> DataFrame:
    """Episodes whose next detection has arrived: sequence latest + 1, or 1 where no incident exists."""
    latest = incidents.select("episode_id", "latest_sequence")
    return (
        detections.select("episode_id", "sequence", "detection_id")
        .join(latest, "episode_id", "left")
        .where(F.col("sequence") == F.coalesce("latest_sequence", F.lit(0)) + 1)
    )


def successor_violations(detections: DataFrame, context: list[str]) -> DataFrame:
    """First broken rule between each detection and the one before it in its episode."""
    order = _ordered()
    names = ["technical_state", "window_end", "episode_severity", *context]
    packed = detections.withColumn("prev", F.lag(F.struct(*names)).over(order))
    c, p = F.col, F.col("prev")
    changed = F.lit(False)
    for name in context:
        changed = changed | ~c(name).eqNullSafe(p[name])
    reason = (
        F.when(p["technical_state"] == "RECOVERED", "RECOVERED_CANNOT_REOPEN")
        .when(changed, "CONTEXT_CHANGED")
        .when(c("window_start") < p["window_end"], "WINDOWS_OVERLAP")
        .when((p["episode_severity"] == "CRITICAL") & (c("episode_severity") != "CRITICAL"), "SEVERITY_DECREASED")
    )
    return packed.where(p.isNotNull()).withColumn("violation", reason).where(F.col("violation").isNotNull()).drop("prev")


def audit_trail(detections: DataFrame) -> DataFrame:
    """Before and after state of every applied detection."""
    state = F.struct("technical_state", F.col("severity_after").alias("severity"), "sequence")
    applied = with_prefix(detections).where("applied")
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    after = F.last(F.when(F.col("phase") != "UNKNOWN", F.col("episode_severity")), ignorenulls=True).over(upto)
    staged = applied.withColumn("severity_after", after)
    return staged.withColumn("before", F.lag(state).over(_ordered())).withColumn("after", state)


def notifications(detections: DataFrame) -> DataFrame:
    """OPEN for the first detection, ESCALATED for an update that raised severity, RECOVERED on recovery."""
    trail = audit_trail(detections)
    before, after = F.col("before"), F.col("after")
    kind = (
        F.when(before.isNull() & (F.col("phase") == "OPEN"), "OPEN")
        .when(before.isNull(), None)
        .when(
            (F.col("phase") == "UPDATE") & (after["technical_state"] == "ONGOING")
            & (severity_rank(after["severity"]) > severity_rank(before["severity"])),
            "ESCALATED",
        )
        .when((F.col("phase") == "RECOVERY") & (before["technical_state"] != "RECOVERED"), "RECOVERED")
    )
    return trail.withColumn("kind", kind).where(F.col("kind").isNotNull())


def impact_state(phase: Column) -> Column:
    return F.when(phase == "UNKNOWN", "STALE").when(phase == "RECOVERY", "RECOVERED").otherwise("CURRENT")
