"""Minute windows: finalization, absent windows, freshness and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.timebins import seconds_between, shift

KEY = ["scope_id", "window_start", "window_end"]


def approve_nodes(receipts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Receipts with ``approved``: the node and source are a configured dependency of the scope."""
    pairs = catalogue.where("role = 'NODE'").select("scope_id", "node_id", "source_id", F.lit(True).alias("approved"))
    return receipts.join(pairs, ["scope_id", "node_id", "source_id"], "left").withColumn(
        "approved", F.coalesce("approved", F.lit(False))
    )


def finalize(approved: DataFrame, nodes: list[str], service_fields: list[str], node_fields: list[str]) -> DataFrame:
    """One row per (scope, minute): its service receipt and its approved, complete node evidence.

    Works as batch or, after a watermark on ``window_end``, as a streaming aggregate in append mode.
    Without a service receipt the quality is MISSING and node evidence is kept.
    """
    service = F.col("kind") == "SERVICE"
    usable = F.col("approved") & (F.col("kind") == "NODE") & (F.col("quality") == "COMPLETE")
    aggregates = [
        F.min_by(F.struct("event_id", "service", "quality", *service_fields), F.when(service, F.col("event_id"))).alias("s"),
        F.count("*").alias("accepted"),
    ]
    for node in nodes:
        here = usable & (F.col("node_id") == node)
        aggregates.append(
            F.min_by(F.struct("event_id", *node_fields), F.when(here, F.col("event_id"))).alias(f"node_{node}")
        )
    grouped = approved.groupBy(*KEY).agg(*aggregates)
    return grouped.withColumn("quality", F.coalesce("s.quality", F.lit("MISSING")))


def node_evidence(receipts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Why each candidate is (not) node evidence for the window it was offered to (``for_*`` columns)."""
    c = F.col
    measured = c("cpu_pct").isNotNull() | c("packet_loss_ratio").isNotNull() | c("queue_depth").isNotNull()
    verdict = (
        F.when(c("kind") != "NODE", "NOT_NODE")
        .when(c("for_scope") != c("scope_id"), "WRONG_SCOPE")
        .when(c("for_window") != c("window_start"), "WRONG_INTERVAL")
        .when(~c("approved"), "UNAPPROVED_DEPENDENCY")
        .when(c("quality") != "COMPLETE", "QUALITY_INELIGIBLE")
        .when(~measured, "MEASUREMENT_MISSING")
        .otherwise("ACCEPTED")
    )
    return approve_nodes(receipts, catalogue).withColumn("verdict", verdict)


def expected_gaps(buckets: DataFrame, due: Column, seconds: int = policies.MINUTE_SECONDS) -> DataFrame:
    """Absent windows after known ones, up to ``due``: inner holes and the tail of each scope.

    ``buckets`` has one row per known (scope, window), so the ordered window is calendar-bound.
    """
    order = Window.partitionBy("scope_id").orderBy("window_start")
    following = F.lead("window_start").over(order)
    last_start = F.least(
        F.coalesce(shift(following, -seconds), shift(due, -seconds)), shift(due, -seconds)
    )
    holes = buckets.select("scope_id", F.col("window_end").alias("gap_start"), last_start.alias("gap_last")).where(
        F.col("gap_start") <= F.col("gap_last")
    )
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    return holes.select("scope_id", F.explode(F.sequence("gap_start", "gap_last", step)).alias("window_start"))


def ledger(ranges: DataFrame, known: DataFrame, seconds: int) -> DataFrame:
    """Expected windows inside declared monitored ranges that are not known yet."""
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    expected = ranges.where(F.col("monitored_from") < F.col("monitored_through")).select(
        "scope_id",
        F.explode(F.sequence("monitored_from", shift(F.col("monitored_through"), -seconds), step)).alias("window_start"),
    )
    return expected.distinct().join(known.select("scope_id", "window_start"), ["scope_id", "window_start"], "left_anti")


def silent_windows(known: DataFrame, ranges: DataFrame, due: Column, seconds: int = policies.MINUTE_SECONDS) -> DataFrame:
    """MISSING windows: expected, due and not known. ``known`` has one row per reported (scope, window).

    Expected are the windows inside a scope's monitored ranges and, for a scope without any, all after its first
    known one.
    """
    declared = ledger(ranges, known, seconds).where(shift(F.col("window_start"), seconds) <= due)
    others = known.join(ranges.where(F.col("monitored_from") < F.col("monitored_through")).select("scope_id").distinct(), "scope_id", "left_anti")
    silent = declared.unionByName(expected_gaps(others, due, seconds))
    return silent.select("scope_id", "window_start", shift(F.col("window_start"), seconds).alias("window_end"), F.lit("MISSING").alias("quality"))


def service_evidence(receipts: DataFrame, catalogue: DataFrame, lateness: str) -> DataFrame:
    """Each service receipt with the node receipts of its scope and minute and the verdict on each; NODE_MISSING where none came.

    Batch or stream. In a stream both sides carry a watermark, so a service without nodes is told when its minute is evicted. A
    (scope, minute) has one service and a configured handful of nodes.
    """
    services = receipts.where("kind = 'SERVICE'").select(
        "scope_id", "window_start", F.col("window_end").alias("service_end"), F.col("event_id").alias("service_event")
    ).withWatermark("service_end", lateness)
    offered = receipts.where("kind <> 'SERVICE'").withColumns({"for_scope": F.col("scope_id"), "for_window": F.col("window_start")})
    nodes = node_evidence(offered, catalogue).select(
        F.col("scope_id").alias("node_scope"), F.col("window_end").alias("node_end"), "node_id", "source_id", F.col("event_id").alias("node_event"), "verdict"
    ).withWatermark("node_end", lateness)
    joined = services.join(nodes, (F.col("scope_id") == F.col("node_scope")) & (F.col("service_end") == F.col("node_end")), "leftOuter")
    return joined.select(
        "scope_id", "window_start", "service_event", "node_id", "source_id", "node_event", F.coalesce("verdict", F.lit("NODE_MISSING")).alias("verdict"))


def bucket_counts(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy(*KEY).agg(F.count("*").alias("accepted_input_count"))


def source_state(receipts: DataFrame) -> DataFrame:
    """Newest activity per (scope, source): window position first, then emission, then id."""
    position = F.struct("window_start", "emitted_at", "event_id")
    return receipts.groupBy("scope_id", "source_id").agg(
        F.max(position).alias("p"), F.max("emitted_at").alias("latest_emitted_at")
    ).select(
        "scope_id", "source_id", F.col("p.window_start").alias("latest_window_start"), "latest_emitted_at",
        F.col("p.event_id").alias("last_event_id"),
    )


def activity_freshness(expected: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    age = seconds_between(F.col("latest_emitted_at"), now)
    freshness = (
        F.when(F.col("latest_emitted_at").isNull(), "NEVER_SEEN")
        .when((age < 0) | (age > policies.STALE_AFTER_SECONDS), "STALE")
        .otherwise("FRESH")
    )
    return expected.join(state, ["scope_id", "source_id"], "left").withColumn("freshness", freshness)


def interval_coverage(grid: DataFrame, receipts: DataFrame, now: Column) -> DataFrame:
    """Coverage of each expected (scope, source, window): what was reported, pending or missing."""
    reported = (
        receipts.where(F.col("kind").isin("SERVICE", "NODE"))
        .groupBy("scope_id", "source_id", "window_start")
        .agg(F.min_by("quality", "event_id").alias("quality"))
    )
    deadline = shift(F.col("window_start"), policies.MINUTE_SECONDS + policies.ALLOWED_LATENESS_SECONDS)
    coverage = (
        F.when(F.col("quality") == "MISSING", "REPORTED_MISSING")
        .when(F.col("quality").isNotNull(), F.col("quality"))
        .when(now >= deadline, "MISSING")
        .otherwise("PENDING")
    )
    return grid.join(reported, ["scope_id", "source_id", "window_start"], "left").withColumn("coverage", coverage)


def coverage_snapshot(receipts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Expected, received and usable source sets per window, with the issue of each unusable source.

    Sets hold configured sources only (a handful per scope); receipts of a source collapse to one
    quality before any set is built.
    """
    expected = catalogue.groupBy("scope_id").agg(F.array_sort(F.collect_set("source_id")).alias("expected"))
    per_source = (
        receipts.where(F.col("kind") != "HEARTBEAT")
        .groupBy("scope_id", "window_start", "source_id")
        .agg(F.min_by("quality", "event_id").alias("quality"))
        .join(catalogue.select("scope_id", "source_id"), ["scope_id", "source_id"], "left_semi")
    )
    issue = F.when(F.col("quality") == "MISSING", "REPORTED_MISSING").when(F.col("quality") == "INCOMPLETE", "INCOMPLETE")
    sets = per_source.groupBy("scope_id", "window_start").agg(
        F.array_sort(F.collect_list("source_id")).alias("received"),
        F.array_sort(F.collect_list(F.when(issue.isNull(), F.col("source_id")))).alias("usable"),
        F.collect_list(F.when(issue.isNotNull(), F.struct("source_id", issue.alias("reason")))).alias("reported"),
    )
    joined = sets.join(expected, "scope_id", "left")
    absent = F.transform(
        F.array_except("expected", "received"),
        lambda s: F.struct(s.alias("source_id"), F.lit("NOT_RECEIVED").alias("reason")),
    )
    return joined.withColumn("issues", F.array_sort(F.concat("reported", absent))).drop("reported")


def coverage_state(expected: Column, usable: Column, stale: Column) -> Column:
    return (
        F.when(expected.isNull(), "UNKNOWN")
        .when(stale, "STALE")
        .when(F.size(usable) == 0, "MISSING")
        .when(F.size(usable) == F.size(expected), "COMPLETE")
        .otherwise("PARTIAL")
    )


# Upper bounds of the finalizer delay buckets, in seconds after the window's end.
DELAY_BUCKETS = [1, 2, 5, 10, 15, 20]


def delay_histogram(receipts: DataFrame) -> DataFrame:
    delay = seconds_between(F.col("window_end"), F.col("received_at"))
    bucket = F.lit("+Inf")
    for bound in reversed(DELAY_BUCKETS):
        bucket = F.when(delay <= bound, F.lit(str(bound))).otherwise(bucket)
    return receipts.groupBy(bucket.alias("le")).agg(F.count("*").alias("samples"))


def reevaluate(evidence: DataFrame, evaluated_at: Column, live: bool) -> DataFrame:
    """Freshness and quality at a chosen instant; a replay keeps its event-time judgement."""
    if not live:
        return evidence
    age = seconds_between(F.col("observed_at"), evaluated_at)
    fresh = age <= F.col("max_age_seconds")
    known = F.col("observed_at").isNotNull()
    return (
        evidence.withColumn("source_age_seconds", F.when(known, age).otherwise(F.col("source_age_seconds")))
        .withColumn("freshness", F.when(known, F.when(fresh, "FRESH").otherwise("STALE")).otherwise(F.col("freshness")))
        .withColumn("quality", F.when(known & ~fresh, "STALE").otherwise(F.col("quality")))
        .withColumn(
            "quality_reason",
            F.when(known & ~fresh, "SOURCE_EXPIRED_AT_LIVE_EVALUATION").otherwise(F.col("quality_reason")),
        )
    )
