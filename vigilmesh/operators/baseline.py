"""Seasonal baselines: fit, calendar coverage, and the lookup chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.arithmetic import percent
from vigilmesh.functions.timebins import hour_of_week, local_slot, shift
from vigilmesh.operators.intervals import interval_join
from vigilmesh.operators.rollup import ts_lit

KEY = ["metric_id", "scope_id"]


def rate_samples(rows: DataFrame, metric: str, scope: Column, numerator: str, denominator: str) -> DataFrame:
    """Training samples of a rate: aggregated populations per scope and slot, eligible from 100 attempts."""
    summed = rows.groupBy(scope.alias("scope_id"), F.col("ts").alias("from_ts")).agg(
        F.sum(numerator).alias("n"), F.sum(denominator).alias("d")
    )
    return summed.select(
        F.lit(metric).alias("metric_id"),
        "scope_id",
        "from_ts",
        shift(F.col("from_ts"), policies.SLOT_SECONDS).alias("to_ts"),
        percent(F.col("n"), F.col("d")).alias("value"),
        F.lit(1.0).alias("coverage"),
        (F.col("d") >= policies.BASELINE["min_attempts"]).alias("eligible"),
    )


def drop_excluded(samples: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Samples that overlap no declared exclusion."""
    return interval_join(
        samples, exclusions, [], F.col("from_ts"), F.col("to_ts"), "e_from", "e_to", "left_anti", contain=False,
        piece=policies.SLOT_SECONDS,
    )


def training_calendar(spark, exclusions: DataFrame, start: str, end: str) -> DataFrame:
    """Expected days per (slot, weekday class): the training grid minus excluded slots."""
    grid = spark.range(1).select(
        F.explode(
            F.sequence(ts_lit(start), shift(ts_lit(end), -policies.SLOT_SECONDS), F.expr("INTERVAL 5 MINUTES"))
        ).alias("from_ts")
    ).withColumn("to_ts", shift(F.col("from_ts"), policies.SLOT_SECONDS))
    kept = drop_excluded(grid, exclusions)
    local = local_slot(F.col("from_ts"))
    return (
        kept.select(*[c.alias(n) for n, c in local.items()])
        .distinct()
        .groupBy("slot", "weekday_class")
        .agg(F.count("*").alias("expected_days"))
    )


def middle(values: Column) -> Column:
    """Median of a sorted array: the mean of the two middle values when the count is even."""
    n = F.size(values)
    low = F.element_at(values, F.greatest(((n + 1) / 2).cast("int"), F.lit(1)))
    high = F.element_at(values, F.greatest((n / 2).cast("int") + 1, F.lit(1)))
    return low / 2 + high / 2


def fit(samples: DataFrame, exclusions: DataFrame, start: str, end: str) -> DataFrame:
    """Median of daily medians and MAD per key, local slot and weekday class.

    The first grouping holds the samples of one slot of one civil day (two at a repeated hour); the
    list in the second holds one number per training day.
    """
    p = policies.BASELINE
    spark = samples.sparkSession
    inside = samples.where((F.col("from_ts") >= ts_lit(start)) & (F.col("to_ts") <= ts_lit(end)))
    usable = drop_excluded(inside, exclusions).where(
        F.col("value").isNotNull() & F.col("eligible") & (F.col("coverage") >= p["min_coverage"])
    )
    local = local_slot(F.col("from_ts"))
    daily = (
        usable.select(*KEY, "value", *[c.alias(n) for n, c in local.items()])
        .groupBy(*KEY, "slot", "weekday_class", "local_date")
        .agg(F.median("value").alias("day_value"), F.count("*").alias("n"))
    )
    cells = daily.groupBy(*KEY, "slot", "weekday_class").agg(
        F.array_sort(F.collect_list("day_value")).alias("days"), F.sum("n").alias("sample_count")
    )
    center = middle(F.col("days"))
    spread = F.array_sort(F.transform("days", lambda v: F.abs(v - F.col("center"))))
    calendar = training_calendar(spark, exclusions, start, end)
    coverage = F.size("days") / F.col("expected_days")
    return (
        cells.withColumn("center", center)
        .withColumn("mad", middle(spread))
        .join(F.broadcast(calendar), ["slot", "weekday_class"])
        .withColumn("distinct_days", F.size("days").cast("bigint"))
        .withColumn("coverage", coverage)
        .where((F.col("distinct_days") >= p["min_days"]) & (F.col("coverage") >= p["min_coverage"]))
        .drop("days")
    )


def sample_accounting(samples: DataFrame, exclusions: DataFrame, start: str, end: str) -> DataFrame:
    """Expected, accepted, excluded, missing and invalid sample counts per metric."""
    p = policies.BASELINE
    overlap = interval_join(
        samples.where((F.col("from_ts") >= ts_lit(start)) & (F.col("to_ts") <= ts_lit(end))).withColumn(
            "_one", F.lit(1)),
        exclusions, [], F.col("from_ts"), F.col("to_ts"), "e_from", "e_to", "left", contain=False,
        piece=policies.SLOT_SECONDS,
    )
    # Overlapping exclusions may match a sample twice, so the match collapses to one row per sample.
    flagged = overlap.groupBy(*KEY, "from_ts").agg(
        F.first("value").alias("value"), F.first("eligible").alias("eligible"),
        F.first("coverage").alias("coverage"), F.bool_or(F.col("e_from").isNotNull()).alias("excluded"),
    )
    good = F.col("eligible") & (F.col("coverage") >= p["min_coverage"])
    kept = ~F.col("excluded")
    return flagged.groupBy("metric_id").agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("excluded")).alias("excluded_count"),
        F.count_if(kept & F.col("value").isNull()).alias("missing_count"),
        F.count_if(kept & F.col("value").isNotNull() & ~good).alias("invalid_count"),
        F.count_if(kept & F.col("value").isNotNull() & good).alias("accepted_count"),
    )


def lookup_chain(windows: DataFrame, cells: DataFrame, peers: DataFrame, static: DataFrame) -> DataFrame:
    """Baseline of each window: its own cell, else its peer's cell, else a static center, else none.

    ``cells`` has at most keys × 576 rows and ``peers``/``static`` are policy lists, so the joins are
    left for the optimizer to broadcast by size.
    """
    local = local_slot(F.col("window_start"))
    probe = windows.withColumn("slot", local["slot"]).withColumn("weekday_class", local["weekday_class"])
    own = cells.select(*KEY, "slot", "weekday_class", F.col("center").alias("own_center"), F.col("mad").alias("own_mad"))
    other = cells.select(
        "metric_id", F.col("scope_id").alias("peer_id"), "slot", "weekday_class",
        F.col("center").alias("peer_center"), F.col("mad").alias("peer_mad"),
    )
    joined = (
        probe.join(own, [*KEY, "slot", "weekday_class"], "left")
        .join(peers, ["scope_id"], "left")
        .join(other, ["metric_id", "peer_id", "slot", "weekday_class"], "left")
        .join(static, ["metric_id"], "left")
    )
    status = (
        F.when(F.col("own_center").isNotNull(), "DIRECT")
        .when(F.col("peer_center").isNotNull(), "PEER")
        .when(F.col("static_center").isNotNull(), "STATIC")
        .otherwise("BASELINE_UNAVAILABLE")
    )
    return joined.select(
        *windows.columns,
        status.alias("baseline_status"),
        F.coalesce("own_center", "peer_center", "static_center").alias("center"),
        F.when(status == "DIRECT", F.col("own_mad")).when(status == "PEER", F.col("peer_mad"))
        .when(status == "STATIC", F.lit(0.0)).alias("mad"),
    )


def hour_of_week_lookup(windows: DataFrame, profile: DataFrame) -> DataFrame:
    """Windows with their (scope, hour of week) baseline; a profile has at most 168 rows per scope."""
    return windows.withColumn("hour_of_week", hour_of_week(F.col("window_start"))).join(
        profile, ["scope_id", "hour_of_week"], "left"
    )
