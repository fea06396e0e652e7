"""Read models: overviews, histories, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.timebins import seconds_between
from vigilmesh.operators.latest import newest


def open_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("scope_id", "service").agg(
        F.count_if(F.col("technical_state") == "ONGOING").alias("ongoing"),
        F.count_if(F.col("technical_state") != "RECOVERED").alias("unresolved"),
        F.count("*").alias("incidents"),
    )


def overview(scopes: DataFrame, windows: DataFrame, incidents: DataFrame, now: Column) -> DataFrame:
    """Newest window of each scope with freshness, and its incident counts."""
    latest = newest(windows.where(F.col("window_end") <= now), ["scope_id"], ["window_start"])
    age = seconds_between(F.col("window_end"), now)
    freshness = (
        F.when(F.col("window_end").isNull(), "NEVER_SEEN").when(F.col("quality") == "MISSING", "MISSING")
        .when(age > policies.STALE_AFTER_SECONDS, "STALE").otherwise("FRESH")
    )
    counts = open_counts(incidents).groupBy("scope_id").agg(
        F.sum("ongoing").alias("ongoing"), F.sum("unresolved").alias("unresolved"))
    return (
        scopes.select("scope_id").join(latest, "scope_id", "left").join(counts, "scope_id", "left")
        .withColumn("freshness", freshness).na.fill({"ongoing": 0, "unresolved": 0})
    )


def priority_columns(incidents: DataFrame, now: Column) -> DataFrame:
    """Band, comparable impact and sort keys of the priority list."""
    age = seconds_between(F.col("last_observed_at"), now)
    recovered = F.col("technical_state") == "RECOVERED"
    fresh = (F.col("technical_state") == "ONGOING") & age.between(0, policies.STALE_AFTER_SECONDS)
    band = F.when(recovered, 2).when(fresh, 0).otherwise(1)
    severity = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).otherwise(2)
    return incidents.withColumns({
        "band": band,
        "severity_key": F.when(band == 0, severity).otherwise(3),
        "service_key": F.when(band == 0, F.when(F.col("service") == "SMS", 0).otherwise(1)).otherwise(2),
        "comparable_impact": F.when(band == 0, F.col("impact")),
        "freshness": F.when(recovered, "RECOVERED").when(F.col("technical_state") == "UNKNOWN", "UNKNOWN")
        .when(fresh, "FRESH").otherwise("STALE"),
    })


PRIORITY_ORDER = ["band", "severity_key", "service_key"]


def priority_order() -> list[Column]:
    return [*[F.col(c) for c in PRIORITY_ORDER], F.col("comparable_impact").desc_nulls_last(), F.col("first_observed_at"),
            F.col("episode_id")]


def impact_origin(detections: DataFrame) -> DataFrame:
    """Detections with the id and end of the detection their shown impact comes from.

    An UNKNOWN detection shows the newest earlier impact of its episode; others show their own.
    """
    from pyspark.sql import Window

    upto = Window.partitionBy("episode_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("phase") != "UNKNOWN", F.struct("detection_id", "window_end", "sequence"))
    return detections.withColumn("origin", F.last(own, ignorenulls=True).over(upto))
