"""Guards of series requests: what may not be answered, and why, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.operators.validation import first_reason

#: What every window of a series must agree on.
SHAPE = ["unit", "aggregation", "policy_version", "topology_version", "source_resolution_seconds"]
# Snapshots that exist for one direction only, by the end of their scope's name.
DIRECTIONS = {"roaming.activeOutbound": ":out", "roaming.activeInbound": ":in"}


def point_count(start: Column, end: Column, seconds: Column) -> Column:
    """Buckets that cover [start, end), partial ones included; null for an unknown resolution."""
    return F.ceil(F.unix_seconds(end) / seconds) - F.floor(F.unix_seconds(start) / seconds)


def judge(requests: DataFrame, windows: DataFrame, datasets: DataFrame, scopes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each request with ``reason``, null if it may be answered, its ``points`` and the ``windows`` found for it.

    requests: request_id (unique), dataset_id, domain, metric_id, scope_id, resolution, requested_from, requested_to. windows: dataset_id, metric_id,
    scope_id, bucket_start and SHAPE. The first guard that holds is the reason, in the order of the list below. A series' shapes are
    reduced to the least and the greatest one in the aggregate that counts its windows, so that a series with a third of all
    windows is one row per task. A request without windows is answered, with an empty series. Null metrics, datasets or scopes are
    unknown; a null or unknown resolution or bound is UNSUPPORTED_RANGE.
    """
    c = F.col
    steps = F.create_map(*[F.lit(x) for pair in [*policies.RESOLUTIONS.items(), ("1s", 1)] for x in pair])
    contract = dictionary.select(
        "metric_id", "domain", c("unit").alias("d_unit"), c("aggregation_type").alias("d_aggregation"), c("policy_version").alias("d_policy"))
    known = datasets.select("dataset_id", c("source_resolution_seconds").alias("native"), "available_from", "available_to", F.lit(True).alias("has_dataset"))
    named = scopes.select("scope_id", c("topology_version").alias("s_topology"), F.lit(True).alias("has_scope"))
    # Metadata of a fixed number of rows each, but for the scopes; sizes decide how they are joined.
    asked = requests.join(contract, ["metric_id", "domain"], "left").join(known, "dataset_id", "left").join(named, "scope_id", "left")
    shape = F.struct(*SHAPE)
    w = windows.select("dataset_id", "metric_id", "scope_id", "bucket_start", *SHAPE)
    wanted = requests.select("request_id", "dataset_id", "metric_id", "scope_id", "requested_from", "requested_to")
    inside = (c("bucket_start") >= c("requested_from")) & (c("bucket_start") < c("requested_to"))
    found = (
        wanted.join(w, ["dataset_id", "metric_id", "scope_id"]).where(inside).groupBy("request_id")
        .agg(F.count("*").alias("windows"), F.min(shape).alias("least"), F.max(shape).alias("greatest"))
    )
    judged = asked.join(found, "request_id", "left").withColumn("points", point_count(c("requested_from"), c("requested_to"), F.try_element_at(steps, c("resolution"))))
    least = c("least")
    differs = (
        (least["policy_version"] != c("d_policy")) | (least["topology_version"] != c("s_topology")) | (least["aggregation"] != c("d_aggregation"))
        | (least["unit"] != c("d_unit")) | (least["source_resolution_seconds"] != policies.SLOT_SECONDS)
    )
    wrong_direction = F.lit(False)
    for metric, end in DIRECTIONS.items():
        wrong_direction = wrong_direction | ((c("metric_id") == metric) & ~c("scope_id").endswith(end))
    reason = first_reason([
        (c("points").isNull() | (c("points") <= 0), "UNSUPPORTED_RANGE"),
        (c("points") > policies.MAX_POINTS, "TOO_MANY_BUCKETS"),
        (c("d_unit").isNull(), "UNKNOWN_METRIC"),
        (c("has_dataset").isNull(), "UNKNOWN_DATASET"),
        ((c("native") != policies.SLOT_SECONDS) | (c("requested_from") < c("available_from")) | (c("requested_to") > c("available_to")), "OUTSIDE_HISTORY"),
        (c("has_scope").isNull(), "UNKNOWN_SCOPE"),
        (wrong_direction, "SNAPSHOT_DIRECTION"),
        (least != c("greatest"), "MIXED_SHAPES"),
        (differs, "CONTRACT_MISMATCH"),
    ])
    return judged.select(*requests.columns, reason.alias("reason"), "points", F.coalesce("windows", F.lit(0)).alias("windows"))


def answered(judged: DataFrame) -> DataFrame:
    """The requests that passed every guard."""
    return judged.where("reason IS NULL").drop("reason")
