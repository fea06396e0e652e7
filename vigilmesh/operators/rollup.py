"""Population-correct rollups of native primitives.

One pass over a native table computes the primitives of all its metrics per (scope, bucket): every
primitive is a sum, a maximum or a max_by, so partial aggregation on the map side leaves at most one
row per task, scope and bucket to shuffle, however large or skewed the input is. All later steps work
on that grid, whose size is scopes × buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.dictionary import BYTES_PER_GBPS_SLOT, METRICS, definition, kind_of
from vigilmesh.functions import quality
from vigilmesh.functions.arithmetic import bin_quantile, divide, percent
from vigilmesh.functions.timebins import floor_to, request_bounds, seconds_between, shift

BINS = range(9)

# Native columns each kind sums, retains as a snapshot, or pools as a histogram.
SUMS = {
    "CITY": [
        "voice_attempts", "voice_success", "voice_drops", "voice_holding_seconds", "voice_setup_elapsed_seconds",
        "sms_submitted", "sms_delivered", "sms_expired", "data_attempts", "data_success", "dns_attempts",
        "dns_success", "user_throughput_mbps", "ho_attempts", "ho_success",
    ],
    "LINK": ["traffic_gbps", "interface_errors", "queue_drops"],
    "ROAMING": [
        "reg_attempts", "reg_success", "data_attempts", "data_success", "voice_attempts", "voice_success",
    ],
}
SNAPSHOTS = {
    "CITY": ["sms_queue", "sms_oldest_seconds"],
    "LINK": ["effective_capacity_gbps", "rtt_ms", "jitter_ms"],
    "ROAMING": ["active_users", "rtt_ms"],
}
HISTOGRAMS = {"CITY": ["voice_setup_hist", "sms_delay_hist"], "LINK": [], "ROAMING": []}


@dataclass(frozen=True)
class Request:
    start: str
    end: str
    resolution: str

    @property
    def bounds(self) -> dict:
        return request_bounds(self.start, self.end, self.resolution)


def ts_lit(value) -> Column:
    return F.lit(value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def bucket_grid(scopes: DataFrame, start: datetime, end: datetime, seconds: int) -> DataFrame:
    """Every scope × every bucket of [start, end). ``scopes`` holds one row per scope."""
    last = F.timestamp_seconds(F.unix_seconds(ts_lit(end)) - seconds)
    buckets = F.sequence(ts_lit(start), last, F.expr(f"INTERVAL {seconds} SECONDS"))
    return scopes.select("*", F.explode(buckets).alias("bucket_start"))


def bucket_primitives(
    facts: DataFrame, kind: str, request: Request, metrics: list[str] | None = None
) -> DataFrame:
    """Primitives of every metric of ``kind`` per (scope_id, bucket), including retained snapshots.

    ``facts`` has ``scope_id``, ``ts`` and the native columns. Slots before the request feed only the
    retained snapshot; they collapse into the bucket just before the first one.
    """
    b = request.bounds
    seconds = b["seconds"]
    wanted = set()
    for metric in metrics or [m for m, d, *_ in METRICS if kind_of(d) == kind]:
        d = definition(metric)
        # A snapshot metric reads its own field only; the others document where it comes from.
        wanted |= set(d["fields"][:1] if d["aggregation"].startswith("SNAPSHOT") else d["fields"])
    lo, hi = ts_lit(request.start), ts_lit(request.end)
    snapshot_needed = bool(wanted & set(SNAPSHOTS[kind]))
    facts = facts.where(F.col("ts") < hi)
    if not snapshot_needed:
        facts = facts.where(F.col("ts") >= lo)
    inside = (F.col("ts") >= lo) & (shift(F.col("ts"), policies.SLOT_SECONDS) <= hi)
    first = ts_lit(b["effective_from"])
    bucket = F.when(F.col("ts") < lo, shift(first, -seconds)).otherwise(floor_to(F.col("ts"), seconds))

    aggregates = [F.count_if(inside).alias("received")]
    for name in SUMS[kind]:
        if name in wanted:
            aggregates.append(F.sum(F.when(inside, F.col(name))).alias(f"sum_{name}"))
    for name in HISTOGRAMS[kind]:
        if name in wanted:
            aggregates += [F.sum(F.when(inside, F.col(name)[i])).alias(f"{name}_{i}") for i in BINS]
    if kind == "LINK" and "traffic_gbps" in wanted:
        use = percent(F.col("traffic_gbps"), F.col("effective_capacity_gbps"))
        aggregates += [
            F.sum(F.when(inside, use * policies.SLOT_SECONDS)).alias("utilization_time"),
            F.max(F.when(inside, use)).alias("utilization_peak"),
            F.count_if(inside & use.isNull()).alias("capacity_missing"),
        ]
    if snapshot_needed:
        kept = [n for n in SNAPSHOTS[kind] if n in wanted]
        aggregates.append(
            F.max_by(F.struct("ts", *kept), "ts").alias("last")
        )
        # The newest value that can open the next bucket: the slot that ends where the bucket ends.
        edge = F.pmod(F.unix_seconds("ts") + policies.SLOT_SECONDS, F.lit(seconds)) == 0
        aggregates.append(F.max_by(F.struct("ts", *kept), F.when(edge, F.col("ts"))).alias("edge"))
    return facts.withColumn("bucket_start", bucket).groupBy("scope_id", "bucket_start").agg(*aggregates)


def on_grid(primitives: DataFrame, scopes: DataFrame, request: Request) -> DataFrame:
    """Primitives on the full grid, with opening and closing snapshots carried along each scope.

    The ordered window runs over the bucketed grid: a scope has one row per bucket there, at most
    8,641 for any admissible request.
    """
    b = request.bounds
    seconds = b["seconds"]
    first = ts_lit(b["effective_from"])
    grid = bucket_grid(scopes.select("scope_id"), b["effective_from"], b["effective_to"], seconds)
    if "last" not in primitives.columns:
        return grid.join(primitives, ["scope_id", "bucket_start"], "left").withColumn(
            "bucket_end", shift(F.col("bucket_start"), seconds)
        ).na.fill({"received": 0})
    before = scopes.select("scope_id", shift(first, -seconds).alias("bucket_start"))
    full = before.unionByName(grid).join(primitives, ["scope_id", "bucket_start"], "left")
    order = Window.partitionBy("scope_id").orderBy("bucket_start")
    previous = F.lag("edge").over(order)
    opening_ok = (
        (F.col("bucket_start") >= ts_lit(request.start))
        & (seconds_between(previous["ts"], F.col("bucket_start")) <= policies.SLOT_SECONDS)
    )
    return (
        full.withColumn("closing", F.last("last", ignorenulls=True).over(order))
        .withColumn("opening", F.when(opening_ok, previous))
        .where(F.col("bucket_start") >= first)
        .withColumn("bucket_end", shift(F.col("bucket_start"), seconds))
        .na.fill({"received": 0})
    )


def metric_value(metric: str) -> dict[str, Column]:
    """Value, primitives and null reason of one metric over a row of the primitive grid."""
    d = definition(metric)
    fields, how = d["fields"], d["aggregation"]
    none = F.lit(None)
    out = {
        "value": none.cast("double"), "numerator": none.cast("double"), "denominator": none.cast("double"),
        "sum_value": none.cast("double"), "sample_count": none.cast("bigint"), "snapshot_at": none.cast("timestamp"),
        "reason": none.cast("string"),
    }
    received = F.col("received")
    if d["availability"] == "REQUIRES_ADDITIONAL_PRIMITIVES":
        out["reason"] = F.lit("ADDITIONAL_PRIMITIVES_REQUIRED")
    elif how == "COUNT_SUM":
        total = F.col(f"sum_{fields[0]}").cast("double")
        out["sum_value"] = total * BYTES_PER_GBPS_SLOT if metric == "transport.volume" else total
        out["value"] = out["sum_value"]
    elif how == "RATIO_OF_SUMS":
        n, m = F.col(f"sum_{fields[0]}"), F.col(f"sum_{fields[1]}")
        if metric == "sms.finalizedSuccess":
            m = m + n
        out["numerator"], out["denominator"] = n.cast("double"), m.cast("double")
        out["value"] = percent(n, m)
    elif how == "WEIGHTED_MEAN":
        out["sum_value"] = F.col(f"sum_{fields[0]}").cast("double")
        if metric == "volte.traffic.erlang":
            count = received * policies.SLOT_SECONDS
        else:
            count = F.col(f"sum_{fields[1]}") if len(fields) > 1 else received
        out["sample_count"] = count.cast("bigint")
        out["value"] = divide(out["sum_value"], count)
    elif how in ("TIME_WEIGHTED_MEAN", "MAXIMUM"):
        weighted = (
            F.col("sum_traffic_gbps") * policies.SLOT_SECONDS
            if metric == "transport.traffic"
            else F.col("utilization_time")
        )
        out["sum_value"] = weighted.cast("double")
        out["sample_count"] = (received * policies.SLOT_SECONDS).cast("bigint")
        value = F.col("utilization_peak") if how == "MAXIMUM" else divide(weighted, out["sample_count"])
        if metric == "transport.traffic":
            out["value"] = value
        else:
            out["value"] = F.when(F.col("capacity_missing") == 0, value)
            out["reason"] = F.when(F.col("capacity_missing") > 0, F.lit("MISSING_EFFECTIVE_CAPACITY"))
    elif how == "SNAPSHOT_LAST":
        out["value"] = F.col("closing")[fields[0]].cast("double")
        out["snapshot_at"] = F.col("closing")["ts"]
    elif how == "SNAPSHOT_DIFFERENCE":
        known = F.col("opening").isNotNull() & F.col("closing").isNotNull()
        moved = F.col("closing")[fields[0]] - F.col("opening")[fields[0]]
        out["value"] = F.when(known, moved.cast("double"))
        out["snapshot_at"] = F.when(known, F.col("closing")["ts"])
        out["reason"] = F.when(~known, F.lit("OPENING_SNAPSHOT_UNAVAILABLE"))
    elif how == "HISTOGRAM_P95":
        bins = [F.coalesce(F.col(f"{fields[0]}_{i}"), F.lit(0)) for i in BINS]
        edges = policies.SMS_EDGES if fields[0].startswith("sms") else policies.VOICE_EDGES
        scale = 1000.0 if d["unit"] == "MILLISECONDS" else 1.0
        out["sample_count"] = sum(bins[1:], bins[0]).cast("bigint")
        out["value"] = bin_quantile(bins, edges) * scale
        out["reason"] = F.when(out["sample_count"] == 0, F.lit("EMPTY_HISTOGRAM"))
    if how in ("RATIO_OF_SUMS", "WEIGHTED_MEAN") and d["availability"] != "REQUIRES_ADDITIONAL_PRIMITIVES":
        out["reason"] = F.when(out["value"].isNull(), F.lit("ZERO_DENOMINATOR"))
    no_source = received == 0
    if how.startswith("SNAPSHOT") and d["availability"] != "REQUIRES_ADDITIONAL_PRIMITIVES":
        no_source = no_source & F.col("closing").isNull()
    absent = ["value", "numerator", "denominator", "sum_value", "sample_count", "snapshot_at"]
    for name in absent:
        out[name] = F.when(~no_source, out[name])
    out["reason"] = F.when(no_source, F.lit("NO_SOURCE_SLOTS")).otherwise(out["reason"])
    return out


def reference_series(facts: DataFrame, scopes: DataFrame, metrics: list[str], request: Request) -> DataFrame:
    """Dictionary-driven series of several metrics of one kind: one scan, one shuffle, one row per
    (metric, scope, bucket)."""
    kinds = {definition(m)["kind"] for m in metrics}
    if len(kinds) != 1:
        raise ValueError("metrics of one series must share their native table")
    kind = kinds.pop()
    seconds = request.bounds["seconds"]
    expected = seconds // policies.SLOT_SECONDS
    grid = on_grid(bucket_primitives(facts, kind, request, metrics), scopes, request)

    def packed(metric: str) -> Column:
        d = definition(metric)
        v = metric_value(metric)
        age = seconds_between(v["snapshot_at"], F.col("bucket_end"))
        return F.struct(
            F.lit(metric).alias("metric_id"),
            F.lit(d["unit"]).alias("unit"),
            F.lit(d["aggregation"]).alias("aggregation"),
            *[v[n].alias(n) for n in ("value", "numerator", "denominator", "sum_value", "sample_count",
                                      "snapshot_at")],
            age.alias("source_age_seconds"),
            v["reason"].alias("null_reason"),
            quality.reference_fold(F.col("received"), F.lit(expected), age, v["reason"]).alias("quality"),
            quality.reference_reason(F.col("received"), F.lit(expected), age, v["reason"]).alias("quality_reason"),
        )

    rows = grid.select(
        "scope_id", "bucket_start", "bucket_end", "received",
        F.explode(F.array(*[packed(m) for m in metrics])).alias("m"),
    )
    # An active-user snapshot exists only for its own direction.
    for metric, suffix in (("roaming.activeInbound", ":in"), ("roaming.activeOutbound", ":out")):
        if metric in metrics:
            rows = rows.where((F.col("m.metric_id") != metric) | F.col("scope_id").endswith(suffix))
    return rows.select(
        "scope_id", "bucket_start", "bucket_end", "m.*",
        F.lit(expected).cast("bigint").alias("expected_slots"),
        F.col("received").alias("received_slots"),
        (F.col("received") / expected).alias("coverage"),
    )


def stored_ratio_series(windows: DataFrame, scopes: DataFrame, request: Request) -> DataFrame:
    """Ratio series over stored metric windows: newest revision per slot, full grid, API quality fold."""
    b = request.bounds
    seconds = b["seconds"]
    expected = seconds // policies.SLOT_SECONDS
    lo, hi = ts_lit(request.start), ts_lit(request.end)
    newest = latest_revision(
        windows.where((F.col("bucket_start") >= lo) & (shift(F.col("bucket_start"), policies.SLOT_SECONDS) <= hi))
    )
    usable = (
        F.col("quality").isin("VALID", "PARTIAL") & F.col("numerator").isNotNull() & F.col("denominator").isNotNull()
    )
    sums = (
        newest.withColumn("bucket", floor_to(F.col("bucket_start"), seconds))
        .groupBy("scope_id", F.col("bucket").alias("bucket_start"))
        .agg(
            F.sum(F.when(usable, F.col("numerator"))).alias("numerator"),
            F.sum(F.when(usable, F.col("denominator"))).alias("denominator"),
            F.sum(F.when(usable, F.col("coverage_ppm"))).alias("ppm"),
            F.bool_or(F.col("quality") == "STALE").alias("stale"),
            F.bool_or((F.col("quality") != "VALID") | F.col("numerator").isNull() | F.col("denominator").isNull())
            .alias("invalid"),
            F.bool_or("source_unknown").alias("source_unknown"),
            F.count("*").alias("received_slots"),
        )
    )
    grid = bucket_grid(scopes.select("scope_id"), b["effective_from"], b["effective_to"], seconds)
    flags = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("stale", "invalid", "source_unknown")}
    coverage = F.coalesce(F.col("ppm"), F.lit(0)) / (1_000_000 * expected)
    state = quality.api_fold(coverage, flags["stale"], flags["invalid"], flags["source_unknown"], F.col("denominator"))
    empty = F.coalesce(F.col("denominator") == 0, F.lit(False))
    return grid.join(sums, ["scope_id", "bucket_start"], "left").select(
        "scope_id",
        "bucket_start",
        shift(F.col("bucket_start"), seconds).alias("bucket_end"),
        percent(F.col("numerator"), F.col("denominator")).alias("value"),
        "numerator",
        "denominator",
        coverage.alias("coverage"),
        state.alias("quality"),
        F.when(state == "MISSING", "NO_SOURCE_SLOTS").when(empty, "ZERO_DENOMINATOR").alias("null_reason"),
        F.when(empty, "ZERO_DENOMINATOR")
        .when(flags["source_unknown"], "SOURCE_QUALITY_UNAVAILABLE")
        .alias("quality_reason"),
        F.lit(expected).cast("bigint").alias("expected_slots"),
        F.coalesce(F.col("received_slots"), F.lit(0)).alias("received_slots"),
    )


def latest_revision(windows: DataFrame, keys=("scope_id", "bucket_start")) -> DataFrame:
    """Newest revision per slot as an aggregate: no group is ever sorted or collected."""
    rest = [c for c in windows.columns if c not in keys]
    newest = windows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("r"))
    return newest.select(*keys, "r.*")


def producer_rollup(native: DataFrame, scopes: DataFrame, request: Request) -> DataFrame:
    """Producer buckets with expected and received slots, coverage, and the rank fold of quality."""
    b = request.bounds
    seconds = b["seconds"]
    expected = seconds // policies.SLOT_SECONDS
    lo, hi = ts_lit(request.start), ts_lit(request.end)
    rows = native.where((F.col("ts") >= lo) & (shift(F.col("ts"), policies.SLOT_SECONDS) <= hi))
    state = quality.native_quality(F.col("source_quality"), F.col("source_coverage"))
    rows = rows.withColumn("rank", quality.rank(state)).withColumn(
        "why", quality.native_reason(F.col("source_quality"), F.col("source_coverage"))
    )
    # Worst member wins; among equally bad ones the earliest slot gives the reason.
    sums = (
        rows.withColumn("bucket_start", floor_to(F.col("ts"), seconds))
        .groupBy("scope_id", "bucket_start")
        .agg(
            F.sum("numerator").alias("numerator"),
            F.sum("denominator").alias("denominator"),
            F.count("*").alias("received_slots"),
            F.max("rank").alias("worst"),
            F.min_by("why", F.struct((-F.col("rank")).alias("r"), F.col("ts"))).alias("why"),
        )
    )
    grid = bucket_grid(scopes.select("scope_id"), b["effective_from"], b["effective_to"], seconds)
    received = F.coalesce(F.col("received_slots"), F.lit(0))
    folded = quality.producer_fold(F.col("worst"), received, F.lit(expected), F.col("denominator"))
    return grid.join(sums, ["scope_id", "bucket_start"], "left").select(
        "scope_id",
        "bucket_start",
        shift(F.col("bucket_start"), seconds).alias("bucket_end"),
        ((F.col("bucket_start") < lo) | (shift(F.col("bucket_start"), seconds) > hi)).alias("partial"),
        "numerator",
        "denominator",
        percent(F.col("numerator"), F.col("denominator")).alias("value"),
        F.when(received == 0, "NO_SOURCE_SLOTS").when(F.col("denominator") == 0, "ZERO_DENOMINATOR")
        .alias("null_reason"),
        F.lit(expected).cast("bigint").alias("expected_slots"),
        received.alias("received_slots"),
        (received / expected).alias("coverage"),
        quality.from_rank(folded).alias("quality"),
        F.when(received == 0, "NO_SOURCE_SLOTS")
        .when((F.col("denominator") == 0) & (F.greatest(F.col("worst"), F.when(received < expected, 1).otherwise(0)) < 2),
              "ZERO_DENOMINATOR")
        .when((received < expected) & (F.col("worst") < 1), "MISSING_SOURCE_SLOTS")
        .when(F.col("worst") > 0, F.col("why"))
        .alias("quality_reason"),
    )


def primitive_ratio_series(native: DataFrame, scopes: DataFrame, request: Request) -> DataFrame:
    """Ratio series over native projections with first reasons, homogeneous source quality, lineage ids.

    The id list of a bucket holds one entry per native slot, at most 72 for six-hour buckets.
    """
    b = request.bounds
    seconds = b["seconds"]
    expected = seconds // policies.SLOT_SECONDS
    lo, hi = ts_lit(request.start), ts_lit(request.end)
    rows = native.where((F.col("ts") >= lo) & (shift(F.col("ts"), policies.SLOT_SECONDS) <= hi))
    q = F.col("quality")

    def first_reason(state: str) -> Column:
        hit = (q == state) & F.col("quality_reason").isNotNull()
        return F.min_by("quality_reason", F.when(hit, F.col("ts")))

    sums = (
        rows.withColumn("bucket_start", floor_to(F.col("ts"), seconds))
        .groupBy("scope_id", "bucket_start")
        .agg(
            F.sum("numerator").alias("numerator"),
            F.sum("denominator").alias("denominator"),
            F.count("*").alias("received_slots"),
            F.bool_or(q == "STALE").alias("any_stale"),
            F.bool_or(q == "INSUFFICIENT_EVIDENCE").alias("any_insufficient"),
            F.bool_or(q != "VALID").alias("any_not_valid"),
            first_reason("STALE").alias("why_stale"),
            first_reason("INSUFFICIENT_EVIDENCE").alias("why_insufficient"),
            first_reason("PARTIAL").alias("why_partial"),
            F.min(F.coalesce("source_quality", F.lit(""))).alias("sq_low"),
            F.max(F.coalesce("source_quality", F.lit(""))).alias("sq_high"),
            F.array_sort(F.collect_list(F.struct("ts", "projection_id"))).alias("members"),
        )
    )
    grid = bucket_grid(scopes.select("scope_id"), b["effective_from"], b["effective_to"], seconds)
    received = F.coalesce(F.col("received_slots"), F.lit(0))
    edge = (F.col("bucket_start") < lo) | (shift(F.col("bucket_start"), seconds) > hi)
    empty = F.col("denominator") == 0
    state = (
        F.when(received == 0, "MISSING")
        .when(F.col("any_stale"), "STALE")
        .when(F.col("any_insufficient") | empty, "INSUFFICIENT_EVIDENCE")
        .when((received < expected) | F.col("any_not_valid") | edge, "PARTIAL")
        .otherwise("VALID")
    )
    reason = (
        F.when(received == 0, "NO_SOURCE_SLOTS")
        .when(state == "STALE", F.coalesce("why_stale", F.lit("SOURCE_STALE")))
        .when(
            state == "INSUFFICIENT_EVIDENCE",
            F.coalesce("why_insufficient", F.when(empty, F.lit("ZERO_DENOMINATOR"))),
        )
        .when(edge, "PARTIAL_REQUEST_EDGE")
        .when(received < expected, "MISSING_SOURCE_SLOTS")
        .when(state == "PARTIAL", F.coalesce("why_partial", F.lit("SOURCE_PARTIAL")))
    )
    return grid.join(sums, ["scope_id", "bucket_start"], "left").select(
        "scope_id",
        "bucket_start",
        shift(F.col("bucket_start"), seconds).alias("bucket_end"),
        percent(F.col("numerator"), F.col("denominator")).alias("value"),
        "numerator",
        "denominator",
        (received / expected).alias("coverage"),
        state.alias("quality"),
        F.when(received == 0, "NO_SOURCE_SLOTS").when(empty, "ZERO_DENOMINATOR").alias("null_reason"),
        reason.alias("quality_reason"),
        F.lit(expected).cast("bigint").alias("expected_slots"),
        received.alias("received_slots"),
        F.when((F.col("sq_low") == F.col("sq_high")) & (F.col("sq_low") != ""), F.col("sq_low"))
        .alias("source_quality"),
        F.col("members.projection_id").alias("projection_ids"),
    )


def mixed_versions(windows: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """Groups whose rows disagree on a version column: such rows must never be aggregated together."""
    bad = F.lit(False)
    aggregates = []
    for name in versions:
        aggregates += [F.min(name).alias(f"{name}_lo"), F.max(name).alias(f"{name}_hi")]
        bad = bad | ~F.col(f"{name}_lo").eqNullSafe(F.col(f"{name}_hi"))
    return windows.groupBy(*keys).agg(*aggregates, F.count("*").alias("rows")).where(bad)
