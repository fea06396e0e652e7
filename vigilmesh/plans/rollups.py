"""Rollup queries: AGG-1…15, AGG-23 and the flagship series."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.adapters import ARCHIVE_END, ARCHIVE_START, Tables
from vigilmesh.dictionary import BYTES_PER_GBPS_SLOT, METRICS, definition, kind_of
from vigilmesh.functions.timebins import iso, request_bounds, shift
from vigilmesh.operators import rollup
from vigilmesh.oracle_views import sql
from vigilmesh.plans.common import bucket_sql, num, num_sql
from vigilmesh.plans.common import when_sql as fmt
from vigilmesh.registry import query

FACTS = {"CITY": ("city_facts", "cities"), "LINK": ("link_facts", "links"), "ROAMING": ("roam_facts", "partners")}


def grid_sql(scopes: str, request: rollup.Request) -> str:
    b = request_bounds(request.start, request.end, request.resolution)
    s = b["seconds"]
    return f"""
SELECT scope_id, bucket_start, bucket_start + to_seconds({s}) AS bucket_end FROM {scopes},
  (SELECT unnest(generate_series(TIMESTAMP '{b["effective_from"]}', TIMESTAMP '{b["effective_to"]}' - to_seconds({s}),
    to_seconds({s}))) AS bucket_start)"""


def quantile_sql(bins: str, edges: list[float]) -> str:
    """Interpolated 95th percentile of a list-valued expression."""
    total = f"list_sum({bins})"
    text = "NULL"
    for i in reversed(range(9)):
        through = f"list_sum(list_slice({bins}, 1, {i + 1}))"
        before = f"coalesce(list_sum(list_slice({bins}, 1, {i})), 0)"
        low = edges[i - 1] if i else 0.0
        text = (
            f"CASE WHEN {bins}[{i + 1}] > 0 AND {through} * 20 >= {total} * 19 THEN {low}::DOUBLE + "
            f"CAST({total} * 19 - {before} * 20 AS DOUBLE) / CAST({bins}[{i + 1}] * 20 AS DOUBLE) * "
            f"{edges[i] - low}::DOUBLE ELSE {text} END"
        )
    return f"CASE WHEN {total} > 0 THEN {text} END"


DIRECTION_SQL = {
    "roaming.activeInbound": " WHERE scope_id LIKE '%:in'",
    "roaming.activeOutbound": " WHERE scope_id LIKE '%:out'",
}


def series_oracle(metrics: list[str], request: rollup.Request) -> str:
    """The reference series stated relationally: a grid, an equi join per bucket, as-of joins for snapshots."""
    kind = definition(metrics[0])["kind"]
    facts, scopes = FACTS[kind]
    b = request_bounds(request.start, request.end, request.resolution)
    s = b["seconds"]
    expected = s // 300
    sums = {f for m in metrics for f in definition(m)["fields"] if not f.endswith("_hist")}
    hists = {f for m in metrics for f in definition(m)["fields"] if f.endswith("_hist")}
    cols = [f"sum(f.{c}) AS s_{c}" for c in sorted(sums)]
    cols += [
        f"[{', '.join(f'CAST(coalesce(sum(f.{c}[{i + 1}]), 0) AS BIGINT)' for i in range(9))}] AS h_{c}"
        for c in sorted(hists)
    ]
    if kind == "LINK":
        use = "100.0::DOUBLE * CAST(f.traffic_gbps AS DOUBLE) / nullif(CAST(f.effective_capacity_gbps AS DOUBLE), 0)"
        cols += [f"sum({use} * 300) AS use_time", f"max({use}) AS use_peak"]
    agg = f"""
SELECT g.scope_id, g.bucket_start, g.bucket_end, least(g.bucket_end, TIMESTAMP '{request.end}') AS edge,
  count(f.ts) AS received, {", ".join(cols) or "1 AS one"}
FROM grid g LEFT JOIN (SELECT *, {bucket_sql("ts", s)} AS b FROM {facts}
    WHERE ts >= TIMESTAMP '{request.start}' AND ts + INTERVAL 300 SECOND <= TIMESTAMP '{request.end}') f
  ON f.scope_id = g.scope_id AND f.b = g.bucket_start GROUP BY ALL"""
    # Only what is retained, and the last of it before each bucket's edge: edges and facts in one order, an edge before a fact of its instant.
    kept = f"(SELECT scope_id, ts, {', '.join(rollup.SNAPSHOTS[kind])} FROM {facts})"
    full = f"""
SELECT a.*, c.k AS closing, o AS opening FROM agg a
LEFT JOIN (SELECT DISTINCT scope_id, moment, k FROM (
    SELECT scope_id, moment, is_fact, last_value(k IGNORE NULLS) OVER (PARTITION BY scope_id ORDER BY moment, is_fact ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
    FROM (SELECT scope_id, edge AS moment, FALSE AS is_fact, NULL AS k FROM agg UNION ALL SELECT f.scope_id, f.ts, TRUE, f FROM {kept} f)) WHERE NOT is_fact) c
  ON c.scope_id = a.scope_id AND c.moment = a.edge
LEFT JOIN {kept} o ON o.scope_id = a.scope_id AND o.ts = a.bucket_start - INTERVAL 300 SECOND
  AND a.bucket_start >= TIMESTAMP '{request.start}'"""
    branches = []
    for m in metrics:
        d = definition(m)
        f, how = d["fields"], d["aggregation"]
        null = "CAST(NULL AS DOUBLE)"
        value = num = den = tot = null
        count, snap, reason = "CAST(NULL AS BIGINT)", "CAST(NULL AS TIMESTAMP)", "CAST(NULL AS VARCHAR)"
        none = "received = 0"
        if d["availability"] == "REQUIRES_ADDITIONAL_PRIMITIVES":
            reason = "'ADDITIONAL_PRIMITIVES_REQUIRED'"
        elif how == "COUNT_SUM":
            tot = f"CAST(s_{f[0]} AS DOUBLE)" + (f" * {BYTES_PER_GBPS_SLOT}" if m == "transport.volume" else "")
            value = tot
        elif how == "RATIO_OF_SUMS":
            num, den = f"CAST(s_{f[0]} AS DOUBLE)", f"CAST(s_{f[1]} AS DOUBLE)"
            if m == "sms.finalizedSuccess":
                den = f"({den} + {num})"
            value = f"100 * {num} / nullif({den}, 0)"
            reason = f"CASE WHEN {den} = 0 THEN 'ZERO_DENOMINATOR' END"
        elif how == "WEIGHTED_MEAN":
            tot = f"CAST(s_{f[0]} AS DOUBLE)"
            count = "received * 300" if m.endswith("erlang") else f"CAST(s_{f[1]} AS BIGINT)" if len(f) > 1 else "received"
            value = f"{tot} / nullif({count}, 0)"
            reason = f"CASE WHEN {count} = 0 THEN 'ZERO_DENOMINATOR' END"
        elif how in ("TIME_WEIGHTED_MEAN", "MAXIMUM"):
            tot = "CAST(s_traffic_gbps AS DOUBLE) * 300" if m == "transport.traffic" else "use_time"
            count = "received * 300"
            value = "use_peak" if how == "MAXIMUM" else f"{tot} / nullif({count}, 0)"
        elif how == "SNAPSHOT_LAST":
            value, snap, none = f"CAST(closing.{f[0]} AS DOUBLE)", "closing.ts", "received = 0 AND closing.ts IS NULL"
        elif how == "SNAPSHOT_DIFFERENCE":
            known = "opening.ts IS NOT NULL AND closing.ts IS NOT NULL"
            value = f"CASE WHEN {known} THEN CAST(closing.{f[0]} - opening.{f[0]} AS DOUBLE) END"
            snap = f"CASE WHEN {known} THEN closing.ts END"
            reason = f"CASE WHEN NOT ({known}) THEN 'OPENING_SNAPSHOT_UNAVAILABLE' END"
            none = "received = 0 AND closing.ts IS NULL"
        elif how == "HISTOGRAM_P95":
            edges = policies.SMS_EDGES if f[0].startswith("sms") else policies.VOICE_EDGES
            value = f"({quantile_sql('h_' + f[0], edges)}) * {1000 if d['unit'] == 'MILLISECONDS' else 1}"
            count = f"CAST(list_sum(h_{f[0]}) AS BIGINT)"
            reason = f"CASE WHEN {count} = 0 THEN 'EMPTY_HISTOGRAM' END"
        branches.append(
            f"SELECT '{m}' AS metric_id, scope_id, bucket_start, bucket_end, received, {none} AS nosrc, "
            f"{value} AS value, {num} AS numerator, {den} AS denominator, {tot} AS sum_value, {count} AS sample_count, "
            f"{snap} AS snapshot_at, {reason} AS why FROM full_rows"
            + DIRECTION_SQL.get(m, "")
        )
    shaped = """
SELECT *, CASE WHEN nosrc THEN 'NO_SOURCE_SLOTS' ELSE why END AS reason,
  CASE WHEN NOT nosrc THEN CAST(epoch(bucket_end) - epoch(snapshot_at) AS BIGINT) END AS age FROM metric_rows"""
    body = f"""
SELECT metric_id, scope_id, {fmt("bucket_start")} AS bucket_start,
  CASE WHEN NOT nosrc THEN {num_sql('value')} END AS value,
  CASE WHEN NOT nosrc THEN numerator END AS numerator, CASE WHEN NOT nosrc THEN denominator END AS denominator,
  CASE WHEN NOT nosrc THEN {num_sql('sum_value')} END AS sum_value,
  CASE WHEN NOT nosrc THEN CAST(sample_count AS BIGINT) END AS sample_count,
  CASE WHEN NOT nosrc THEN {fmt("snapshot_at")} END AS snapshot_at, age AS source_age_seconds,
  reason AS null_reason,
  CASE WHEN received = 0 AND age IS NULL THEN 'MISSING' WHEN age > 600 THEN 'STALE'
    WHEN reason IS NOT NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN received < {expected} THEN 'PARTIAL'
    ELSE 'INSUFFICIENT_EVIDENCE' END AS quality,
  CASE WHEN reason IS NOT NULL THEN reason WHEN age > 600 THEN 'RETAINED_SNAPSHOT_STALE'
    WHEN received < {expected} THEN 'MISSING_SOURCE_SLOTS' ELSE 'SOURCE_QUALITY_UNAVAILABLE' END AS quality_reason,
  CAST({expected} AS BIGINT) AS expected_slots, CAST(received AS BIGINT) AS received_slots,
  {num_sql(f'received / {expected}.0::DOUBLE')} AS coverage
FROM shaped"""
    return sql(
        body, facts, scopes, grid=grid_sql(scopes, request), agg=agg, full_rows=full,
        metric_rows=" UNION ALL ".join(branches), shaped=shaped,
    )


def publish(series):
    """The series with text timestamps and rounded doubles, as the oracle prints them."""
    return series.select(
        "metric_id", "scope_id", iso(F.col("bucket_start")).alias("bucket_start"),
        num("value"), "numerator", "denominator",
        num("sum_value"), "sample_count",
        iso(F.col("snapshot_at")).alias("snapshot_at"), "source_age_seconds", "null_reason", "quality",
        "quality_reason", "expected_slots", "received_slots", num("coverage"),
    )


def register_series(name: str, metrics: list[str], resolution: str):
    request = rollup.Request(ARCHIVE_START, ARCHIVE_END, resolution)
    facts, scopes = FACTS[definition(metrics[0])["kind"]]

    @query(name, series_oracle(metrics, request))
    def build(t: Tables):
        return publish(rollup.reference_series(getattr(t, facts), getattr(t, scopes), metrics, request))


def by_aggregation(how: str, kind: str) -> list[str]:
    return [m for m, d, _, a, *_ in METRICS if a == how and kind_of(d) == kind]


register_series("agg_01_count_sum_city", by_aggregation("COUNT_SUM", "CITY"), "1h")
register_series("agg_01_count_sum_link_volume", by_aggregation("COUNT_SUM", "LINK"), "1h")
register_series("agg_02_ratio_of_sums_city", by_aggregation("RATIO_OF_SUMS", "CITY"), "1h")
register_series("agg_02_ratio_of_sums_roaming", by_aggregation("RATIO_OF_SUMS", "ROAMING"), "6h")
register_series("agg_03_weighted_mean", by_aggregation("WEIGHTED_MEAN", "CITY"), "1h")
register_series("agg_04_time_weighted_mean", by_aggregation("TIME_WEIGHTED_MEAN", "LINK"), "1h")
register_series("agg_05_maximum_utilization", by_aggregation("MAXIMUM", "LINK"), "1h")
register_series("agg_06_snapshot_last_link", by_aggregation("SNAPSHOT_LAST", "LINK"), "15m")
register_series("agg_06_snapshot_last_city", by_aggregation("SNAPSHOT_LAST", "CITY"), "15m")
register_series("agg_07_snapshot_difference", by_aggregation("SNAPSHOT_DIFFERENCE", "CITY"), "15m")
register_series("agg_08_histogram_p95", by_aggregation("HISTOGRAM_P95", "CITY"), "1h")
register_series("agg_09_state_timeline", by_aggregation("STATE_TIMELINE", "LINK"), "6h")
register_series("agg_13_reference_series_city", [m for m, d, *_ in METRICS if kind_of(d) == "CITY"], "6h")
register_series("agg_13_reference_series_link", [m for m, d, *_ in METRICS if kind_of(d) == "LINK"], "6h")
register_series("agg_13_reference_series_roaming", [m for m, d, *_ in METRICS if kind_of(d) == "ROAMING"], "6h")

# -- stored windows ---------------------------------------------------------------------------------

HOURLY = rollup.Request(ARCHIVE_START, ARCHIVE_END, "1h")
PARTIAL_EDGES = rollup.Request("2026-09-10 09:25:00", "2026-10-10 08:40:00", "1h")


@query(
    "agg_10_stored_ratio_series_full_grid",
    sql(
        f"""
SELECT scope_id, {fmt("bucket_start")} AS bucket_start, {num_sql('100 * n / nullif(d, 0)')} AS value,
  CAST(n AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator, {num_sql('coverage')} AS coverage,
  quality, CASE WHEN quality = 'MISSING' THEN 'NO_SOURCE_SLOTS' WHEN d = 0 THEN 'ZERO_DENOMINATOR' END AS null_reason,
  CASE WHEN d = 0 THEN 'ZERO_DENOMINATOR' WHEN unknown THEN 'SOURCE_QUALITY_UNAVAILABLE' END AS quality_reason,
  received_slots
FROM (SELECT *, CASE WHEN d = 0 AND coverage > 0 THEN 'INSUFFICIENT_EVIDENCE'
    WHEN unknown AND coverage > 0 THEN 'INSUFFICIENT_EVIDENCE'
    WHEN coverage = 0 AND stale THEN 'STALE' WHEN coverage = 0 THEN 'MISSING'
    WHEN coverage < 1 OR invalid THEN 'PARTIAL' ELSE 'VALID' END AS quality FROM sums)""",
        "revisions",
        "cities",
        latest="""
SELECT * FROM revisions
QUALIFY row_number() OVER (PARTITION BY scope_id, bucket_start ORDER BY revision DESC) = 1""",
        grid=grid_sql("cities", HOURLY),
        sums=f"""
SELECT g.scope_id, g.bucket_start,
  sum(numerator) FILTER (WHERE quality IN ('VALID','PARTIAL'))::DOUBLE AS n,
  sum(denominator) FILTER (WHERE quality IN ('VALID','PARTIAL'))::DOUBLE AS d,
  coalesce(sum(coverage_ppm) FILTER (WHERE quality IN ('VALID','PARTIAL')), 0)::DOUBLE / 12000000 AS coverage,
  coalesce(bool_or(quality = 'STALE'), FALSE) AS stale, coalesce(bool_or(quality <> 'VALID'), FALSE) AS invalid,
  coalesce(bool_or(source_unknown), FALSE) AS unknown, count(w.bucket_start) AS received_slots
FROM grid g LEFT JOIN (SELECT *, {bucket_sql("bucket_start", 3600)} AS b FROM latest) w
  ON w.scope_id = g.scope_id AND w.b = g.bucket_start GROUP BY 1, 2""",
    ),
)
def stored_ratio(t: Tables):
    return rollup.stored_ratio_series(t.revisions, t.cities, HOURLY).select(
        "scope_id", iso(F.col("bucket_start")).alias("bucket_start"), num("value"),
        "numerator", "denominator", num("coverage"), "quality", "null_reason",
        "quality_reason", "received_slots",
    )


NATIVE_SQL = """
SELECT city_id AS scope_id, ts, voice_success AS numerator, voice_attempts AS denominator,
  CASE WHEN slot % 7 = 0 THEN NULL WHEN slot % 31 = 0 THEN 'STALE' WHEN slot % 19 = 0 THEN 'PARTIAL' ELSE 'VALID' END
    AS source_quality,
  CASE WHEN slot % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS source_coverage,
  sha256(city_id || '|' || CAST(epoch(ts) AS BIGINT)) AS projection_id FROM city5m"""

NATIVE_QUALITY_SQL = """
SELECT *, CASE WHEN source_quality IS NOT NULL AND source_quality <> 'VALID' THEN source_quality
    WHEN source_quality IS NULL OR source_coverage IS NULL THEN 'INSUFFICIENT_EVIDENCE'
    WHEN source_coverage < 1 THEN 'PARTIAL' ELSE 'VALID' END AS quality,
  CASE WHEN source_quality IS NULL THEN 'SOURCE_QUALITY_UNAVAILABLE'
    WHEN source_coverage IS NULL THEN 'SOURCE_COVERAGE_UNAVAILABLE'
    WHEN source_quality <> 'VALID' THEN 'SOURCE_' || source_quality
    WHEN source_coverage < 1 THEN 'SOURCE_COVERAGE_PARTIAL' END AS quality_reason FROM native"""


def native_rows(t: Tables):
    from vigilmesh.functions.fingerprint import identity

    return t.city5m.selectExpr(
        "city_id AS scope_id", "ts", "voice_success AS numerator", "voice_attempts AS denominator",
        "CASE WHEN slot % 7 = 0 THEN NULL WHEN slot % 31 = 0 THEN 'STALE' WHEN slot % 19 = 0 THEN 'PARTIAL' "
        "ELSE 'VALID' END AS source_quality",
        "CASE WHEN slot % 5 = 0 THEN 0.5D ELSE 1.0D END AS source_coverage",
    ).withColumn("projection_id", identity(F.col("scope_id"), F.unix_seconds("ts")))


@query(
    "agg_11_primitive_ratio_series",
    sql(
        f"""
SELECT scope_id, {fmt("bucket_start")} AS bucket_start, {num_sql('100 * n / nullif(d, 0)')} AS value,
  {num_sql('received / 12.0::DOUBLE')} AS coverage, quality,
  CASE WHEN received = 0 THEN 'NO_SOURCE_SLOTS' WHEN d = 0 THEN 'ZERO_DENOMINATOR' END AS null_reason,
  CASE WHEN received = 0 THEN 'NO_SOURCE_SLOTS' WHEN quality = 'STALE' THEN coalesce(why_stale, 'SOURCE_STALE')
    WHEN quality = 'INSUFFICIENT_EVIDENCE' THEN coalesce(why_ins, CASE WHEN d = 0 THEN 'ZERO_DENOMINATOR' END)
    WHEN edge THEN 'PARTIAL_REQUEST_EDGE' WHEN received < 12 THEN 'MISSING_SOURCE_SLOTS'
    WHEN quality = 'PARTIAL' THEN coalesce(why_partial, 'SOURCE_PARTIAL') END AS quality_reason,
  received AS received_slots, CASE WHEN kinds = 1 THEN sq END AS source_quality, ids AS projection_ids
FROM (SELECT *, CASE WHEN received = 0 THEN 'MISSING' WHEN st THEN 'STALE' WHEN ins OR d = 0 THEN 'INSUFFICIENT_EVIDENCE'
    WHEN received < 12 OR nv OR edge THEN 'PARTIAL' ELSE 'VALID' END AS quality FROM sums)""",
        "city5m",
        "cities",
        native=NATIVE_SQL,
        judged=NATIVE_QUALITY_SQL,
        grid=grid_sql("cities", PARTIAL_EDGES),
        sums=f"""
SELECT g.scope_id, g.bucket_start,
  g.bucket_start < TIMESTAMP '{PARTIAL_EDGES.start}' OR g.bucket_end > TIMESTAMP '{PARTIAL_EDGES.end}' AS edge,
  sum(numerator)::DOUBLE AS n, sum(denominator)::DOUBLE AS d, count(w.ts) AS received,
  bool_or(quality = 'STALE') AS st, bool_or(quality = 'INSUFFICIENT_EVIDENCE') AS ins,
  bool_or(quality <> 'VALID') AS nv,
  arg_min(quality_reason, w.ts) FILTER (WHERE quality = 'STALE') AS why_stale,
  arg_min(quality_reason, w.ts) FILTER (WHERE quality = 'INSUFFICIENT_EVIDENCE') AS why_ins,
  arg_min(quality_reason, w.ts) FILTER (WHERE quality = 'PARTIAL') AS why_partial,
  count(DISTINCT coalesce(source_quality, '')) AS kinds, min(source_quality) AS sq,
  string_agg(projection_id, ',' ORDER BY w.ts) AS ids
FROM grid g LEFT JOIN (SELECT *, {bucket_sql("ts", 3600)} AS b FROM judged
  WHERE ts >= TIMESTAMP '{PARTIAL_EDGES.start}' AND ts + INTERVAL 300 SECOND <= TIMESTAMP '{PARTIAL_EDGES.end}') w
  ON w.scope_id = g.scope_id AND w.b = g.bucket_start GROUP BY 1, 2, 3""",
    ),
)
def primitive_ratio(t: Tables):
    from vigilmesh.functions import quality

    rows = native_rows(t)
    rows = rows.withColumn(
        "quality", quality.native_quality(F.col("source_quality"), F.col("source_coverage"))
    ).withColumn("quality_reason", quality.native_reason(F.col("source_quality"), F.col("source_coverage")))
    return rollup.primitive_ratio_series(rows, t.cities, PARTIAL_EDGES).select(
        "scope_id", iso(F.col("bucket_start")).alias("bucket_start"), num("value"),
        num("coverage"), "quality", "null_reason", "quality_reason", "received_slots",
        "source_quality",
        F.expr("CASE WHEN received_slots > 0 THEN array_join(projection_ids, ',') END").alias("projection_ids"),
    )


def producer_oracle(request: rollup.Request) -> str:
    b = request_bounds(request.start, request.end, request.resolution)
    s = b["seconds"]
    e = s // 300
    return sql(
        f"""
SELECT scope_id, {fmt("bucket_start")} AS bucket_start, partial, n AS numerator, d AS denominator,
  {num_sql('100 * n::DOUBLE / nullif(d, 0)')} AS value,
  CASE WHEN received = 0 THEN 'NO_SOURCE_SLOTS' WHEN d = 0 THEN 'ZERO_DENOMINATOR' END AS null_reason,
  received AS received_slots, {num_sql(f'received / {e}.0::DOUBLE')} AS coverage,
  CASE WHEN received = 0 THEN 'MISSING' ELSE ['VALID','PARTIAL','INSUFFICIENT_EVIDENCE','STALE','MISSING'][
    CAST(greatest(worst, CASE WHEN received < {e} THEN 1 ELSE 0 END, CASE WHEN d = 0 THEN 2 ELSE 0 END) AS INT) + 1]
    END AS quality,
  CASE WHEN received = 0 THEN 'NO_SOURCE_SLOTS' WHEN d = 0 AND worst < 2 THEN 'ZERO_DENOMINATOR'
    WHEN received < {e} AND worst < 1 THEN 'MISSING_SOURCE_SLOTS' WHEN worst > 0 THEN why END AS quality_reason
FROM sums""",
        "city5m",
        "cities",
        native=NATIVE_SQL,
        judged=NATIVE_QUALITY_SQL,
        ranked="""
SELECT *, CASE quality WHEN 'VALID' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'INSUFFICIENT_EVIDENCE' THEN 2
  WHEN 'STALE' THEN 3 ELSE 4 END AS rank FROM judged""",
        grid=grid_sql("cities", request),
        sums=f"""
SELECT g.scope_id, g.bucket_start,
  g.bucket_start < TIMESTAMP '{request.start}' OR g.bucket_end > TIMESTAMP '{request.end}' AS partial,
  CAST(sum(numerator) AS BIGINT) AS n, CAST(sum(denominator) AS BIGINT) AS d, count(w.ts) AS received,
  max(rank) AS worst, first(quality_reason ORDER BY rank DESC, w.ts) AS why
FROM grid g LEFT JOIN (SELECT *, {bucket_sql("ts", s)} AS b FROM ranked
  WHERE ts >= TIMESTAMP '{request.start}' AND ts + INTERVAL 300 SECOND <= TIMESTAMP '{request.end}') w
  ON w.scope_id = g.scope_id AND w.b = g.bucket_start GROUP BY 1, 2, 3""",
    )


def register_producer(name: str, request: rollup.Request):
    @query(name, producer_oracle(request))
    def build(t: Tables):
        return rollup.producer_rollup(native_rows(t), t.cities, request).select(
            "scope_id", iso(F.col("bucket_start")).alias("bucket_start"), "partial", "numerator", "denominator",
            num("value"), "null_reason", "received_slots",
            num("coverage"), "quality", "quality_reason",
        )


for _resolution in policies.RESOLUTIONS:
    register_producer(
        f"agg_12_producer_rollup_{_resolution}",
        rollup.Request("2026-09-10 09:25:00", "2026-10-10 08:40:00", _resolution),
    )


@query(
    "agg_14_whole_slot_inclusion",
    sql(
        """
SELECT scope_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2026-09-12 09:02:00'
    AND ts + INTERVAL 300 SECOND <= TIMESTAMP '2026-09-30 10:03:00') AS whole_slots,
  count(*) FILTER (WHERE ts + INTERVAL 300 SECOND > TIMESTAMP '2026-09-12 09:02:00'
    AND ts < TIMESTAMP '2026-09-30 10:03:00') AS touched_slots
FROM city_facts GROUP BY scope_id""",
        "city_facts",
    ),
)
def whole_slots(t: Tables):
    lo, hi = rollup.ts_lit("2026-09-12 09:02:00"), rollup.ts_lit("2026-09-30 10:03:00")
    end = shift(F.col("ts"), 300)
    return t.city_facts.groupBy("scope_id").agg(
        F.count_if((F.col("ts") >= lo) & (end <= hi)).alias("whole_slots"),
        F.count_if((end > lo) & (F.col("ts") < hi)).alias("touched_slots"),
    )


@query(
    "agg_23_mixed_version_guard",
    sql(
        """
SELECT scope_id, min(policy) AS policy_lo, max(policy) AS policy_hi, count(*) AS rows_seen
FROM (SELECT scope_id, CASE WHEN slot % 8640 = 8635 AND scope_id IN ('C1','C4') THEN 'v2' ELSE 'v1' END AS policy
  FROM revisions) GROUP BY scope_id HAVING min(policy) <> max(policy)""",
        "revisions",
    ),
)
def version_guard(t: Tables):
    windows = t.revisions.withColumn(
        "policy", F.expr("CASE WHEN slot % 8640 = 8635 AND scope_id IN ('C1','C4') THEN 'v2' ELSE 'v1' END")
    )
    return rollup.mixed_versions(windows, ["scope_id"], ["policy"]).withColumnRenamed("rows", "rows_seen")
