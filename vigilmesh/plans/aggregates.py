"""Summaries, percentiles, baselines and evaluation counts: AGG-15…28."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.adapters import ARCHIVE_END, ARCHIVE_START, Tables
from vigilmesh.functions.arithmetic import nearest_rank, percent
from vigilmesh.functions.fingerprint import identity
from vigilmesh.functions.timebins import shift
from vigilmesh.operators import baseline, evaluation, primitives, ranks, summaries
from vigilmesh.operators.asof import asof_join, latest_at
from vigilmesh.operators.rollup import ts_lit
from vigilmesh.oracle_views import sql
from vigilmesh.plans.common import num, num_sql, when, when_sql
from vigilmesh.plans.rollups import quantile_sql
from vigilmesh.registry import query

def day():
    return F.date_format("ts", "yyyy-MM-dd")


DAY_SQL = "strftime(ts, '%Y-%m-%d')"

# -- AGG-15 -----------------------------------------------------------------------------------------


@query(
    "agg_15_scope_rollup_with_replay",
    sql(
        f"""
SELECT scope_id, CAST(count(*) FILTER (WHERE kinds = 1) AS BIGINT) AS present_slots,
  CAST(sum(copies - kinds) AS BIGINT) AS duplicate_inputs, count(*) FILTER (WHERE kinds > 1) AS conflicting_slots,
  CAST(sum(n) FILTER (WHERE kinds = 1) AS BIGINT) AS numerator,
  CAST(sum(d) FILTER (WHERE kinds = 1) AS BIGINT) AS denominator,
  {num_sql("100.0::DOUBLE * sum(n) FILTER (WHERE kinds = 1) / sum(d) FILTER (WHERE kinds = 1)")} AS value,
  {num_sql("count(*) FILTER (WHERE kinds = 1) / 8640.0::DOUBLE")} AS slot_coverage
FROM (SELECT scope_id, slot, count(*) AS copies, count(DISTINCT (n, d)) AS kinds, max(n) AS n, max(d) AS d
  FROM offers GROUP BY 1, 2) GROUP BY scope_id""",
        "city_facts",
        offers="""
SELECT scope_id, slot, data_success AS n, data_attempts AS d FROM city_facts
UNION ALL SELECT scope_id, slot, data_success, data_attempts FROM city_facts WHERE slot % 17 = 0
UNION ALL SELECT scope_id, slot, data_success - 1, data_attempts FROM city_facts WHERE slot % 997 = 0""",
    ),
)
def scope_rollup(t: Tables):
    base = t.city_facts.select(
        "scope_id", "slot", F.col("data_success").alias("numerator"), F.col("data_attempts").alias("denominator")
    )
    offers = base.unionByName(base.where("slot % 17 = 0")).unionByName(
        base.where("slot % 997 = 0").withColumn("numerator", F.col("numerator") - 1)
    )
    rolled = primitives.replay_safe_ratio(offers, ["scope_id"], "slot", expected_slots=8640)
    return rolled.select(
        "scope_id", "present_slots", "duplicate_inputs", "conflicting_slots", "numerator", "denominator",
        num("value"), num("slot_coverage"),
    )


# -- AGG-16…20 --------------------------------------------------------------------------------------

_SUMS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in summaries.CITY_SUMS if not c.endswith("_seconds")
)
_POOL = {
    name: "[" + ", ".join(f"CAST(sum({column}[{i + 1}]) AS BIGINT)" for i in range(9)) + "]"
    for name, column in (("voice", "voice_setup_hist"), ("sms", "sms_delay_hist"))
}


@query(
    "agg_16_city_summary_per_day",
    sql(
        f"""
SELECT d.period, voice_attempts, voice_success, voice_drops, sms_submitted, sms_delivered, sms_expired, row_count,
  slot_count, {num_sql("100.0::DOUBLE * voice_success / nullif(voice_attempts, 0)")} AS voice_sr,
  {num_sql("100.0::DOUBLE * voice_drops / nullif(voice_success, 0)")} AS drop_rate,
  {num_sql("holding / 1000.0::DOUBLE / (slot_count * 300)")} AS erlang,
  {num_sql("setup / 1000.0::DOUBLE / nullif(voice_success, 0)")} AS setup_mean_seconds,
  {num_sql(quantile_sql("voice", policies.VOICE_EDGES))} AS setup_p95_seconds,
  {num_sql(f"({quantile_sql('sms', policies.SMS_EDGES)}) * 1000")} AS sms_p95_ms,
  {num_sql("100.0::DOUBLE * sms_delivered / nullif(sms_delivered + sms_expired, 0)")} AS sms_sr,
  {num_sql("100.0::DOUBLE * data_success / nullif(data_attempts, 0)")} AS data_sr,
  {num_sql("100.0::DOUBLE * dns_success / nullif(dns_attempts, 0)")} AS dns_sr,
  {num_sql("100.0::DOUBLE * ho_success / nullif(ho_attempts, 0)")} AS ho_sr,
  {num_sql("user_throughput_mbps::DOUBLE / row_count")} AS throughput_mbps,
  CASE WHEN lo = hi THEN queue END AS queue, CASE WHEN lo = hi THEN oldest END AS oldest,
  CASE WHEN lo = hi THEN {when_sql("hi")} END AS snapshot_at, {num_sql("row_count / 2880.0::DOUBLE")} AS coverage,
  CASE WHEN lo <> hi OR row_count < 2880 THEN 'PARTIAL' ELSE 'VALID' END AS quality,
  CASE WHEN lo <> hi THEN 'SNAPSHOT_MISALIGNED' WHEN row_count < 2880 THEN 'PARTIAL_COVERAGE' END AS null_reason
FROM d JOIN n ON n.period = d.period""",
        "city5m",
        d=f"""
SELECT {DAY_SQL} AS period, {_SUMS}, sum(holding_ms) AS holding, sum(setup_ms) AS setup, count(*) AS row_count,
  count(DISTINCT ts) AS slot_count, {_POOL["voice"]} AS voice, {_POOL["sms"]} AS sms FROM city5m GROUP BY 1""",
        n=f"""
SELECT period, CAST(sum(sms_queue) AS BIGINT) AS queue, max(sms_oldest_seconds) AS oldest, min(ts) AS lo, max(ts) AS hi
FROM (SELECT {DAY_SQL} AS period, * FROM city5m
  QUALIFY row_number() OVER (PARTITION BY {DAY_SQL}, city_id ORDER BY ts DESC) = 1) GROUP BY 1""",
    ),
)
def city_summary(t: Tables):
    s = summaries.city_summary(t.city5m, day(), expected_rows=2880)
    plain = ["period", "voice_attempts", "voice_success", "voice_drops", "sms_submitted", "sms_delivered",
             "sms_expired", "row_count", "slot_count", "queue", "oldest", "quality", "null_reason"]
    rates = ["voice_sr", "drop_rate", "erlang", "setup_mean_seconds", "setup_p95_seconds", "sms_p95_ms", "sms_sr",
             "data_sr", "dns_sr", "ho_sr", "throughput_mbps", "coverage"]
    return s.select(*plain, *[num(r) for r in rates], when("snapshot_at"))


@query(
    "agg_17_link_snapshots_over_time",
    sql(
        f"""
SELECT link_id, {when_sql("at_ts")} AS at_ts,
  CASE WHEN quality <> 'MISSING' THEN {num_sql("traffic_gbps")} END AS traffic_gbps,
  CASE WHEN quality <> 'MISSING' THEN age END AS age_seconds,
  CASE WHEN quality = 'VALID' THEN {num_sql("100.0::DOUBLE * traffic_gbps::DOUBLE / cap::DOUBLE")} END AS utilization_pct,
  quality, CASE WHEN outside THEN 'OUTSIDE_DATASET' WHEN ts IS NULL THEN 'NO_OBSERVATIONS'
    WHEN age > 600 THEN 'STALE_SOURCE' WHEN cap IS NULL THEN 'MISSING_CAPACITY' END AS null_reason
FROM (SELECT *, CASE WHEN outside OR ts IS NULL THEN 'MISSING' WHEN age > 600 THEN 'STALE'
    WHEN cap IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'VALID' END AS quality
  FROM (SELECT p.link_id, p.at_ts, f.ts, f.traffic_gbps, CASE WHEN f.slot % 50 <> 3 THEN f.effective_capacity_gbps END
      AS cap, CAST(epoch(p.at_ts) - epoch(f.ts) AS BIGINT) AS age,
      p.at_ts < TIMESTAMP '{ARCHIVE_START}' OR p.at_ts >= TIMESTAMP '{ARCHIVE_END}' AS outside
    FROM probes p ASOF LEFT JOIN link5m f ON f.link_id = p.link_id AND p.at_ts >= f.ts))""",
        "link5m",
        probes=f"""
SELECT 'L' || l AS link_id, at_ts FROM range(12) t(l), (SELECT unnest(generate_series(
  TIMESTAMP '{ARCHIVE_START}' - INTERVAL 1 HOUR, TIMESTAMP '{ARCHIVE_END}' + INTERVAL 1 HOUR, INTERVAL 20 MINUTE)) AS at_ts)""",
    ),
)
def link_snapshots(t: Tables):
    probes = t.spark.range(12).select(
        F.expr("concat('L', id)").alias("link_id"),
        F.explode(F.expr(
            f"sequence(timestamp'{ARCHIVE_START}' - interval 1 hour, timestamp'{ARCHIVE_END}' + interval 1 hour, "
            "interval 20 minutes)"
        )).alias("at_ts"),
    )
    facts = t.link5m.withColumn(
        "effective_capacity_gbps", F.expr("CASE WHEN slot % 50 <> 3 THEN effective_capacity_gbps END")
    )
    joined = asof_join(probes, facts, ["link_id"], "at_ts", "ts", ["traffic_gbps", "effective_capacity_gbps"])
    snap = summaries.link_snapshot(
        joined, F.col("found"), F.col("at_ts"), ts_lit(ARCHIVE_START), ts_lit(ARCHIVE_END),
        policies.SNAPSHOT_MAX_AGE_SECONDS,
    )
    return snap.select("link_id", when("at_ts"), num("traffic_gbps"), "age_seconds", num("utilization_pct"), "quality",
                       "null_reason")


_PROC = ", ".join(
    f"{num_sql(f'100.0::DOUBLE * sum({p}_success) / nullif(sum({p}_attempts), 0)')} AS {p}_sr"
    for p in summaries.PROCEDURES
)


@query(
    "agg_18_roaming_summary",
    sql(
        f"""
SELECT country_id, CASE WHEN NOT apart THEN users END AS users,
  CASE WHEN NOT stale AND NOT apart THEN allocated END AS allocated_users, reg_sr, data_sr, voice_sr, sms_sr,
  CASE WHEN stale THEN 'STALE' WHEN apart THEN 'PARTIAL' ELSE 'VALID' END AS quality,
  CASE WHEN stale THEN 'STALE_SOURCE' WHEN apart THEN 'SNAPSHOT_MISALIGNED' END AS null_reason
FROM (SELECT r.country_id, {_PROC} FROM roam5m r GROUP BY 1) JOIN
 (SELECT country_id, CAST(sum(active_users) AS BIGINT) AS users,
   CAST(sum(floor(active_users * 0.37::DOUBLE + 0.5::DOUBLE)) AS BIGINT) AS allocated,
   bool_or(epoch(TIMESTAMP '{ARCHIVE_END}') - epoch(ts) > 86400) AS stale,
   min(ts) <> max(ts) AND NOT bool_or(epoch(TIMESTAMP '{ARCHIVE_END}') - epoch(ts) > 86400) AS apart
  FROM (SELECT * FROM roam5m QUALIFY row_number() OVER (PARTITION BY partner_id, direction ORDER BY ts DESC) = 1)
  GROUP BY 1) USING (country_id)""",
        "roam5m",
    ),
)
def roaming_summary(t: Tables):
    s = summaries.roaming_summary(t.roam5m, ts_lit(ARCHIVE_END), city_share=0.37, max_age=86_400)
    return s.select("country_id", "users", "allocated_users", *[num(f"{p}_sr") for p in summaries.PROCEDURES],
                    "quality", "null_reason")


@query(
    "agg_19_link_utilization",
    sql(
        f"""
SELECT link_id, period, valid_seconds,
  CASE WHEN valid_seconds > 0 THEN {num_sql("use_time / valid_seconds")} END AS mean_pct, {num_sql("peak")} AS peak_pct,
  CASE WHEN valid_seconds > 0 THEN {num_sql("traffic_time / valid_seconds")} END AS traffic_mean_gbps,
  {num_sql("valid_seconds / 86400.0::DOUBLE")} AS coverage,
  CASE WHEN valid_seconds = 0 THEN CASE WHEN stale THEN 'STALE' ELSE 'INSUFFICIENT_DATA' END
    WHEN valid_seconds < 86400 THEN 'PARTIAL' ELSE 'VALID' END AS quality,
  CASE WHEN valid_seconds = 0 THEN CASE WHEN stale THEN 'STALE_SOURCE' ELSE 'MISSING_CAPACITY' END
    WHEN valid_seconds < 86400 THEN 'PARTIAL_COVERAGE' END AS null_reason
FROM (SELECT link_id, {DAY_SQL} AS period, CAST(coalesce(sum(300) FILTER (WHERE slot % 9 <> 4), 0) AS BIGINT) AS valid_seconds,
  sum(CAST(traffic_gbps AS DOUBLE) * 300) FILTER (WHERE slot % 9 <> 4) AS traffic_time,
  sum(100.0::DOUBLE * traffic_gbps::DOUBLE / effective_capacity_gbps::DOUBLE * 300) FILTER (WHERE slot % 9 <> 4) AS use_time,
  max(100.0::DOUBLE * traffic_gbps::DOUBLE / effective_capacity_gbps::DOUBLE) FILTER (WHERE slot % 9 <> 4) AS peak,
  bool_or(slot % 9 = 4) AS stale FROM link5m GROUP BY 1, 2)""",
        "link5m",
    ),
)
def link_utilization(t: Tables):
    segments = t.link5m.select(
        "link_id", day().alias("period"), "traffic_gbps", "effective_capacity_gbps",
        F.lit(300).alias("valid_seconds"), F.expr("CASE WHEN slot % 9 = 4 THEN 'STALE' ELSE 'VALID' END").alias("quality"),
    )
    u = summaries.utilization(segments, ["link_id", "period"], 86_400)
    return u.select("link_id", "period", "valid_seconds", num("mean_pct"), num("peak_pct"), num("traffic_mean_gbps"),
                    num("coverage"), "quality", "null_reason")


@query(
    "agg_20_queue_balance",
    sql(
        f"""
SELECT city_id, slot, ok AS balanced, CASE WHEN ok THEN closing - opening END AS growth,
  CASE WHEN ok THEN {num_sql("(closing - opening) / 300.0::DOUBLE")} END AS growth_per_second,
  CASE WHEN ok THEN {num_sql("100.0::DOUBLE * sms_delivered / nullif(sms_delivered + sms_expired, 0)")} END
    AS finalized_success_pct,
  CASE WHEN NOT ok THEN 'INVALID_INPUT' WHEN sms_delivered + sms_expired = 0 THEN 'INSUFFICIENT_DATA' ELSE 'VALID' END AS quality
FROM (SELECT *, closing = opening + sms_submitted - sms_delivered - sms_expired AS ok FROM (
  SELECT *, sms_queue AS opening, sms_queue + sms_submitted - sms_delivered - sms_expired
    + CASE WHEN slot % 13 = 0 THEN 1 ELSE 0 END AS closing FROM city5m))""",
        "city5m",
    ),
)
def queue_balance(t: Tables):
    rows = t.city5m.selectExpr(
        "city_id", "slot", "sms_queue AS opening", "sms_submitted AS submitted", "sms_delivered AS delivered",
        "sms_expired AS negative",
        "sms_queue + sms_submitted - sms_delivered - sms_expired + CASE WHEN slot % 13 = 0 THEN 1 ELSE 0 END AS closing",
        "300 AS duration_seconds",
    )
    return summaries.queue_balance(rows).select(
        "city_id", "slot", "balanced", "growth", num("growth_per_second"), num("finalized_success_pct"), "quality")


# -- AGG-21, 22 -------------------------------------------------------------------------------------


@query(
    "agg_21_nearest_rank_of_arrays",
    """
SELECT event_id, CAST(len(a) AS INT) AS samples,
  CASE WHEN len(a) > 0 THEN list_sort(a)[CAST((len(a) * 95 + 99) // 100 AS INT)] END AS p95
FROM (SELECT event_id, list_transform(range(1, 1 + event_id % 41),
  lambda i: (event_id * i * 37 + CAST(round(value * 100) AS BIGINT)) % 30000) AS a FROM events)""",
)
def array_rank(t: Tables):
    delays = F.expr(
        "CASE WHEN event_id % 41 = 0 THEN array() ELSE transform(sequence(1L, event_id % 41), "
        "i -> (event_id * i * 37 + CAST(round(value * 100) AS BIGINT)) % 30000) END"
    )
    rows = t.events.select("event_id", delays.cast("array<bigint>").alias("a"))
    return rows.select("event_id", F.size("a").alias("samples"), nearest_rank(F.col("a")).alias("p95"))


def rank_oracle(group: str, value: str, percents: list[int], source: str) -> str:
    picks = ", ".join(f"max(v) FILTER (WHERE rn = ({p} * n + 99) // 100) AS p{p}" for p in percents)
    return f"""
SELECT {group}, max(n) AS samples, min(v) AS min, max(v) AS max, {picks}
FROM (SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {group}) AS n
  FROM (SELECT *, {value} AS v FROM {source})) GROUP BY {group}"""


@query(
    "agg_21_nearest_rank_grouped_hourly",
    rank_oracle("scope_id, hour", "CAST(round(value * 100) AS BIGINT)", [95],
                "(SELECT *, 'S' || (user_id % 10) AS scope_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events)"),
)
def grouped_rank(t: Tables):
    rows = t.events.selectExpr(
        "concat('S', user_id % 10) AS scope_id", "date_format(ts, 'yyyy-MM-dd HH') AS hour",
        "CAST(round(value * 100) AS BIGINT) AS v",
    )
    return ranks.nearest_ranks(rows, ["scope_id", "hour"], "v", [95])


@query(
    "agg_22_latency_percentiles_per_stage",
    rank_oracle("stage", "CAST(round(l_extendedprice * 100) AS BIGINT)", [50, 95, 99],
                "(SELECT *, l_returnflag || l_linestatus AS stage FROM lineitem)"),
)
def stage_percentiles(t: Tables):
    rows = t.raw("lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) AS stage", "CAST(round(l_extendedprice * 100) AS BIGINT) AS v")
    return ranks.nearest_ranks(rows, ["stage"], "v", [50, 95, 99])


# -- AGG-24…26, JON-9, JON-10 -----------------------------------------------------------------------

TRAIN_TO = "2026-10-01 09:00:00"

SAMPLES_SQL = """
SELECT metric_id, scope_id, ts AS from_ts, ts + INTERVAL 300 SECOND AS to_ts,
  100.0::DOUBLE * sum(n) / nullif(sum(d), 0) AS value, 1.0::DOUBLE AS coverage, sum(d) >= 100 AS eligible
FROM (SELECT 'mobileData.activation.success' AS metric_id, 'Z' || (CAST(substr(city_id, 2) AS INT) % 2) AS scope_id,
    ts, data_success AS n, data_attempts AS d FROM city5m
  UNION ALL SELECT 'volte.setup.success', 'Z' || (CAST(substr(city_id, 2) AS INT) % 2), ts, voice_success, voice_attempts
    FROM city5m
  UNION ALL SELECT 'roaming.registration.success', direction, ts, reg_success, reg_attempts FROM roam5m)
GROUP BY metric_id, scope_id, ts"""

LOCAL_SQL = """
  CAST((hour(l) * 60 + minute(l)) // 5 AS INT) AS slot,
  CASE WHEN isodow(l) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END AS weekday_class, CAST(l AS DATE) AS local_date"""
# The civil offset of Europe/Chisinau in the archive's range is three hours (summer time).
LOCAL_OF = "from_ts + INTERVAL 3 HOUR AS l"
NOT_EXCLUDED = "NOT EXISTS (SELECT 1 FROM exclusions e WHERE s.from_ts < e.to_ts AND e.from_ts < s.to_ts)"

FIT_VIEWS = {
    "samples": SAMPLES_SQL,
    "usable": f"""
SELECT *, {LOCAL_SQL} FROM (SELECT *, {LOCAL_OF} FROM samples s WHERE from_ts >= TIMESTAMP '{ARCHIVE_START}'
  AND to_ts <= TIMESTAMP '{TRAIN_TO}' AND eligible AND value IS NOT NULL AND {NOT_EXCLUDED})""",
    "daily": """
SELECT metric_id, scope_id, slot, weekday_class, local_date, median(value) AS v, count(*) AS n FROM usable GROUP BY ALL""",
    "centers": """
SELECT metric_id, scope_id, slot, weekday_class, median(v) AS center, CAST(sum(n) AS BIGINT) AS sample_count,
  count(*) AS distinct_days FROM daily GROUP BY ALL""",
    "calendar": f"""
SELECT slot, weekday_class, count(DISTINCT local_date) AS expected_days FROM (SELECT {LOCAL_SQL} FROM (
  SELECT *, {LOCAL_OF} FROM (SELECT g AS from_ts, g + INTERVAL 300 SECOND AS to_ts FROM (SELECT unnest(generate_series(
    TIMESTAMP '{ARCHIVE_START}', TIMESTAMP '{TRAIN_TO}' - INTERVAL 300 SECOND, INTERVAL 300 SECOND)) AS g)) s
  WHERE {NOT_EXCLUDED})) GROUP BY ALL""",
    "cells": """
SELECT c.*, m.mad, k.expected_days, c.distinct_days / k.expected_days::DOUBLE AS coverage
FROM centers c JOIN calendar k USING (slot, weekday_class)
JOIN (SELECT d.metric_id, d.scope_id, d.slot, d.weekday_class, median(abs(v - center)) AS mad
  FROM daily d JOIN centers USING (metric_id, scope_id, slot, weekday_class) GROUP BY ALL) m
  USING (metric_id, scope_id, slot, weekday_class)
WHERE c.distinct_days >= 3 AND c.distinct_days / k.expected_days::DOUBLE >= 0.9""",
}


def samples(t: Tables):
    zone = F.concat(F.lit("Z"), F.substring("city_id", 2, 2).cast("int") % 2)
    return (
        baseline.rate_samples(t.city5m, "mobileData.activation.success", zone, "data_success", "data_attempts")
        .unionByName(
            baseline.rate_samples(t.city5m, "volte.setup.success", zone, "voice_success", "voice_attempts"))
        .unionByName(
            baseline.rate_samples(
                t.roam5m, "roaming.registration.success", F.col("direction"), "reg_success", "reg_attempts"))
    )


def exclusions(t: Tables):
    return t.exclusions.select(F.col("from_ts").alias("e_from"), F.col("to_ts").alias("e_to"), "reason")


def fitted(t: Tables):
    return baseline.fit(samples(t), exclusions(t), ARCHIVE_START, TRAIN_TO)


@query(
    "agg_24_seasonal_fit",
    sql(
        f"""
SELECT metric_id, scope_id, slot, weekday_class, {num_sql("center")} AS center, {num_sql("mad")} AS mad, sample_count,
  distinct_days, expected_days, {num_sql("coverage")} AS coverage FROM cells""",
        "city5m", "roam5m", "exclusions", **FIT_VIEWS,
    ),
)
def seasonal_fit(t: Tables):
    return fitted(t).select("metric_id", "scope_id", "slot", "weekday_class", num("center"), num("mad"), "sample_count",
                            "distinct_days", "expected_days", num("coverage"))


@query(
    "agg_24_seasonal_sample_accounting",
    sql(
        f"""
SELECT metric_id, count(*) AS sample_count, count(*) FILTER (WHERE x) AS excluded_count,
  count(*) FILTER (WHERE NOT x AND value IS NULL) AS missing_count,
  count(*) FILTER (WHERE NOT x AND value IS NOT NULL AND NOT eligible) AS invalid_count,
  count(*) FILTER (WHERE NOT x AND value IS NOT NULL AND eligible) AS accepted_count
FROM (SELECT *, NOT ({NOT_EXCLUDED}) AS x FROM samples s WHERE from_ts >= TIMESTAMP '{ARCHIVE_START}'
  AND to_ts <= TIMESTAMP '{TRAIN_TO}') GROUP BY 1""",
        "city5m", "roam5m", "exclusions", samples=SAMPLES_SQL,
    ),
)
def accounting(t: Tables):
    return baseline.sample_accounting(samples(t), exclusions(t), ARCHIVE_START, TRAIN_TO)


@query(
    "agg_25_training_samples",
    sql(
        f"""
SELECT metric_id, scope_id, {when_sql("from_ts")} AS from_ts, {num_sql("value")} AS value, eligible FROM samples""",
        "city5m", "roam5m", samples=SAMPLES_SQL,
    ),
)
def training_samples(t: Tables):
    return samples(t).select("metric_id", "scope_id", when("from_ts"), num("value"), "eligible")


@query(
    "agg_26_hour_of_week_lookup",
    sql(
        f"""
SELECT k.scope_id, {when_sql("k.window_start")} AS window_start, k.how AS hour_of_week, k.attempts, p.baseline_attempts
FROM (SELECT *, CAST((isodow(window_start) - 1) * 24 + hour(window_start) AS INT) AS how FROM kpi_hour) k
LEFT JOIN (SELECT scope_id, CAST((isodow(window_start) - 1) * 24 + hour(window_start) AS INT) AS how,
    max(attempts) AS baseline_attempts FROM kpi_hour WHERE window_start < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2) p
  USING (scope_id, how)""",
        "kpi_hour",
    ),
)
def week_lookup(t: Tables):
    from vigilmesh.functions.timebins import hour_of_week

    profile = (
        t.kpi_hour.where("window_start < timestamp'2024-01-15 00:00:00'")
        .groupBy("scope_id", hour_of_week(F.col("window_start")).alias("hour_of_week"))
        .agg(F.max("attempts").alias("baseline_attempts"))
    )
    return baseline.hour_of_week_lookup(t.kpi_hour, profile).select(
        "scope_id", when("window_start"), "hour_of_week", "attempts", "baseline_attempts")


@query(
    "jon_09_exclusion_anti_join",
    sql(
        f"""
SELECT metric_id, scope_id, {when_sql("from_ts")} AS from_ts, {num_sql("value")} AS value FROM samples s
WHERE {NOT_EXCLUDED}""",
        "city5m", "roam5m", "exclusions", samples=SAMPLES_SQL,
    ),
)
def exclusion_anti(t: Tables):
    return baseline.drop_excluded(samples(t), exclusions(t)).select("metric_id", "scope_id", when("from_ts"), num("value"))


@query(
    "jon_10_baseline_lookup_chain",
    sql(
        f"""
SELECT w.metric_id, w.scope_id, {when_sql("w.from_ts")} AS window_start,
  CASE WHEN o.center IS NOT NULL THEN 'DIRECT' WHEN q.center IS NOT NULL THEN 'PEER'
    WHEN w.metric_id IN ('mobileData.activation.success', 'roaming.registration.success') THEN 'STATIC'
    ELSE 'BASELINE_UNAVAILABLE' END AS baseline_status,
  {num_sql("coalesce(o.center, q.center, CASE WHEN w.metric_id IN ('mobileData.activation.success', 'roaming.registration.success') THEN 99.0::DOUBLE END)")} AS center
FROM (SELECT *, {LOCAL_SQL} FROM (SELECT *, {LOCAL_OF} FROM samples WHERE from_ts >= TIMESTAMP '{TRAIN_TO}')) w
LEFT JOIN part_cells o ON o.metric_id = w.metric_id AND o.scope_id = w.scope_id AND o.slot = w.slot
  AND o.weekday_class = w.weekday_class
LEFT JOIN part_cells q ON q.metric_id = w.metric_id AND w.scope_id = 'Z1' AND q.scope_id = 'Z0' AND q.slot = w.slot
  AND q.weekday_class = w.weekday_class""",
        "city5m", "roam5m", "exclusions", **FIT_VIEWS,
        part_cells="SELECT * FROM cells WHERE (scope_id <> 'Z1' OR slot % 2 = 0) AND scope_id <> 'in'",
    ),
)
def lookup_chain(t: Tables):
    cells = fitted(t).where("(scope_id <> 'Z1' OR slot % 2 = 0) AND scope_id <> 'in'")
    windows = samples(t).where(F.col("from_ts") >= ts_lit(TRAIN_TO)).select(
        "metric_id", "scope_id", F.col("from_ts").alias("window_start"))
    peers = t.spark.createDataFrame([("Z1", "Z0")], "scope_id string, peer_id string")
    static = t.spark.createDataFrame(
        [(m, policies.BASELINE["static_center"]) for m in policies.STATIC_CENTER_METRICS],
        "metric_id string, static_center double",
    )
    return baseline.lookup_chain(windows, cells, peers, static).select(
        "metric_id", "scope_id", when("window_start"), "baseline_status", num("center"))


# -- AGG-27, 28 -------------------------------------------------------------------------------------

_COUNTS = """count(*) FILTER (WHERE truth = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE truth = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE truth = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE truth = 1 AND prediction = 0) AS fn"""
_RATES = f"""tp, fp, tn, fn, {num_sql("tp::DOUBLE / nullif(tp + fp, 0)")} AS precision,
  {num_sql("tp::DOUBLE / nullif(tp + fn, 0)")} AS recall, {num_sql("2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)")} AS f1,
  {num_sql("1000.0::DOUBLE * fp / nullif(fp + tn, 0)")} AS fp_per_1000"""
RATE_COLUMNS = ["precision", "recall", "f1", "fp_per_1000"]


@query("agg_27_confusion_and_rates", sql(f"SELECT {_RATES} FROM (SELECT {_COUNTS} FROM classified)", "classified"))
def confusion(t: Tables):
    rows = t.classified
    counted = rows.agg(*evaluation.confusion(F.col("truth") == 1, F.col("prediction") == 1))
    return evaluation.rates(counted).select("tp", "fp", "tn", "fn", *[num(c) for c in RATE_COLUMNS])


@query(
    "agg_28_sliced_rates_grouping_sets",
    sql(
        f"""
SELECT slice, slice_value, {_RATES} FROM (
  SELECT 'ALL' AS slice, 'ALL' AS slice_value, {_COUNTS} FROM classified
  UNION ALL SELECT 'family', family, {_COUNTS} FROM classified GROUP BY family
  UNION ALL SELECT 'profile', profile, {_COUNTS} FROM classified GROUP BY profile)""",
        "classified",
    ),
)
def sliced(t: Tables):
    rows = evaluation.sliced(t.classified, F.col("truth") == 1, F.col("prediction") == 1, ["family", "profile"])
    return rows.select("slice", "slice_value", "tp", "fp", "tn", "fn", *[num(c) for c in RATE_COLUMNS])


@query(
    "agg_28_macro_recall",
    sql(
        f"""
SELECT count(*) AS slices, {num_sql("avg(r)")} AS macro_recall FROM (SELECT family,
  sum(CASE WHEN truth = 1 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN truth = 1 THEN 1 ELSE 0 END) AS r
  FROM classified GROUP BY family HAVING sum(CASE WHEN truth = 1 THEN 1 ELSE 0 END) > 0)""",
        "classified",
    ),
)
def macro_recall(t: Tables):
    rows = evaluation.sliced(t.classified, F.col("truth") == 1, F.col("prediction") == 1, ["family"])
    per = rows.where("slice = 'family' AND recall IS NOT NULL")
    return per.agg(F.count("*").alias("slices"), F.avg("recall").alias("macro_recall")).select("slices", num("macro_recall"))
