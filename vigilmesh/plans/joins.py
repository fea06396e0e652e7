"""Join queries that need only archive tables: JON-1, 3…8, 12, 16, 17."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmesh.adapters import ARCHIVE_END, ARCHIVE_START, Tables, slot_ts as at_slot
from vigilmesh.dictionary import METRICS, dictionary_df, policy_of
from vigilmesh.functions.timebins import shift
from vigilmesh.operators.asof import asof_join, latest_at
from vigilmesh.operators.intervals import coverage_of_ranges, interval_join
from vigilmesh.operators.rollup import bucket_grid, latest_revision, ts_lit
from vigilmesh.oracle_views import slot_ts, sql
from vigilmesh.plans.common import num, num_sql, when, when_sql
from vigilmesh.registry import query


@query(
    "jon_01_window_coverage_left_join",
    sql(
        """
SELECT w.scope_id, w.slot, w.numerator, w.topology, c.usable
FROM w LEFT JOIN c ON c.scope_id = w.scope_id AND c.slot = w.slot AND c.topology = w.topology AND c.catalogue = w.catalogue""",
        "revisions",
        "city5m",
        w="""
SELECT *, 'v' || (slot % 3) AS topology, 'g' || (slot % 2) AS catalogue FROM revisions
QUALIFY row_number() OVER (PARTITION BY scope_id, slot ORDER BY revision DESC) = 1""",
        c="""
SELECT city_id AS scope_id, slot, 'v' || (slot % 3 % 2) AS topology, 'g' || (slot % 2) AS catalogue,
  sms_delivered AS usable FROM city5m WHERE slot % 4 <> 0""",
    ),
)
def window_coverage(t: Tables):
    windows = latest_revision(t.revisions, ("scope_id", "slot")).selectExpr(
        "scope_id", "slot", "numerator", "concat('v', slot % 3) AS topology", "concat('g', slot % 2) AS catalogue")
    coverage = t.city5m.where("slot % 4 <> 0").selectExpr(
        "city_id AS scope_id", "slot", "concat('v', slot % 3 % 2) AS topology", "concat('g', slot % 2) AS catalogue",
        "sms_delivered AS usable")
    return windows.join(coverage, ["scope_id", "slot", "topology", "catalogue"], "left").drop("catalogue")


_BUCKETS = "SELECT scope_id, window_start, count(*) AS accepted FROM obs GROUP BY 1, 2"
_SERVICE = "EXISTS (SELECT 1 FROM obs r WHERE r.scope_id = b.scope_id AND r.window_start = b.window_start AND r.kind = 'SERVICE')"


def _buckets(t: Tables):
    return t.obs.groupBy("scope_id", "window_start").agg(F.count("*").alias("accepted"))


@query(
    "jon_03_due_windows_semi_join",
    sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, accepted FROM b WHERE {_SERVICE}", "obs", b=_BUCKETS),
)
def due_windows(t: Tables):
    service = t.obs.where("kind = 'SERVICE'").select("scope_id", "window_start")
    return _buckets(t).join(service, ["scope_id", "window_start"], "left_semi").select(
        "scope_id", when("window_start"), "accepted")


@query(
    "jon_04_windows_without_service_anti_join",
    sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, accepted FROM b WHERE NOT {_SERVICE}", "obs", b=_BUCKETS),
)
def missing_windows(t: Tables):
    service = t.obs.where("kind = 'SERVICE'").select("scope_id", "window_start")
    return _buckets(t).join(service, ["scope_id", "window_start"], "left_anti").select(
        "scope_id", when("window_start"), "accepted")


@query(
    "jon_05_latest_fact_at_instant",
    sql(
        f"""
SELECT scope_id, {when_sql("max(ts)")} AS snapshot_at, arg_max(active_users, ts) AS active_users, arg_max(rtt_ms, ts) AS rtt_ms
FROM roam_facts WHERE ts <= {slot_ts("5003")} GROUP BY scope_id""",
        "roam_facts",
    ),
)
def at_instant(t: Tables):
    found = latest_at(t.roam_facts, ["scope_id"], "ts", ts_lit(ARCHIVE_START) + F.expr("INTERVAL 1500900 SECONDS"),
                      ["active_users", "rtt_ms"])
    return found.select("scope_id", when(F.col("found.ts"), "snapshot_at"), "found.active_users", "found.rtt_ms")


@query(
    "jon_06_opening_closing_per_bucket",
    sql(
        f"""
SELECT g.scope_id, {when_sql("g.bucket_start")} AS bucket_start, o.sms_queue AS opening_queue, c.sms_queue AS closing_queue,
  {when_sql("c.ts")} AS closing_at
FROM g LEFT JOIN city_facts o ON o.scope_id = g.scope_id AND o.ts = g.bucket_start - INTERVAL 300 SECOND
ASOF LEFT JOIN city_facts c ON c.scope_id = g.scope_id AND g.bucket_end > c.ts""",
        "city_facts", "cities",
        g=f"""
SELECT scope_id, b AS bucket_start, b + INTERVAL 1 HOUR AS bucket_end FROM cities, (SELECT unnest(generate_series(
  TIMESTAMP '{ARCHIVE_START}', TIMESTAMP '{ARCHIVE_END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS b)""",
    ),
)
def opening_closing(t: Tables):
    from datetime import datetime

    grid = bucket_grid(t.cities, datetime.fromisoformat(ARCHIVE_START), datetime.fromisoformat(ARCHIVE_END), 3600)
    grid = grid.withColumn("bucket_end", shift(F.col("bucket_start"), 3600))
    facts = t.city_facts.select("scope_id", "ts", "sms_queue")
    closing = asof_join(grid, facts, ["scope_id"], "bucket_end", "ts", ["sms_queue"], inclusive=False)
    closing = closing.withColumnRenamed("found", "closing")
    both = asof_join(closing, facts, ["scope_id"], "bucket_start", "ts", ["sms_queue"], inclusive=False)
    fresh = F.unix_seconds("bucket_start") - F.unix_seconds("found.ts") <= 300
    return both.select(
        "scope_id", when("bucket_start"), F.when(fresh, F.col("found.sms_queue")).alias("opening_queue"),
        F.col("closing.sms_queue").alias("closing_queue"), when(F.col("closing.ts"), "closing_at"))


@query(
    "jon_07_valid_time_capacity_join",
    sql(
        f"""
SELECT f.link_id, f.slot, i.nominal_gbps, {num_sql("100.0::DOUBLE * f.traffic_gbps::DOUBLE / i.nominal_gbps")} AS nominal_utilization
FROM link5m f JOIN link_inventory i ON i.link_id = f.link_id AND i.valid_from <= f.ts AND i.valid_to >= f.ts + INTERVAL 300 SECOND""",
        "link5m", "link_inventory",
    ),
)
def valid_time(t: Tables):
    j = interval_join(t.link5m, t.link_inventory, ["link_id"], F.col("ts"), shift(F.col("ts"), 300), "valid_from", "valid_to")
    use = F.col("traffic_gbps").cast("double") * 100 / F.col("nominal_gbps")
    return j.select(t.link5m["link_id"], "slot", "nominal_gbps", num(use, "nominal_utilization"))


@query(
    "jon_08_validity_range_coverage",
    sql(
        f"""
SELECT link_id, bool_or(lo <= {slot_ts("100")} AND hi >= {slot_ts("8500")}) AS covered, CAST(sum(overlap_rows) AS BIGINT) AS overlap_rows,
  count(*) AS islands
FROM (SELECT link_id, island, min(valid_from) AS lo, max(valid_to) AS hi, count(*) FILTER (WHERE valid_from < reach) AS overlap_rows
  FROM (SELECT *, sum(CASE WHEN reach IS NULL OR valid_from > reach THEN 1 ELSE 0 END) OVER (PARTITION BY link_id ORDER BY valid_from, valid_to) AS island
    FROM (SELECT *, max(valid_to) OVER (PARTITION BY link_id ORDER BY valid_from, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM link_inventory)) GROUP BY 1, 2) GROUP BY 1""",
        "link_inventory",
    ),
)
def range_coverage(t: Tables):
    lo = F.expr(at_slot("100"))
    hi = F.expr(at_slot("8500"))
    return coverage_of_ranges(t.link_inventory, ["link_id"], lo, hi)


@query(
    "src_09_valid_time_violations",
    sql(
        f"""
SELECT f.link_id, f.slot FROM link5m f WHERE NOT EXISTS (SELECT 1 FROM link_inventory i WHERE i.link_id = f.link_id
  AND i.valid_from <= f.ts AND i.valid_to >= f.ts + INTERVAL 300 SECOND)""",
        "link5m", "link_inventory",
    ),
)
def violations(t: Tables):
    return interval_join(
        t.link5m.select("link_id", "slot", "ts"), t.link_inventory, ["link_id"], F.col("ts"), shift(F.col("ts"), 300),
        "valid_from", "valid_to", "left_anti",
    ).select("link_id", "slot")


@query(
    "jon_12_labels_features_full_join",
    """
SELECT d.lang IS NULL AS no_feature, count(*) AS pairs,
  count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled_features, count(*) FILTER (WHERE d.doc_id IS NULL) AS labels_without_features,
  count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS joined
FROM labels l FULL JOIN (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, lang FROM documents) d ON d.doc_id = l.doc_id GROUP BY 1""",
)
def labels_features(t: Tables):
    # Every row takes part: a third has its key shifted out of the labels' range.
    features = t.raw("documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS d_id", "lang")
    labels = t.raw("labels").select(F.col("doc_id").alias("l_id"))
    j = labels.join(features, labels.l_id == features.d_id, "full")
    return j.groupBy(F.col("lang").isNull().alias("no_feature")).agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("l_id").isNull()).alias("unlabelled_features"),
        F.count_if(F.col("d_id").isNull()).alias("labels_without_features"),
        F.count_if(F.col("l_id").isNotNull() & F.col("d_id").isNotNull()).alias("joined"),
    )


_DICT_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{d}', '{u}', '{a}', '{policy_of(m)}')" for m, d, u, a, *_ in METRICS
) + ") t(metric_id, domain, unit, aggregation_type, policy_version)"

_CLAIMS_SQL = """
SELECT city_id AS scope_id, slot, CASE WHEN slot % 43 = 0 THEN 'sms.unknown' ELSE m END AS metric_id,
  CASE WHEN slot % 41 = 0 THEN 'PERCENT' ELSE 'COUNT' END AS unit, CASE WHEN slot % 59 = 0 THEN 'kpi-v0' ELSE 'kpi-v1' END AS policy_version
FROM city5m, (SELECT unnest(['sms.submitted', 'sms.delivered', 'volte.attempts']) AS m)"""


@query(
    "jon_16_metric_dictionary_lookup",
    sql(
        """
SELECT c.scope_id, c.slot, c.metric_id, d.aggregation_type, CASE WHEN d.metric_id IS NULL THEN 'UNKNOWN_METRIC'
  WHEN d.unit <> c.unit THEN 'UNIT_MISMATCH' WHEN d.policy_version <> c.policy_version THEN 'POLICY_MISMATCH' END AS reason
FROM claims c LEFT JOIN dict d ON d.metric_id = c.metric_id""",
        "city5m", dict=_DICT_SQL, claims=_CLAIMS_SQL,
    ),
)
def dictionary_lookup(t: Tables):
    from vigilmesh.operators.validation import against_dictionary

    claims = t.city5m.select(
        F.col("city_id").alias("scope_id"), "slot",
        F.explode(F.array(*[F.lit(m) for m in ("sms.submitted", "sms.delivered", "volte.attempts")])).alias("m"),
    ).selectExpr(
        "scope_id", "slot", "CASE WHEN slot % 43 = 0 THEN 'sms.unknown' ELSE m END AS metric_id",
        "CASE WHEN slot % 41 = 0 THEN 'PERCENT' ELSE 'COUNT' END AS unit",
        "CASE WHEN slot % 59 = 0 THEN 'kpi-v0' ELSE 'kpi-v1' END AS policy_version")
    return against_dictionary(claims, dictionary_df(t.spark)).select(
        "scope_id", "slot", "metric_id", "aggregation_type", "reason")


@query(
    "jon_17_scope_slot_grid",
    sql(
        f"""
SELECT g.scope_id, count(*) AS slots, count(f.slot) AS present, count(*) - count(f.slot) AS absent
FROM (SELECT scope_id, s AS slot FROM cities, range(8640) r(s)) g LEFT JOIN city_facts f ON f.scope_id = g.scope_id AND f.slot = g.slot
GROUP BY g.scope_id""",
        "city_facts", "cities",
    ),
)
def scope_grid(t: Tables):
    grid = t.cities.select("scope_id", F.explode(F.expr("sequence(0L, 8639L)")).alias("slot"))
    present = t.city_facts.select("scope_id", "slot", F.lit(1).alias("here"))
    return grid.join(present, ["scope_id", "slot"], "left").groupBy("scope_id").agg(
        F.count("*").alias("slots"), F.count("here").alias("present"),
        (F.count("*") - F.count("here")).alias("absent"))
