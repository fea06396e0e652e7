"""Sources, ingestion quality and minute windows: SRC, STR-1…12, STR-22, STR-23, JON-2."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vigilmesh.adapters import ARCHIVE_END, ARCHIVE_START, Tables, slot_ts as at_slot
from vigilmesh.dictionary import dictionary_df
from vigilmesh.functions.fingerprint import content_fingerprint, identity
from vigilmesh.functions.leakage import json_has_truth
from vigilmesh import policies
from vigilmesh.operators import domain_contract, ingest, retention, validation, windows
from vigilmesh.operators.rollup import ts_lit
from vigilmesh.oracle_views import slot_ts, sql
from vigilmesh.plans.common import num, num_sql, when, when_sql
from vigilmesh.plans import rollups  # noqa: F401  (its series are exported here)
from vigilmesh.registry import QUERIES, query
from vigilmesh.sources import archive, labelled, observations, series_csv, sinks

LO, HI = f"TIMESTAMP '{ARCHIVE_START}'", f"TIMESTAMP '{ARCHIVE_END}'"

# -- SRC-1…8 ----------------------------------------------------------------------------------------


def city_lines(t: Tables):
    hist = "concat('\"{', array_join(%s, ','), '}\"')"
    return t.city5m.selectExpr(
        "concat_ws(',', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), city_id, "
        "CASE WHEN slot % 101 = 0 THEN 'x' ELSE CAST(voice_attempts AS STRING) END, voice_success, voice_drops, "
        "voice_holding_seconds, 0, voice_setup_elapsed_seconds, " + hist % "voice_setup_hist" + ", sms_submitted, "
        "sms_delivered, sms_expired, sms_queue, sms_oldest_seconds, " + hist % "sms_delay_hist" + ", data_attempts, "
        "data_success, dns_attempts, dns_success, user_throughput_mbps, ho_attempts, ho_success) AS line"
    )


@query(
    "src_01_native_csv_rows",
    sql(
        """
SELECT city_id, count(*) AS row_count, count(*) FILTER (WHERE slot % 101 = 0) AS corrupt_rows,
  CAST(sum(voice_attempts) FILTER (WHERE slot % 101 <> 0) AS BIGINT) AS voice_attempts, CAST(sum(list_sum(sms_delay_hist)) AS BIGINT) AS pooled
FROM city5m GROUP BY 1""",
        "city5m",
    ),
)
def native_csv(t: Tables):
    rows = archive.parse_lines(city_lines(t), "line", "city_kpi_5m.csv")
    return rows.groupBy("city_id").agg(
        F.count("*").alias("row_count"),
        F.count("_corrupt").alias("corrupt_rows"),
        F.sum("voice_attempts").alias("voice_attempts"),
        F.sum(F.aggregate("sms_delay_hist", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("pooled"),
    )


@query(
    "src_02_histogram_text",
    sql("SELECT city_id, slot, CASE WHEN slot % 71 = 0 THEN NULL ELSE list_sum(voice_setup_hist)::BIGINT END AS total, "
        "CASE WHEN slot % 71 = 0 THEN NULL ELSE voice_setup_hist[9] END AS last_bin FROM city5m", "city5m"),
)
def histogram_text(t: Tables):
    text = F.expr("concat('{', array_join(voice_setup_hist, ','), CASE WHEN slot % 71 = 0 THEN ',' ELSE '}' END)")
    rows = t.city5m.select("city_id", "slot", archive.parse_histogram(text).alias("h"))
    return rows.select(
        "city_id", "slot", F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.element_at("h", 9).alias("last_bin"))


@query(
    "src_03_inventory_lines",
    """
SELECT 'P' || s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS partner_id FROM supplier""",
)
def inventory_lines(t: Tables):
    lines = t.raw("supplier").selectExpr("concat_ws(',', concat('P', s_suppkey), s_name, s_nationkey) AS line")
    return archive.parse_lines(lines, "line", "countries.csv").select("id", "name", "partner_id")


@query(
    "src_04_archive_completeness",
    sql(
        f"""
SELECT c.scope_id, count(f.ts) AS row_count, CAST(8640 AS BIGINT) AS expected_slots, 8640 - count(f.ts) AS missing_slots,
  {when_sql("min(f.ts)")} AS first_ts, {when_sql("max(f.ts)")} AS last_ts, count(f.ts) = 8640 AS complete
FROM (SELECT scope_id FROM cities UNION ALL SELECT scope_id FROM links UNION ALL SELECT scope_id FROM partners) c
LEFT JOIN (SELECT scope_id, ts FROM city_facts UNION ALL SELECT scope_id, ts FROM link_facts UNION ALL SELECT scope_id, ts FROM roam_facts) f
  ON f.scope_id = c.scope_id GROUP BY 1""",
        "city_facts", "link_facts", "roam_facts", "cities", "links", "partners",
    ),
)
def completeness(t: Tables):
    scopes = t.cities.unionByName(t.links).unionByName(t.partners.select("scope_id"))
    rows = [f.select("scope_id", "ts") for f in (t.city_facts, t.link_facts, t.roam_facts)]
    report = archive.completeness(rows[0].unionByName(rows[1]).unionByName(rows[2]), scopes, 8640)
    return report.select("scope_id", "row_count", "expected_slots", "missing_slots", when("first_ts"), when("last_ts"), "complete")


@query(
    "src_04_manifest_row_counts",
    sql(
        """
SELECT file, row_count, manifest_rows, row_count IS NOT DISTINCT FROM manifest_rows AS matches FROM (
  SELECT 'city' AS file, count(*) AS row_count, CAST(86400 AS BIGINT) AS manifest_rows FROM city5m
  UNION ALL SELECT 'link', count(*), 103680 FROM link5m
  UNION ALL SELECT 'regions', count(*), 5 FROM region
  UNION ALL SELECT 'absent', NULL, 7)""",
        "city5m", "link5m",
    ),
)
def manifest_counts(t: Tables):
    counts = None
    for name, df in (("city", t.city5m), ("link", t.link5m), ("regions", t.raw("region"))):
        one = df.agg(F.count("*").alias("row_count")).withColumn("file", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    manifest = t.spark.createDataFrame(
        [("city", 86400), ("link", 103680), ("regions", 5), ("absent", 7)], "file string, manifest_rows bigint")
    return archive.manifest_check(counts, manifest)


MAX = validation.MAX_COUNTER
_PAIRS = {"city": ("voice", "data", "dns", "ho"), "roam": ("reg", "data", "voice", "sms")}


def _time_rules() -> str:
    return f"WHEN ts IS NULL THEN 'MALFORMED' WHEN epoch(ts)::BIGINT % 300 <> 0 THEN 'UNALIGNED' WHEN ts < {LO} OR ts >= {HI} THEN 'OUT_OF_BOUNDS'"


def _counter_rules(*names: str) -> str:
    return " ".join(f"WHEN {n} IS NULL OR {n} < 0 OR {n} > {MAX} THEN 'COUNTER_RANGE:{n}'" for n in names)


def _amount_rules(*names: str) -> str:
    return " ".join(f"WHEN {n} IS NULL OR {n} < 0 THEN 'NEGATIVE:{n}'" for n in names)


def _subset_rules(pairs) -> str:
    return " ".join(f"WHEN {p}_success > {p}_attempts THEN 'SUCCESS_EXCEEDS_ATTEMPTS:{p}'" for p in pairs)


def _both(pairs) -> list[str]:
    return [f"{p}_{part}" for p in pairs for part in ("attempts", "success")]


def _histogram_rules(name: str, cohort: str, label: str) -> str:
    return f"""WHEN {name} IS NULL OR len({name}) <> 9 THEN 'HISTOGRAM_WIDTH:{label}'
  WHEN len([n FOR n IN {name} IF n IS NULL OR n < 0 OR n > {MAX}]) > 0 THEN 'HISTOGRAM_COUNT:{label}'
  WHEN list_sum({name}) <> {cohort} THEN 'HISTOGRAM_COHORT:{label}'"""


# Faults are injected in both engines by the same expressions; the rules below do not know where.
CITY_FAULTS = {
    "voice_success": "CASE WHEN slot % 71 = 0 THEN voice_attempts + 1 ELSE voice_success END",
    "data_success": "CASE WHEN slot % 73 = 0 THEN data_attempts + 1 WHEN slot % 101 = 0 THEN NULL ELSE data_success END",
    "sms_delivered": "CASE WHEN slot % 79 = 0 THEN sms_delivered + 1 ELSE sms_delivered END",
    "dns_attempts": "CASE WHEN slot % 103 = 0 THEN -10 ELSE dns_attempts END",
    "sms_queue": f"CASE WHEN slot % 107 = 0 THEN {MAX + 1} ELSE sms_queue END",
    "voice_setup_hist": "CASE WHEN slot % 109 = 0 THEN NULL ELSE voice_setup_hist END",
    "sms_oldest_seconds": "CASE WHEN slot % 113 = 0 THEN -1 WHEN slot % 127 = 0 THEN NULL ELSE sms_oldest_seconds END",
}
LINK_FAULTS = {
    "effective_capacity_gbps": "CASE WHEN slot % 83 = 0 THEN 0 WHEN slot % 97 = 0 THEN NULL ELSE effective_capacity_gbps END",
    "loss_pct": "CASE WHEN slot % 89 = 0 THEN 101 WHEN slot % 101 = 0 THEN NULL ELSE loss_pct END",
    "rtt_ms": "CASE WHEN slot % 103 = 0 THEN -1 ELSE rtt_ms END",
    "queue_drops": "CASE WHEN slot % 107 = 0 THEN NULL ELSE queue_drops END",
}
ROAM_FAULTS = {
    "country_id": "CASE WHEN slot % 83 = 0 THEN 'XX' WHEN slot % 97 = 0 THEN NULL ELSE country_id END",
    "direction": "CASE WHEN slot % 101 = 0 THEN NULL ELSE direction END",
    "reg_success": "CASE WHEN slot % 89 = 0 THEN reg_attempts + 1 ELSE reg_success END",
    "voice_attempts": "CASE WHEN slot % 103 = 0 THEN -1 WHEN slot % 107 = 0 THEN NULL ELSE voice_attempts END",
}


def _with_faults(faults: dict[str, str], table: str, time: str = "ts") -> str:
    replaced = ", ".join(f"{e} AS {c}" for c, e in ({"ts": time} | faults).items())
    return f"SELECT * REPLACE ({replaced}) FROM {table}"


def _time_faults(second: str, day: str) -> str:
    return f"CASE WHEN slot % 61 = 0 THEN ts + {second} WHEN slot % 67 = 0 THEN ts + {day} ELSE ts END"


@query(
    "src_05_native_city_rules",
    sql(
        f"""
SELECT city_id, slot, CASE {_time_rules()} {_counter_rules(*_both(_PAIRS["city"]), "voice_drops", "sms_submitted", "sms_delivered", "sms_expired", "sms_queue")}
  {_amount_rules("voice_holding_seconds", "voice_setup_elapsed_seconds", "sms_oldest_seconds", "user_throughput_mbps")}
  {_subset_rules(_PAIRS["city"])} WHEN voice_drops > voice_success THEN 'DROPS_EXCEED_SUCCESS'
  {_histogram_rules("voice_setup_hist", "voice_success", "voice")}
  {_histogram_rules("sms_delay_hist", "sms_delivered", "sms")} END AS reason FROM faulty""",
        "city5m",
        faulty=_with_faults(CITY_FAULTS, "city5m", _time_faults("INTERVAL 7 SECOND", "INTERVAL 60 DAY")),
    ),
)
def city_rules(t: Tables):
    faulty = t.city5m.withColumns({
        "ts": F.expr(_time_faults("interval 7 seconds", "interval 60 days")), **{c: F.expr(e) for c, e in CITY_FAULTS.items()}})
    return faulty.select("city_id", "slot", validation.native_city_reason(ts_lit(ARCHIVE_START), ts_lit(ARCHIVE_END)).alias("reason"))


@query(
    "src_05_native_link_and_roaming_rules",
    sql(
        f"""
SELECT link_id AS scope_id, slot, CASE {_time_rules()} WHEN effective_capacity_gbps IS NULL OR effective_capacity_gbps <= 0 THEN 'ABSENT_CAPACITY'
  WHEN loss_pct IS NULL OR loss_pct > 100 THEN 'INVALID_LOSS' {_amount_rules("traffic_gbps", "loss_pct", "rtt_ms", "jitter_ms")}
  {_counter_rules("interface_errors", "queue_drops")} END AS reason FROM bad_link
UNION ALL SELECT partner_id || coalesce(direction, ''), slot, CASE {_time_rules()}
  WHEN direction IS NULL OR direction NOT IN ('in', 'out') THEN 'UNKNOWN_DIRECTION'
  WHEN country_id IS NULL OR partner_id <> country_id || '-DEMO-01' THEN 'UNKNOWN_PARTNER'
  {_counter_rules("active_users", *_both(_PAIRS["roam"]))} {_amount_rules("rtt_ms")} {_subset_rules(_PAIRS["roam"])} END FROM bad_roam""",
        "link5m", "roam5m", bad_link=_with_faults(LINK_FAULTS, "link5m"), bad_roam=_with_faults(ROAM_FAULTS, "roam5m"),
    ),
)
def link_roaming_rules(t: Tables):
    lo, hi = ts_lit(ARCHIVE_START), ts_lit(ARCHIVE_END)
    link = t.link5m.withColumns({c: F.expr(e) for c, e in LINK_FAULTS.items()}).select(
        F.col("link_id").alias("scope_id"), "slot", validation.native_link_reason(lo, hi).alias("reason"))
    scope = F.concat("partner_id", F.coalesce("direction", F.lit(""))).alias("scope_id")
    roaming = t.roam5m.withColumns({c: F.expr(e) for c, e in ROAM_FAULTS.items()}).select(
        scope, "slot", validation.native_roaming_reason(lo, hi).alias("reason"))
    return link.unionByName(roaming)


@query(
    "src_06_row_provenance",
    sql(
        """
SELECT partner_id, direction, slot, sha256(concat_ws('|', 'archive-30d', 'ROAMING', partner_id, direction, country_id, partner_id, CAST(epoch(ts) AS BIGINT), 300)) AS natural_id,
  sha256(concat_ws('|', reg_attempts, reg_success, active_users)) AS row_checksum FROM roam5m""",
        "roam5m",
    ),
)
def provenance(t: Tables):
    c = F.col
    natural = archive.natural_id("archive-30d", "ROAMING", c("partner_id"), c("direction"), c("country_id"), c("partner_id"), c("ts"))
    return t.roam5m.select("partner_id", "direction", "slot", natural.alias("natural_id"),
                           identity(c("reg_attempts"), c("reg_success"), c("active_users")).alias("row_checksum"))


@query(
    "src_07_duplicate_identities",
    sql("SELECT source_id || scope_id || kind || CAST(epoch(window_start) AS BIGINT) AS natural_key, count(*) AS copies FROM obs_dup GROUP BY 1 HAVING count(*) > 1", "obs_dup"),
)
def duplicates(t: Tables):
    keyed = t.obs_dup.withColumn("natural_key", F.concat("source_id", "scope_id", "kind", F.unix_seconds("window_start")))
    return archive.duplicate_identities(keyed, "natural_key")


@query(
    "src_08_long_metric_windows",
    sql(
        f"""
SELECT domain, metric_id, scope_id, direction, {when_sql("ts")} AS bucket_start, {num_sql("n")} AS numerator, {num_sql("d")} AS denominator FROM (
SELECT 'VOLTE' AS domain, 'volte.setup.success' AS metric_id, city_id AS scope_id, '' AS direction, ts, voice_success::DOUBLE AS n, voice_attempts::DOUBLE AS d FROM city5m
UNION ALL SELECT 'TRANSPORT', 'transport.link.utilization', link_id, 'a-to-b', ts, traffic_gbps::DOUBLE, effective_capacity_gbps::DOUBLE FROM link5m
UNION ALL SELECT 'ROAMING', 'roaming.registration.success', partner_id, direction, ts, reg_success::DOUBLE, reg_attempts::DOUBLE FROM roam5m)""",
        "city5m", "link5m", "roam5m",
    ),
)
def long_windows(t: Tables):
    return archive.metric_windows(t.city5m, t.link5m, t.roam5m).select(
        "domain", "metric_id", "scope_id", "direction", when("bucket_start"), num("numerator"), num("denominator"))


_OFFERS = """
SELECT scope_id, slot, sha256(concat_ws('|', numerator, denominator)) AS content FROM revisions WHERE revision = 0
UNION ALL SELECT scope_id, slot, sha256(concat_ws('|', numerator, denominator)) FROM revisions WHERE revision = 1"""
_STORED = "SELECT scope_id, slot, sha256(concat_ws('|', numerator, denominator)) AS content FROM revisions WHERE revision = 0 AND slot % 3 <> 0"


@query(
    "src_10_immutable_append",
    sql(
        """
SELECT o.scope_id, o.slot, o.content, o.copies, CASE WHEN s.content IS NULL AND o.content = o.first_content THEN 'INSERT'
  WHEN s.content = o.content THEN 'REPLAY' ELSE 'CONFLICT' END AS action
FROM (SELECT *, min(content) OVER (PARTITION BY scope_id, slot) AS first_content FROM (SELECT scope_id, slot, content, count(*) AS copies FROM offers GROUP BY ALL)) o
LEFT JOIN stored s ON s.scope_id = o.scope_id AND s.slot = o.slot""",
        "revisions", offers=_OFFERS, stored=_STORED,
    ),
)
def immutable_append(t: Tables):
    hashed = t.revisions.select("scope_id", "slot", "revision", identity(F.col("numerator"), F.col("denominator")).alias("content"))
    stored = hashed.where("revision = 0 AND slot % 3 <> 0").select("scope_id", "slot", "content")
    return ingest.reconcile_append(hashed.drop("revision"), stored, ["scope_id", "slot"], "content")


# -- SRC-11…15, 18 ----------------------------------------------------------------------------------


def envelopes(t: Tables):
    """Observation documents as they would arrive, with one kind of fault per divisor of the id."""
    e = "event_id"
    doc = F.expr(f"""to_json(named_struct(
      'schemaVersion', 2, 'eventId', CAST({e} AS STRING),
      'sourceId', CASE WHEN {e} % 47 = 0 THEN 'src9' ELSE source_id END,
      'scopeId', CASE WHEN {e} % 43 = 0 THEN 'S99' ELSE scope_id END, 'kind', kind,
      'windowStart', window_start, 'windowEnd', window_end,
      'emittedAt', CASE WHEN {e} % 41 = 0 THEN window_start ELSE emitted_at END,
      'quality', CASE WHEN {e} % 37 = 0 THEN NULL ELSE quality END, 'service', service, 'nodeId', node_id,
      'metrics', CASE WHEN kind <> 'HEARTBEAT' THEN named_struct(
        'attempts', attempts + CASE WHEN {e} % 53 = 0 THEN 1 ELSE 0 END, 'technicalSuccesses', technical_successes,
        'technicalFailures', technical_failures, 'userOutcomes', user_outcomes, 'rrcAttempts', rrc_attempts,
        'rrcSuccesses', rrc_successes, 'bearerAttempts', bearer_attempts, 'bearerSuccesses', bearer_successes,
        'sip503Count', sip503_count, 'deliveryAttempts', delivery_attempts, 'deliverySuccesses', delivery_successes,
        'deliveredMessages', delivered_messages + CASE WHEN {e} % 53 = 0 THEN 1 ELSE 0 END, 'deliveryDelayMs', delivery_delay_ms,
        'cpuPct', cpu_pct, 'packetLossRatio', packet_loss_ratio, 'queueDepth', queue_depth,
        'oldestPendingAgeSeconds', CAST(oldest_pending_seconds AS DOUBLE)) END))""")
    rows = t.obs_metrics.select("event_id", "scope_id", "received_at", doc.alias("doc"))
    return rows.select(
        F.expr("CASE WHEN event_id % 59 = 0 THEN 'wrong' ELSE scope_id END").alias("key"),
        F.expr("CASE WHEN event_id % 31 = 0 THEN substring(doc, 1, length(doc) - 5) ELSE doc END").alias("payload"),
        "received_at", F.col("event_id").alias("arrival"))


REASON_SQL = """CASE WHEN event_id % 31 = 0 THEN 'MALFORMED_JSON' WHEN event_id % 37 = 0 THEN 'SCHEMA_INVALID'
  WHEN event_id % 41 = 0 THEN 'SEMANTIC_INVALID' WHEN event_id % 43 = 0 THEN 'SEMANTIC_INVALID'
  WHEN event_id % 47 = 0 THEN 'SOURCE_UNAUTHORIZED' WHEN kind = 'NODE' AND scope_id = 'S7' AND node_id = 'N2' THEN 'SOURCE_UNAUTHORIZED'
  WHEN event_id % 53 = 0 AND kind = 'SERVICE' THEN 'SEMANTIC_INVALID' WHEN event_id % 59 = 0 THEN 'KEY_MISMATCH' END"""


@query(
    "src_11_parsed_observations",
    sql(
        f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, scope_id, source_id, kind, service, node_id, {when_sql("window_start")} AS window_start, quality,
  attempts, CAST(len(delivery_delay_ms) AS INT) AS delay_samples, {num_sql("cpu_pct")} AS cpu_pct FROM (SELECT *, {REASON_SQL} AS reason FROM obs_metrics) WHERE reason IS NULL""",
        "obs_metrics",
    ),
)
def parsed(t: Tables):
    good, _ = validation.split(observations.validate(envelopes(t), t.catalogue))
    r = observations.receipts(good)
    return r.select("event_id", "scope_id", "source_id", "kind", "service", "node_id", when("window_start"), "quality",
                    "metrics.attempts", F.expr("CASE WHEN metrics.deliveryDelayMs IS NOT NULL THEN size(metrics.deliveryDelayMs) END").alias("delay_samples"),
                    num(F.col("metrics.cpuPct"), "cpu_pct"))


def register_rejections(name: str, reasons: list[str]):
    wanted = ", ".join(f"'{r}'" for r in reasons)

    @query(name, sql(
        f"SELECT event_id AS arrival, reason FROM (SELECT *, {REASON_SQL} AS reason FROM obs_metrics) WHERE reason IN ({wanted})",
        "obs_metrics"))
    def build(t: Tables):
        checked = observations.validate(envelopes(t), t.catalogue)
        return checked.where(F.col("reason").isin(*reasons)).select("arrival", "reason")


register_rejections("src_12_malformed_and_schema_rejections", ["MALFORMED_JSON", "SCHEMA_INVALID"])
register_rejections("src_13_semantic_rejections", ["SEMANTIC_INVALID"])
register_rejections("src_14_unauthorised_sources", ["SOURCE_UNAUTHORIZED"])
register_rejections("src_15_key_mismatches", ["KEY_MISMATCH"])


@query(
    "src_18_dead_letter_rows",
    sql(
        f"""
SELECT event_id AS arrival, reason AS reason_code, CASE WHEN event_id % 31 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id,
  CASE WHEN event_id % 59 = 0 THEN 'wrong' ELSE scope_id END AS message_key, FALSE AS payload_truncated
FROM (SELECT *, {REASON_SQL} AS reason FROM obs_metrics) WHERE reason IS NOT NULL""",
        "obs_metrics",
    ),
)
def dead_letters(t: Tables):
    _, bad = validation.split(observations.validate(envelopes(t), t.catalogue))
    return observations.dead_letters(bad).select(
        "arrival", "reason_code", F.when(F.col("reason_code") != "MALFORMED_JSON", F.col("event_id")).alias("event_id"),
        "message_key", "payload_truncated")


# -- SRC-16, 17 -------------------------------------------------------------------------------------

_LATE_SQL = "received_at >= window_end + INTERVAL 10 SECOND"
CLASSIFIED_SQL = f"""
SELECT d.*, CASE WHEN w.arrival = d.arrival THEN 'ACCEPTED'
  WHEN w.arrival < d.arrival AND w.event_id = d.event_id THEN CASE WHEN w.content_hash = d.content_hash THEN 'DUPLICATE' ELSE 'EVENT_ID_CONFLICT' END
  WHEN w.arrival < d.arrival THEN 'NATURAL_KEY_CONFLICT' ELSE 'LATE_OBSERVATION' END AS outcome
FROM obs_dup d LEFT JOIN (SELECT * FROM obs_dup WHERE NOT ({_LATE_SQL})
  QUALIFY row_number() OVER (PARTITION BY scope_id, source_id, kind, window_start ORDER BY arrival) = 1) w
  ON w.scope_id = d.scope_id AND w.source_id = d.source_id AND w.kind = d.kind AND w.window_start = d.window_start"""


def classified(t: Tables):
    return ingest.classify(t.obs_dup.withColumn("late", ingest.is_late()))


def accepted(t: Tables):
    """Accepted observations with their metrics, which follow from the delivery itself."""
    return t.with_metrics(classified(t).where("outcome = 'ACCEPTED'").drop("outcome", "late"))


ACCEPTED_SQL = f"SELECT m.* FROM obs_metrics m SEMI JOIN (SELECT event_id, amount FROM classified WHERE outcome = 'ACCEPTED') a ON a.event_id = m.event_id AND a.amount = m.amount"


@query("src_16_deduplicated_outcomes", sql("SELECT arrival, event_id, outcome FROM classified", "obs_dup", classified=CLASSIFIED_SQL))
def outcomes(t: Tables):
    return classified(t).select("arrival", "event_id", "outcome")


@query(
    "src_17_late_by_receipt_time",
    sql(f"SELECT scope_id, source_id, count(*) AS deliveries, count(*) FILTER (WHERE {_LATE_SQL}) AS late FROM obs_dup GROUP BY 1, 2", "obs_dup"),
)
def late(t: Tables):
    return t.obs_dup.withColumn("late", ingest.is_late()).groupBy("scope_id", "source_id").agg(
        F.count("*").alias("deliveries"), F.count_if("late").alias("late"))


# -- SRC-19, 20, 21 ---------------------------------------------------------------------------------

_MEASURE_SQL = """
SELECT city_id AS scope_id, slot, CASE WHEN slot % 97 = 0 THEN 'sms.other' ELSE 'mobileData.activation.success' END AS metric_id,
  CASE WHEN slot % 89 = 0 THEN 'MISSING' WHEN slot % 83 = 0 THEN 'PARTIAL' WHEN slot % 79 = 0 THEN 'STALE' ELSE 'VALID' END AS quality,
  CASE WHEN slot % 89 = 0 THEN 0.0 WHEN slot % 83 = 0 AND slot % 2 = 0 THEN 0.5 WHEN slot % 73 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage,
  CASE WHEN slot % 89 = 0 AND slot % 2 = 0 OR slot % 53 = 0 THEN NULL WHEN slot % 71 = 0 THEN data_attempts + 1 WHEN slot % 47 = 0 THEN -1 ELSE data_success END AS numerator,
  CASE WHEN slot % 89 = 0 AND slot % 2 = 0 OR slot % 106 = 0 THEN NULL WHEN slot % 67 = 0 THEN 0 ELSE data_attempts END AS denominator,
  CASE WHEN slot % 61 = 0 THEN 301 ELSE 300 END AS valid_seconds FROM city5m"""


@query(
    "src_19_domain_measurement_validation",
    sql(
        """
SELECT scope_id, slot, CASE WHEN metric_id = 'sms.other' THEN 'DICTIONARY' WHEN slot % 59 = 0 THEN 'PRIMITIVE_FIELDS'
  WHEN quality = 'MISSING' AND coverage <> 0 THEN 'MISSING_COVERAGE'
  WHEN quality = 'MISSING' AND (numerator IS NOT NULL OR denominator IS NOT NULL) THEN 'MISSING_WITH_EVIDENCE'
  WHEN quality = 'MISSING' THEN NULL WHEN coverage IS NULL OR coverage <= 0 THEN 'NO_COVERAGE'
  WHEN numerator IS NULL AND denominator IS NULL THEN 'NO_PRIMITIVES' WHEN (numerator IS NULL) <> (denominator IS NULL) THEN 'HALF_A_RATIO'
  WHEN numerator < 0 OR denominator < 0 THEN 'NEGATIVE'
  WHEN quality = 'VALID' AND coverage <> 1 THEN 'VALID_NEEDS_FULL_COVERAGE' WHEN quality = 'PARTIAL' AND coverage >= 1 THEN 'PARTIAL_NEEDS_PARTIAL_COVERAGE'
  WHEN numerator > denominator THEN 'SUCCESS_EXCEEDS_ATTEMPTS' WHEN denominator = 0 THEN 'ZERO_DENOMINATOR'
  WHEN valid_seconds > 300 THEN 'WEIGHT_EXCEEDS_DURATION' WHEN quality = 'STALE' THEN 'STALE_NEEDS_SNAPSHOT' END AS reason FROM m""",
        "city5m", m=_MEASURE_SQL,
    ),
)
def measurements(t: Tables):
    rows = t.city5m.selectExpr(
        "city_id AS scope_id", "slot", "CASE WHEN slot % 97 = 0 THEN 'sms.other' ELSE 'mobileData.activation.success' END AS metric_id",
        "'PERCENT' AS unit", "'kpi-v1' AS policy_version", "ts AS window_start", "ts + interval 5 minutes AS window_end",
        "CASE WHEN slot % 89 = 0 THEN 'MISSING' WHEN slot % 83 = 0 THEN 'PARTIAL' WHEN slot % 79 = 0 THEN 'STALE' ELSE 'VALID' END AS quality",
        "CASE WHEN slot % 89 = 0 THEN 0D WHEN slot % 83 = 0 AND slot % 2 = 0 THEN 0.5D WHEN slot % 73 = 0 THEN 0D ELSE 1D END AS coverage",
        "CASE WHEN slot % 89 = 0 AND slot % 2 = 0 OR slot % 53 = 0 THEN NULL WHEN slot % 71 = 0 THEN data_attempts + 1 WHEN slot % 47 = 0 THEN -1 ELSE data_success END AS numerator",
        "CASE WHEN slot % 89 = 0 AND slot % 2 = 0 OR slot % 106 = 0 THEN NULL WHEN slot % 67 = 0 THEN 0 ELSE data_attempts END AS denominator",
        "CASE WHEN slot % 61 = 0 THEN 301 ELSE 300 END AS valid_seconds", "CAST(NULL AS TIMESTAMP) AS snapshot_at",
        "CAST(NULL AS ARRAY<BIGINT>) AS histogram",
        "CASE WHEN slot % 59 = 0 THEN array('numerator') ELSE array('numerator', 'denominator') END AS field_names")
    joined = validation.against_dictionary(rows, dictionary_df(t.spark))
    return joined.select("scope_id", "slot", validation.measurement_reason().alias("reason"))


# One fault for each rule: which columns it changes, and the reason that the contract must give. The first is no fault.
_ANY_FAULTS = [
    ({}, None), ({"dataset_id": "CAST(NULL AS STRING)"}, "SCHEMA"), ({"quality": "'GOOD'"}, "SCHEMA"), ({"coverage": "1.5D"}, "SCHEMA"), ({"source_id": "CAST(NULL AS STRING)"}, "SCHEMA"),
    ({"window_start": "timestampadd(SECOND, 60, ts)", "window_end": "timestampadd(SECOND, 360, ts)", "emitted_at": "timestampadd(SECOND, 400, ts)"}, "UNALIGNED_INTERVAL"),
    ({"window_end": "timestampadd(SECOND, 600, ts)", "emitted_at": "timestampadd(SECOND, 700, ts)"}, "UNALIGNED_INTERVAL"), ({"emitted_at": "timestampadd(SECOND, 299, ts)"}, "EVENT_TIME"),
    ({"emitted_at": "timestamp'2030-01-01 00:00:00'"}, "EVENT_TIME"), ({"source_id": "'a|b'"}, "IDENTITY_DELIMITER"), ({"event_id": "'forged'"}, "IDENTITY"), ({"metric_id": "'none'"}, "UNKNOWN_METRIC"),
    ({"unit": "'MILES'"}, "DICTIONARY:unit"), ({"policy_version": "'kpi-v0'"}, "DICTIONARY:policy_version"), ({"aggregation_type": "'MEDIAN'"}, "AGGREGATION"),
    ({"primitives": "map('other', 1D)"}, "PRIMITIVE_FIELDS"), ({"scope_type": "'PLANET'"}, "SCOPE_TYPE"), ({"quality": "'MISSING'", "coverage": "0.5D"}, "MISSING_COVERAGE"),
    ({"quality": "'MISSING'", "coverage": "0D"}, "MISSING_WITH_EVIDENCE"), ({"coverage": "0D"}, "NO_COVERAGE"), ({"coverage": "0.5D"}, "VALID_NEEDS_FULL_COVERAGE"),
    ({"quality": "'PARTIAL'"}, "PARTIAL_NEEDS_PARTIAL_COVERAGE"), ({"quality": "'PARTIAL'", "coverage": "0.5D"}, None),
]
_RATIO_FAULTS = [
    ({"primitives": "map('numerator', 1D, 'denominator', CAST(NULL AS DOUBLE))"}, "NULL_PRIMITIVE"), ({"primitives": "map('numerator', -1D, 'denominator', 5D)"}, "NEGATIVE"),
    ({"primitives": "map('numerator', double('NaN'), 'denominator', 5D)"}, "NOT_FINITE"), ({"primitives": "map('numerator', 6D, 'denominator', 5D)"}, "SUCCESS_EXCEEDS_ATTEMPTS"),
    ({"primitives": "map('numerator', 0D, 'denominator', 0D)"}, "ZERO_DENOMINATOR"), ({"primitives": "map('numerator', 0D, 'denominator', 0D)", "quality": "'INSUFFICIENT_EVIDENCE'"}, None),
    ({"primitives": "map('numerator', CAST(NULL AS DOUBLE), 'denominator', CAST(NULL AS DOUBLE))", "quality": "'MISSING'", "coverage": "0D"}, None), ({"quality": "'STALE'"}, "STALE_NEEDS_SNAPSHOT"),
]
_TRANSPORT = "named_struct('valid_from', timestampadd(DAY, -1, ts), 'valid_to', timestampadd(DAY, 1, ts))"
_NO_TRANSPORT = "CAST(NULL AS STRUCT<valid_from: TIMESTAMP, valid_to: TIMESTAMP>)"
_HISTOGRAM = "named_struct('schema_version', {v}, 'unit', {u}, 'representation', {r}, 'edges', {e}, 'counts', {c})"
_HIST_PARTS = {"v": "'fixed-edges-v1'", "u": "'SECONDS'", "r": "'COUNTS'", "e": f"array({', '.join(f'{x}D' for x in policies.VOICE_EDGES)})", "c": "array(1L, 2L, 0L, 0L, 0L, 0L, 0L, 0L, bigint(slot))"}
_histogram = lambda **kw: _HISTOGRAM.format(**_HIST_PARTS | kw)
_NO_HISTOGRAM = "CAST(NULL AS STRUCT<schema_version: STRING, unit: STRING, representation: STRING, edges: ARRAY<DOUBLE>, counts: ARRAY<BIGINT>>)"
_WINDOW = {
    "dataset_id": "'archive'", "source_id": "'src'", "scope_namespace": "'reference'", "window_start": "ts", "window_end": "timestampadd(SECOND, 300, ts)", "emitted_at": "timestampadd(SECOND, 310, ts)",
    "source_resolution_seconds": "300", "schema_version": "'1'", "catalogue_version": "'c1'", "topology_version": "'t1'", "policy_version": "'kpi-v1'", "quality": "'VALID'", "coverage": "1D",
    **{c: "CAST(NULL AS STRING)" for c in domain_contract.SCOPE_FIELDS}, "snapshot_at": "CAST(NULL AS TIMESTAMP)", "at": "CAST(NULL AS TIMESTAMP)", "histogram": _NO_HISTOGRAM, "transport": _NO_TRANSPORT,
    "event_id": "CAST(NULL AS STRING)"}
_CITY = {"scope_type": "'CITY_SERVICE'", "scope_id": "key", "contract_city_id": "concat('K-', key)"}
_ROAM = {"domain": "'ROAMING'", "scope_type": "'ROAMING_PROCEDURE'", "scope_id": "'RO-DEMO-01'", "partner_id": "'RO-DEMO-01'", "country_id": "'RO'", "direction": "'in'"}
#: Windows of each kind: native table, its key, columns, and the faults of its own.
CONTRACTS = {
    "ratio": ("city5m", "city_id", {**_CITY, "domain": "'MOBILE_DATA'", "metric_id": "'mobileData.activation.success'", "unit": "'PERCENT'", "aggregation_type": "'RATIO_OF_SUMS'",
                                    "procedure": "'EPS_BEARER_ACTIVATION'", "access_technology": "'LTE'", "primitives": "map('numerator', 3D, 'denominator', double(5 + data_attempts))"},
              [*_RATIO_FAULTS, ({"domain": "'VOLTE'"}, "DICTIONARY:domain"), ({"contract_city_id": "CAST(NULL AS STRING)"}, "CITY_BINDING"), ({"procedure": "'DNS'"}, "PROCEDURE"), ({"procedure": "CAST(NULL AS STRING)"}, "PROCEDURE"),
               ({"access_technology": "'NR'"}, "ACCESS_TECHNOLOGY"), ({"link_id": "'L1'"}, "IRRELEVANT_FIELD:link_id"), ({"partner_id": "'P'"}, "IRRELEVANT_FIELD:partner_id"), ({"transport": _TRANSPORT}, "IRRELEVANT_FIELD:transport")]),
    "histogram": ("city5m", "city_id", {**_CITY, "domain": "'VOLTE'", "metric_id": "'volte.setup.p95'", "unit": "'SECONDS'", "aggregation_type": "'HISTOGRAM_P95'",
                                        "primitives": "CAST(map() AS MAP<STRING, DOUBLE>)", "histogram": _histogram()},
                  [({"histogram": _NO_HISTOGRAM}, "NULL_PRIMITIVE"), ({"histogram": _histogram(v="'v0'")}, "HISTOGRAM_SCHEMA"), ({"histogram": _histogram(u="'MILLISECONDS'")}, "HISTOGRAM_SCHEMA"),
                   ({"histogram": _histogram(e="array(0.5D, 1D)")}, "HISTOGRAM_EDGES"), ({"histogram": _histogram(e=_HIST_PARTS["e"].replace("60.0D", "61D"))}, "HISTOGRAM_EDGES"), ({"histogram": _histogram(c="array(1L)")}, "HISTOGRAM_COUNTS"),
                   ({"histogram": _histogram(c="array(-1L, 2L, 0L, 0L, 0L, 0L, 0L, 0L, 1L)")}, "HISTOGRAM_COUNTS"), ({"histogram": _histogram(c="array_repeat(0L, 9)")}, "EMPTY_HISTOGRAM"),
                   ({"histogram": _histogram(c="array_repeat(0L, 9)"), "quality": "'INSUFFICIENT_EVIDENCE'"}, None), ({"procedure": "'DNS'"}, "IRRELEVANT_FIELD:procedure")]),
    "weighted": ("link5m", "link_id", {"domain": "'TRANSPORT'", "scope_type": "'LINK_DIRECTION'", "scope_id": "key", "link_id": "key", "direction_id": "'a-to-b'", "transport": _TRANSPORT, "metric_id": "'transport.traffic'",
                                       "unit": "'GBPS'", "aggregation_type": "'TIME_WEIGHTED_MEAN'", "primitives": "map('weightedSum', 30D, 'validSeconds', 300D)"},
                 [({"link_id": "'other'"}, "TRANSPORT_SCOPE"), ({"direction_id": "CAST(NULL AS STRING)"}, "TRANSPORT_DIRECTION"), ({"transport": "named_struct('valid_from', timestampadd(SECOND, 1, ts), 'valid_to', timestampadd(DAY, 1, ts))"}, "CAPACITY_INTERVAL"),
                  ({"transport": "named_struct('valid_from', ts, 'valid_to', timestampadd(SECOND, 299, ts))"}, "CAPACITY_INTERVAL"), ({"transport": _NO_TRANSPORT}, "ABSENT_CAPACITY"),
                  ({"transport": _NO_TRANSPORT, "quality": "'INSUFFICIENT_EVIDENCE'"}, None), ({"primitives": "map('weightedSum', 30D, 'validSeconds', 0D)"}, "ZERO_WEIGHT"),
                  ({"primitives": "map('weightedSum', 30D, 'validSeconds', 301D)"}, "WEIGHT_EXCEEDS_DURATION"), ({"contract_city_id": "'C1'"}, "IRRELEVANT_FIELD:contract_city_id")]),
    "snapshot": ("roam5m", "partner_id", {**_ROAM, "metric_id": "'roaming.activeInbound'", "unit": "'COUNT'", "aggregation_type": "'SNAPSHOT_LAST'", "procedure": "'ACTIVE_USERS'",
                                          "primitives": "map('value', 7D)", "snapshot_at": "timestampadd(SECOND, 299, ts)"},
                 [({"snapshot_at": "timestampadd(SECOND, 300, ts)"}, "SAMPLE_OUTSIDE_WINDOW"), ({"snapshot_at": "timestampadd(SECOND, -1, ts)"}, "SAMPLE_OUTSIDE_WINDOW"), ({"snapshot_at": "timestampadd(SECOND, -1, ts)", "quality": "'STALE'"}, None),
                  ({"snapshot_at": "CAST(NULL AS TIMESTAMP)"}, "NULL_PRIMITIVE"), ({"direction": "'out'"}, "SNAPSHOT_DIRECTION"), ({"country_id": "'IT'"}, "ROAMING_PARTNER"), ({"scope_id": "'IT-DEMO-01'"}, "ROAMING_SCOPE"),
                  ({"country_id": "CAST(NULL AS STRING)"}, "ROAMING_DIMENSION"), ({"procedure": "'DATA'"}, "PROCEDURE"), ({"access_technology": "'LTE'"}, "IRRELEVANT_FIELD:access_technology")]),
}


def _faults(kind: str) -> list:
    """Those of every window that this kind can have, and its own."""
    own = {"histogram": ("primitives",), "snapshot": ()}.get(kind, ())
    return [f for f in _ANY_FAULTS if not set(f[0]) & set(own)] + CONTRACTS[kind][3]


def _contract_sql() -> str:
    parts = []
    for kind, (table, key, _, _) in CONTRACTS.items():
        reasons = ", ".join("NULL" if r is None else f"'{r}'" for _, r in _faults(kind))
        parts.append(f"SELECT '{kind}' AS kind, {key} AS key, slot, ([{reasons}])[CAST(slot % {len(_faults(kind))} AS INT) + 1] AS reason FROM {table}")
    return " UNION ALL ".join(parts)


@query("src_19_domain_window_contract", sql(_contract_sql(), "city5m", "link5m", "roam5m"))
def domain_windows(t: Tables):
    out = None
    for kind, (table, key, columns, _) in CONTRACTS.items():
        base, faults = {**_WINDOW, **columns}, _faults(kind)
        rows = getattr(t, table).withColumn("key", F.col(key)).withColumn("fault", F.expr(f"CAST(slot % {len(faults)} AS INT)"))
        changed = {}
        for name, plain in base.items():
            cases = "".join(f" WHEN {i} THEN {f[name]}" for i, (f, _) in enumerate(faults) if name in f)
            changed[name] = F.expr(f"CASE fault{cases} ELSE {plain} END" if cases else plain)
        rows = rows.select(F.lit(kind).alias("kind"), "key", "slot", "fault", *[v.alias(k) for k, v in changed.items()])
        forged = F.col("event_id").isNotNull()
        rows = rows.withColumn("event_id", F.when(forged, F.col("event_id")).otherwise(domain_contract.window_identity()))
        out = rows if out is None else out.unionByName(rows)
    return domain_contract.judged(out, ts_lit("2027-01-01 00:00:00")).select("kind", "key", "slot", "reason")


@query(
    "src_20_evidence_validation",
    sql(
        """
SELECT city_id AS scope_id, slot, CASE WHEN slot % 103 = 0 THEN 'SOURCE_AGE' WHEN slot % 101 = 0 THEN 'FRESHNESS_MISMATCH'
  WHEN slot % 97 = 0 THEN 'NUMERATOR_EXCEEDS_POPULATION' WHEN slot % 89 = 0 THEN 'ACTUAL_MISMATCH' WHEN slot % 83 = 0 THEN 'BASELINE_VERSION_MISSING'
  WHEN slot % 79 = 0 THEN 'DEVIATION_MISMATCH' WHEN slot % 73 = 0 THEN 'VALID_COVERAGE' WHEN slot % 71 = 0 THEN 'QUALITY_REASON' END AS reason FROM city5m""",
        "city5m",
    ),
)
def evidence(t: Tables):
    n = "CASE WHEN slot % 97 = 0 THEN data_attempts + 1 ELSE data_success END"
    rows = t.city5m.selectExpr(
        "city_id AS scope_id", "slot", "'RATIO' AS kind", f"{n} AS numerator", "data_attempts AS denominator", "'PERCENT' AS unit",
        f"100D * ({n}) / data_attempts + CASE WHEN slot % 89 = 0 THEN 0.001D ELSE 0D END AS actual", "99D AS baseline",
        "CASE WHEN slot % 83 = 0 THEN NULL ELSE 'seasonal-v1' END AS baseline_version",
        f"100D * ({n}) / data_attempts - 99D + CASE WHEN slot % 79 = 0 THEN 0.001D ELSE 0D END AS deviation",
        "CASE WHEN slot % 73 = 0 THEN 0.9D ELSE 1D END AS coverage", "'VALID' AS quality",
        "CASE WHEN slot % 71 = 0 THEN 'WHY' END AS quality_reason", "CASE WHEN slot % 101 = 0 THEN 'STALE' ELSE 'FRESH' END AS freshness",
        "ts AS observed_at", "ts + interval 5 minutes AS as_of", "CASE WHEN slot % 103 = 0 THEN 299 ELSE 300 END AS source_age_seconds",
        "600 AS max_age_seconds", "ts AS window_start", "ts + interval 5 minutes AS window_end")
    return rows.select("scope_id", "slot", validation.evidence_reason().alias("reason"))


@query(
    "src_21_truth_leakage_in_documents",
    "SELECT event_id, event_id % 5 IN (1, 2) AS leaks FROM events",
)
def leakage(t: Tables):
    doc = F.expr("""CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('{"a": ', props, ', "groundTruth": 1}')
      WHEN 2 THEN '{"x": [{"scenario_id": 3}]}' WHEN 3 THEN '{"expectedSeconds": 300, "note": "the expected outcome"}'
      ELSE '{"cpuPct": 4}' END""")
    return t.events.select("event_id", json_has_truth(doc).alias("leaks"))


# -- SRC-22…27 --------------------------------------------------------------------------------------


@query(
    "src_22_csv_export_lines",
    sql(
        f"""
SELECT '"' || city_id || '","' || {when_sql("ts")} || '","' || voice_attempts || '",' ||
  CASE WHEN slot % 3 = 0 THEN '' ELSE '"' || voice_drops || '"' END || ',"[' || array_to_string(list_transform(voice_setup_hist, lambda x: CAST(x AS VARCHAR)), ',') || ']"' AS line FROM city5m""",
        "city5m",
    ),
)
def csv_export(t: Tables):
    rows = t.city5m.select("city_id", when("ts"), "voice_attempts", F.expr("CASE WHEN slot % 3 <> 0 THEN voice_drops END").alias("drops"), "voice_setup_hist")
    return rows.select(sinks.csv_lines(rows).alias("line"))


def _cell(x: str) -> str:
    return f"""coalesce('"' || replace(CAST({x} AS VARCHAR), '"', '""') || '"', '')"""


_FIXED = {"datasetId": "archive", "domain": "VOLTE", "metric": "volte.setup.success", "scopeType": "CITY", "resolution": "1h", "unit": "PERCENT",
          "aggregation": "RATIO_OF_SUMS", "policyVersion": "kpi-v1", "topologyVersion": "t \"1\"", "sourceResolutionSeconds": 300, "synthetic": True, "partialStart": False,
          "partialEnd": False, "requestedFrom": datetime.fromisoformat(ARCHIVE_START), "requestedTo": datetime.fromisoformat(ARCHIVE_END), "expectedSlots": 12}
_POINT_SQL = {
    **{k: f"'{v}'" for k, v in _FIXED.items() if isinstance(v, str)}, "sourceResolutionSeconds": "300", "synthetic": "'true'", "partialStart": "'false'", "partialEnd": "'false'",
    "requestedFrom": f"'{ARCHIVE_START.replace(' ', 'T')}Z'", "requestedTo": f"'{ARCHIVE_END.replace(' ', 'T')}Z'", "expectedSlots": "12", "scopeId": "scope_id",
    "from": "replace(bucket_start, ' ', 'T') || 'Z'", "to": "strftime(CAST(bucket_start AS TIMESTAMP) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ')", "value": "CAST(value AS DECIMAL(20, 6))",
    "coverage": "CAST(coverage AS DECIMAL(20, 6))", "quality": "quality", "numerator": "numerator", "denominator": "denominator", "nullReason": "null_reason", "qualityReason": "quality_reason",
    "receivedSlots": "received_slots", "projectionIds": "'null'",
    "provenance": "CASE WHEN received_slots > 0 THEN '{\"kind\":\"stored\",\"reason\":' || coalesce('\"' || quality_reason || '\"', 'null') || '}' ELSE 'null' END",
    "histogramCounts": "CASE WHEN denominator > 0 THEN '[' || numerator || ',' || denominator || ']' ELSE 'null' END", "histogramEdges": "'null'"}


@query(
    "src_22_series_export_fixed_layout",
    f"SELECT scope_id, bucket_start, {' || chr(44) || '.join(_cell(_POINT_SQL.get(c, 'NULL')) for c in series_csv.COLUMNS)} AS line FROM ({QUERIES['agg_10_stored_ratio_series_full_grid'].oracle}) s",
)
def series_export(t: Tables):
    rows = QUERIES["agg_10_stored_ratio_series_full_grid"].build(t)
    start = F.col("bucket_start").cast("timestamp")
    reason = F.col("quality_reason")
    rows = rows.withColumns({
        "scopeId": F.col("scope_id"), "from": start, "to": start + F.expr("INTERVAL 1 HOUR"), "value": F.col("value").cast("decimal(20,6)"), "coverage": F.col("coverage").cast("decimal(20,6)"),
        "nullReason": F.col("null_reason"), "qualityReason": reason, "receivedSlots": F.col("received_slots"),
        "provenance": F.when(F.col("received_slots") > 0, F.struct(F.lit("stored").alias("kind"), reason.alias("reason"))),
        "histogramCounts": F.when(F.col("denominator") > 0, F.array("numerator", "denominator"))})
    laid = series_csv.points(rows, **_FIXED)
    return laid.select(F.col("scopeId").alias("scope_id"), when(F.col("from"), "bucket_start"), series_csv.lines(laid).alias("line"))


@query(
    "src_23_primitive_json_lines",
    sql(
        """
SELECT '{"scope_id":"' || city_id || '","slot":' || slot || ',"primitives":{"numerator":' || data_success || ',"denominator":' || data_attempts || '}}' AS line FROM city5m""",
        "city5m",
    ),
)
def json_export(t: Tables):
    rows = t.city5m.select(F.col("city_id").alias("scope_id"), "slot", F.expr("named_struct('numerator', data_success, 'denominator', data_attempts)").alias("primitives"))
    return rows.select(sinks.json_lines(rows).alias("line"))


@query(
    "src_24_canonical_fingerprint",
    sql(
        """
SELECT city_id, slot, sha256('{"a":{"drops":' || voice_drops || ',"tries":' || voice_attempts || '},"city_id":"' || city_id || '","slot":' || slot || '}') AS fingerprint FROM city5m""",
        "city5m",
    ),
)
def fingerprint(t: Tables):
    rows = t.city5m.select("slot", "city_id", F.expr("named_struct('tries', voice_attempts, 'drops', voice_drops)").alias("a"))
    return rows.select("city_id", "slot", content_fingerprint(rows).alias("fingerprint"))


@query(
    "src_25_expired_receipts",
    sql(
        """
SELECT event_id FROM obs WHERE received_at < TIMESTAMP '2024-01-20 00:00:00' AND event_id % 19 <> 0
  AND EXISTS (SELECT 1 FROM obs s WHERE s.scope_id = obs.scope_id AND s.window_start = obs.window_start AND s.kind = 'SERVICE')
  AND (CAST(epoch(window_start) AS BIGINT) // 60) % 11 <> 0 AND (CAST(epoch(window_start) AS BIGINT) // 60) % 13 <> 0 AND (CAST(epoch(window_start) AS BIGINT) // 60) % 17 <> 0
  AND scope_id NOT IN ('S3', 'S8') AND NOT (window_start >= TIMESTAMP '2024-01-05 00:00:00' AND window_start < TIMESTAMP '2024-01-06 00:00:00')""",
        "obs",
    ),
)
def expired(t: Tables):
    minute = "(unix_seconds(window_start) DIV 60)"
    cutoff = ts_lit("2024-01-20 00:00:00")
    w = t.obs.where("kind = 'SERVICE'").select("scope_id", "window_start", "window_end").distinct()
    features = w.withColumn("window_id", identity(F.col("scope_id"), F.unix_seconds("window_start")))
    one = t.spark.range(1)
    tables = {
        "receipts": t.obs.select("event_id", "scope_id", "window_start", "received_at"),
        "buckets": w.withColumn("finalized", F.lit(True)).withColumn("finalized_at", F.col("window_start")),
        "features": features,
        "evaluated": features.where(f"{minute} % 11 <> 0"),
        "delivered": features.withColumn("published", F.expr(f"{minute} % 13 <> 0")),
        "open_jobs": features.where(f"{minute} % 17 = 0"),
        "source_state": t.obs.where("event_id % 19 = 0").selectExpr("event_id AS last_event_id"),
        "unpublished_scopes": one.selectExpr("'S3' AS scope_id"),
        "active_episodes": one.selectExpr("'S8' AS scope_id"),
        "protected_ranges": one.selectExpr("timestamp'2024-01-05 00:00:00' AS range_from", "timestamp'2024-01-06 00:00:00' AS range_to"),
    }
    return retention.expired_receipts(tables, cutoff).select("event_id")


@query(
    "src_26_split_report",
    sql(
        f"""
SELECT coalesce(s.split, m.split) AS split, s.row_count, s.repeated_starts, s.bad_vectors, s.fault_rows, {when_sql("s.lo")} AS first_start, m.manifest_rows,
  s.row_count IS NOT DISTINCT FROM m.manifest_rows AS rows_match
FROM (SELECT split, count(*) AS row_count, count(*) - count(DISTINCT (run_id, window_start)) AS repeated_starts, count(*) FILTER (WHERE vec_id % 113 = 0) AS bad_vectors,
  CAST(sum(fault) AS BIGINT) AS fault_rows, min(window_start) AS lo FROM vectors GROUP BY 1) s
FULL JOIN (SELECT unnest(['train', 'calibration', 'holdout']) AS split, CAST(unnest([300, 50, 9]) AS BIGINT) AS manifest_rows) m ON m.split = s.split""",
        "vectors",
    ),
)
def split_report(t: Tables):
    nan = F.when(F.col("vec_id") % 113 == 0, F.lit(float("nan"))).otherwise(F.col("f0"))
    rows = t.vectors.withColumn("values", F.array(nan, "f1", "f2", "f3", "f4", "f5"))
    manifest = t.spark.createDataFrame([("train", 300), ("calibration", 50), ("holdout", 9)], "split string, manifest_rows bigint")
    return labelled.split_report(rows, manifest).select(
        "split", "row_count", "repeated_starts", "bad_vectors", "fault_rows", when("first_start"), "manifest_rows", "rows_match")


@query(
    "src_27_split_overlaps",
    sql(
        f"""
SELECT service, run_id, {when_sql("previous_end")} AS previous_end FROM (SELECT *, max(run_to) OVER (PARTITION BY service ORDER BY run_from, run_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end
FROM (SELECT profile AS service, split || ':' || run_id AS run_id, min(window_start) AS run_from, max(window_start) + INTERVAL 1 MINUTE AS run_to FROM vectors GROUP BY 1, 2)) WHERE run_from < previous_end""",
        "vectors",
    ),
)
def split_overlaps(t: Tables):
    runs = t.vectors.groupBy(F.col("profile").alias("service"), F.concat_ws(":", "split", "run_id").alias("run_id")).agg(
        F.min("window_start").alias("run_from"), (F.max("window_start") + F.expr("INTERVAL 1 MINUTE")).alias("run_to"))
    return labelled.overlapping_runs(runs).select("service", "run_id", when("previous_end"))


@query(
    "src_27_missing_split_combinations",
    sql(
        """
SELECT f.family, s.severity, p.profile FROM (SELECT unnest(['family0','family1','family2','family9']) AS family) f, (SELECT unnest(['LOW','MEDIUM','HIGH']) AS severity) s,
  (SELECT unnest(['weekday','weekend']) AS profile) p WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.family = f.family AND v.severity = s.severity AND v.profile = p.profile)""",
        "vectors",
    ),
)
def missing_combinations(t: Tables):
    return labelled.missing_combinations(t.vectors, {
        "family": ["family0", "family1", "family2", "family9"], "severity": ["LOW", "MEDIUM", "HIGH"], "profile": ["weekday", "weekend"]})


# -- JON-2, STR -------------------------------------------------------------------------------------

NODES = ["N0", "N1", "N2"]
SERVICE_FIELDS = [
    "attempts", "technical_successes", "user_outcomes", "sip503_count", "rrc_attempts", "rrc_successes", "bearer_attempts",
    "bearer_successes", "delivery_attempts", "delivery_successes", "delivered_messages", "delivery_delay_ms",
]
NODE_FIELDS = ["cpu_pct", "packet_loss_ratio", "queue_depth", "oldest_pending_seconds"]


@query(
    "jon_02_node_evidence_verdicts",
    sql(
        """
SELECT m.event_id, CASE WHEN kind <> 'NODE' THEN 'NOT_NODE' WHEN m.event_id % 29 = 0 THEN 'WRONG_SCOPE' WHEN m.event_id % 31 = 0 THEN 'WRONG_INTERVAL'
  WHEN c.scope_id IS NULL THEN 'UNAPPROVED_DEPENDENCY' WHEN quality <> 'COMPLETE' THEN 'QUALITY_INELIGIBLE' WHEN m.event_id % 37 = 0 THEN 'MEASUREMENT_MISSING' ELSE 'ACCEPTED' END AS verdict
FROM obs_metrics m LEFT JOIN catalogue c ON c.role = 'NODE' AND c.scope_id = m.scope_id AND c.node_id = m.node_id AND c.source_id = m.source_id""",
        "obs_metrics", "catalogue",
    ),
)
def node_verdicts(t: Tables):
    rows = t.obs_metrics.withColumns({
        "for_scope": F.expr("CASE WHEN event_id % 29 = 0 THEN 'S?' ELSE scope_id END"),
        "for_window": F.expr("CASE WHEN event_id % 31 = 0 THEN window_end ELSE window_start END"),
        **{n: F.expr(f"CASE WHEN event_id % 37 <> 0 THEN {n} END") for n in NODE_FIELDS},
    })
    return windows.node_evidence(rows, t.catalogue).select("event_id", "verdict")


@query(
    "jon_02_service_evidence",
    sql(
        f"""
SELECT s.scope_id, {when_sql("s.window_start")} AS window_start, s.event_id AS service_event, n.event_id AS node_event, coalesce(n.verdict, 'NODE_MISSING') AS verdict
FROM (SELECT * FROM obs_metrics WHERE kind = 'SERVICE') s LEFT JOIN (
  SELECT m.*, CASE WHEN kind <> 'NODE' THEN 'NOT_NODE' WHEN c.scope_id IS NULL THEN 'UNAPPROVED_DEPENDENCY' WHEN quality <> 'COMPLETE' THEN 'QUALITY_INELIGIBLE'
    WHEN m.event_id % 37 = 0 THEN 'MEASUREMENT_MISSING' ELSE 'ACCEPTED' END AS verdict
  FROM obs_metrics m LEFT JOIN catalogue c ON c.role = 'NODE' AND c.scope_id = m.scope_id AND c.node_id = m.node_id AND c.source_id = m.source_id
  WHERE kind <> 'SERVICE') n ON n.scope_id = s.scope_id AND n.window_end = s.window_end""",
        "obs_metrics", "catalogue",
    ),
)
def service_evidence(t: Tables):
    rows = t.obs_metrics.withColumns({n: F.expr(f"CASE WHEN event_id % 37 <> 0 THEN {n} END") for n in NODE_FIELDS})
    return windows.service_evidence(rows, t.catalogue, "10 seconds").select("scope_id", when("window_start"), "service_event", "node_event", "verdict")


def finalized(t: Tables):
    return windows.finalize(windows.approve_nodes(accepted(t), t.catalogue), NODES, SERVICE_FIELDS, NODE_FIELDS)


_FINAL_NODE = "arg_min({f}, m.event_id) FILTER (WHERE kind = 'NODE' AND quality = 'COMPLETE' AND ok AND m.node_id = '{n}')"
FINAL_SQL = f"""
SELECT m.scope_id, m.window_start, m.window_end, count(*) AS accepted, min(event_id) FILTER (WHERE kind = 'SERVICE') AS service_event,
  coalesce(arg_min(quality, event_id) FILTER (WHERE kind = 'SERVICE'), 'MISSING') AS quality, arg_min(service, event_id) FILTER (WHERE kind = 'SERVICE') AS service,
  {", ".join(f"arg_min({f}, event_id) FILTER (WHERE kind = 'SERVICE') AS {f}" for f in SERVICE_FIELDS)},
  {", ".join(_FINAL_NODE.format(f=f, n=n) + f" AS {f}_{n}" for f in [*NODE_FIELDS, "event_id"] for n in NODES)}
FROM (SELECT a.*, c.scope_id IS NOT NULL AS ok FROM accepted_obs a LEFT JOIN catalogue c ON c.role = 'NODE' AND c.scope_id = a.scope_id AND c.node_id = a.node_id AND c.source_id = a.source_id) m
GROUP BY 1, 2, 3"""
FINAL_VIEWS = {"classified": CLASSIFIED_SQL, "accepted_obs": ACCEPTED_SQL, "final": FINAL_SQL}


def final_sql(body: str, **more: str) -> str:
    return sql(body, "obs_dup", "obs_metrics", "catalogue", **FINAL_VIEWS, **more)


@query(
    "str_01_tumbling_minute_windows",
    final_sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, accepted FROM final"),
)
def minute_windows(t: Tables):
    return windows.bucket_counts(accepted(t)).select("scope_id", when("window_start"), F.col("accepted_input_count").alias("accepted"))


@query(
    "str_02_finalized_windows",
    final_sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, service, quality, service_event, attempts, cpu_pct_N0, queue_depth_N1, accepted FROM final WHERE quality <> 'MISSING'"),
)
def finalized_windows(t: Tables):
    return finalized(t).where("quality <> 'MISSING'").select(
        "scope_id", when("window_start"), "s.service", "quality", F.col("s.event_id").alias("service_event"), "s.attempts",
        F.col("node_N0.cpu_pct").alias("cpu_pct_N0"), F.col("node_N1.queue_depth").alias("queue_depth_N1"), "accepted")


@query(
    "str_03_missing_service_windows",
    final_sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, quality, cpu_pct_N0, queue_depth_N1, packet_loss_ratio_N2 FROM final WHERE quality = 'MISSING'"),
)
def missing_service(t: Tables):
    return finalized(t).where("quality = 'MISSING'").select(
        "scope_id", when("window_start"), "quality", F.col("node_N0.cpu_pct").alias("cpu_pct_N0"),
        F.col("node_N1.queue_depth").alias("queue_depth_N1"), F.col("node_N2.packet_loss_ratio").alias("packet_loss_ratio_N2"))


@query(
    "str_04_expected_gaps",
    sql(
        f"""
SELECT h.scope_id, {when_sql("h.g")} AS window_start FROM (SELECT scope_id, unnest(generate_series(lo, TIMESTAMP '2024-01-31 01:00:00' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS g
  FROM (SELECT scope_id, min(window_start) AS lo FROM kpi_hour GROUP BY 1)) h
WHERE NOT EXISTS (SELECT 1 FROM kpi_hour k WHERE k.scope_id = h.scope_id AND k.window_start = h.g)""",
        "kpi_hour",
    ),
)
def gaps(t: Tables):
    return windows.expected_gaps(t.kpi_hour, ts_lit("2024-01-31 01:00:00"), 3600).select("scope_id", when("window_start"))


_RANGES = """
SELECT 'S' || s AS scope_id, TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST(s AS INT)) + to_days(CAST(r * 5 AS INT)) AS monitored_from,
  TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST(s AS INT)) + to_days(CAST(r * 5 + 6 AS INT)) AS monitored_through FROM range(10) t(s), range(3) u(r)"""


def monitored(t: Tables):
    return t.spark.range(30).selectExpr(
        "concat('S', id % 10) AS scope_id",
        "timestampadd(DAY, CAST(id % 10 + (id DIV 10) * 5 AS INT), timestamp'2024-01-02 00:00:00') AS monitored_from",
        "timestampadd(DAY, CAST(id % 10 + (id DIV 10) * 5 + 6 AS INT), timestamp'2024-01-02 00:00:00') AS monitored_through")


@query(
    "str_05_monitored_range_ledger",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start FROM (SELECT DISTINCT scope_id, unnest(generate_series(monitored_from, monitored_through - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS window_start FROM ranges) e
WHERE NOT EXISTS (SELECT 1 FROM kpi_hour k WHERE k.scope_id = e.scope_id AND k.window_start = e.window_start)""",
        "kpi_hour", ranges=_RANGES,
    ),
)
def ledger(t: Tables):
    return windows.ledger(monitored(t), t.kpi_hour, 3600).select("scope_id", when("window_start"))


@query(
    "str_04_silent_windows",
    sql(
        f"""
SELECT scope_id, {when_sql("g")} AS window_start, {when_sql("g + INTERVAL 1 HOUR")} AS window_end, 'MISSING' AS quality FROM (
  SELECT DISTINCT scope_id, unnest(generate_series(monitored_from, monitored_through - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS g FROM ranges WHERE scope_id <> 'S3'
  UNION ALL SELECT scope_id, unnest(generate_series(lo, TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR)) FROM (SELECT scope_id, min(window_start) AS lo FROM kpi_hour WHERE scope_id = 'S3' OR scope_id NOT IN (SELECT scope_id FROM ranges) GROUP BY 1)) e
WHERE g + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-31 01:00:00' AND NOT EXISTS (SELECT 1 FROM kpi_hour k WHERE k.scope_id = e.scope_id AND k.window_start = e.g)""",
        "kpi_hour", ranges=_RANGES,
    ),
)
def silent(t: Tables):
    return windows.silent_windows(t.kpi_hour, monitored(t).where("scope_id <> 'S3'"), ts_lit("2024-01-31 01:00:00"), 3600).select(
        "scope_id", when("window_start"), when("window_end"), "quality")


@query(
    "str_07_bucket_accepted_counts",
    sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, count(*) AS accepted_input_count FROM classified WHERE outcome = 'ACCEPTED' GROUP BY scope_id, window_start", "obs_dup", classified=CLASSIFIED_SQL),
)
def bucket_counts(t: Tables):
    return windows.bucket_counts(classified(t).where("outcome = 'ACCEPTED'")).select("scope_id", when("window_start"), "accepted_input_count")


_STATE = """SELECT scope_id, source_id, max(emitted_at) AS latest_emitted_at, arg_max(event_id, (window_start, emitted_at, event_id)) AS last_event_id, max(window_start) AS latest_window_start FROM obs GROUP BY 1, 2"""


@query(
    "str_08_latest_source_state",
    sql(f"SELECT scope_id, source_id, {when_sql('latest_window_start')} AS latest_window_start, {when_sql('latest_emitted_at')} AS latest_emitted_at, last_event_id FROM st", "obs", st=_STATE),
)
def source_state(t: Tables):
    return windows.source_state(t.obs).select("scope_id", "source_id", when("latest_window_start"), when("latest_emitted_at"), "last_event_id")


@query(
    "str_09_activity_freshness",
    sql(
        """
SELECT e.scope_id, e.source_id, CASE WHEN st.latest_emitted_at IS NULL THEN 'NEVER_SEEN' WHEN epoch(TIMESTAMP '2024-01-30 23:50:00') - epoch(st.latest_emitted_at) NOT BETWEEN 0 AND 90 THEN 'STALE' ELSE 'FRESH' END AS freshness
FROM (SELECT 'S' || s AS scope_id, 'src' || r AS source_id FROM range(11) t(s), range(4) u(r)) e LEFT JOIN st ON st.scope_id = e.scope_id AND st.source_id = e.source_id""",
        "obs", st=_STATE,
    ),
)
def freshness(t: Tables):
    expected = t.spark.range(44).selectExpr("concat('S', id DIV 4) AS scope_id", "concat('src', id % 4) AS source_id")
    return windows.activity_freshness(expected, windows.source_state(t.obs), ts_lit("2024-01-30 23:50:00")).select("scope_id", "source_id", "freshness")


@query(
    "str_10_interval_coverage",
    sql(
        f"""
SELECT g.scope_id, g.source_id, {when_sql("g.window_start")} AS window_start, CASE WHEN r.q = 'MISSING' THEN 'REPORTED_MISSING' WHEN r.q IS NOT NULL THEN r.q
  WHEN TIMESTAMP '2024-01-20 00:00:00' >= g.window_start + INTERVAL 70 SECOND THEN 'MISSING' ELSE 'PENDING' END AS coverage
FROM (SELECT DISTINCT scope_id, window_start, 'src' || s AS source_id FROM obs, range(3) u(s)) g
LEFT JOIN (SELECT scope_id, source_id, window_start, arg_min(quality, event_id) AS q FROM obs WHERE kind <> 'HEARTBEAT' GROUP BY 1, 2, 3) r
  ON r.scope_id = g.scope_id AND r.source_id = g.source_id AND r.window_start = g.window_start""",
        "obs",
    ),
)
def interval_coverage(t: Tables):
    grid = t.obs.select("scope_id", "window_start").distinct().select("*", F.expr("explode(array('src0', 'src1', 'src2')) AS source_id"))
    return windows.interval_coverage(grid, t.obs, ts_lit("2024-01-20 00:00:00")).select("scope_id", "source_id", when("window_start"), "coverage")


_COVER_SQL = """
SELECT r.scope_id, r.window_start, string_agg(r.source_id, ',' ORDER BY r.source_id) AS received, string_agg(r.source_id, ',' ORDER BY r.source_id) FILTER (WHERE q = 'COMPLETE') AS usable,
  count(*) FILTER (WHERE q = 'COMPLETE') AS n_usable, count(*) AS n_received FROM (SELECT scope_id, window_start, source_id, arg_min(quality, event_id) AS q FROM obs WHERE kind <> 'HEARTBEAT' GROUP BY 1, 2, 3) r GROUP BY 1, 2"""


@query(
    "str_11_source_coverage_snapshot",
    sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, 'src0,src1,src2' AS expected, received, coalesce(usable, '') AS usable, 3 - n_usable AS issues FROM cov", "obs", cov=_COVER_SQL),
)
def snapshot(t: Tables):
    s = windows.coverage_snapshot(t.obs, t.catalogue)
    return s.select("scope_id", when("window_start"), F.array_join("expected", ",").alias("expected"), F.array_join("received", ",").alias("received"),
                    F.array_join("usable", ",").alias("usable"), F.size("issues").cast("bigint").alias("issues"))


@query(
    "str_12_coverage_state",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, CASE WHEN window_start < TIMESTAMP '2024-01-10 00:00:00' THEN 'STALE' WHEN n_usable = 0 THEN 'MISSING' WHEN n_usable = 3 THEN 'COMPLETE' ELSE 'PARTIAL' END AS state FROM cov""",
        "obs", cov=_COVER_SQL,
    ),
)
def coverage_state(t: Tables):
    s = windows.coverage_snapshot(t.obs, t.catalogue)
    stale = F.col("window_start") < ts_lit("2024-01-10 00:00:00")
    return s.select("scope_id", when("window_start"), windows.coverage_state(F.col("expected"), F.col("usable"), stale).alias("state"))


@query(
    "str_22_outcome_counters",
    sql("SELECT scope_id, outcome, count(*) AS deliveries FROM classified GROUP BY 1, 2", "obs_dup", classified=CLASSIFIED_SQL),
)
def counters(t: Tables):
    return classified(t).groupBy("scope_id", "outcome").agg(F.count("*").alias("deliveries"))


@query(
    "str_22_delay_histogram",
    sql(
        """
SELECT CASE WHEN d <= 1 THEN '1' WHEN d <= 2 THEN '2' WHEN d <= 5 THEN '5' WHEN d <= 10 THEN '10' WHEN d <= 15 THEN '15' WHEN d <= 20 THEN '20' ELSE '+Inf' END AS le, count(*) AS samples
FROM (SELECT epoch(received_at) - epoch(window_end) AS d FROM obs) GROUP BY 1""",
        "obs",
    ),
)
def delays(t: Tables):
    return windows.delay_histogram(t.obs)


@query(
    "str_23_live_reevaluation",
    sql(
        f"""
SELECT link_id, slot, age AS source_age_seconds, CASE WHEN age <= 600 THEN 'FRESH' ELSE 'STALE' END AS freshness, CASE WHEN age <= 600 THEN 'VALID' ELSE 'STALE' END AS quality,
  CASE WHEN age > 600 THEN 'SOURCE_EXPIRED_AT_LIVE_EVALUATION' END AS quality_reason FROM (SELECT link_id, slot, CAST(epoch({slot_ts("8639")}) - epoch(ts) AS BIGINT) AS age FROM link5m)""",
        "link5m",
    ),
)
def live(t: Tables):
    rows = t.link5m.selectExpr("link_id", "slot", "ts AS observed_at", "600 AS max_age_seconds", "0L AS source_age_seconds", "'FRESH' AS freshness", "'VALID' AS quality", "CAST(NULL AS STRING) AS quality_reason")
    at = F.expr(at_slot("8639"))
    return windows.reevaluate(rows, at, live=True).select("link_id", "slot", "source_age_seconds", "freshness", "quality", "quality_reason")
