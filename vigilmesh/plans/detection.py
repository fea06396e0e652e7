"""KPIs, feature vectors and rules: KPI-1…8, RUL-1…8, RUL-10."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.adapters import Tables
from vigilmesh.operators import kpi, rules
from vigilmesh.oracle_views import slot_ts, sql
from vigilmesh.plans.common import num, num_sql, when, when_sql
from vigilmesh.plans.ingestion import final_sql, finalized
from vigilmesh.plans.rollups import native_rows, NATIVE_QUALITY_SQL, NATIVE_SQL
from vigilmesh.registry import query

PROFILE_SQL = """
SELECT 'S' || s AS scope_id, h AS hour_of_week, 97 + (h % 5) * 0.25::DOUBLE AS b_cssr, 99.0::DOUBLE AS b_rrc, 99.25::DOUBLE AS b_bearer,
  CAST(9000 + h * 10 AS DOUBLE) AS b_p95, 98.5::DOUBLE AS b_delivery FROM range(10) a(s), range(168) b(h) WHERE h % 24 <> 3"""


def profile(t: Tables):
    """A fixed hour-of-week profile; one hour of each day has no baseline."""
    return t.spark.range(1680).selectExpr("concat('S', id % 10) AS scope_id", "CAST(id DIV 10 AS INT) AS hour_of_week").selectExpr(
        "*", "97 + (hour_of_week % 5) * 0.25D AS b_cssr", "99D AS b_rrc", "99.25D AS b_bearer",
        "CAST(9000 + hour_of_week * 10 AS DOUBLE) AS b_p95", "98.5D AS b_delivery").where("hour_of_week % 24 <> 3")


def measured(t: Tables):
    return kpi.service_kpis(kpi.with_baseline(finalized(t), profile(t)), "N0", "N2", "N1")


KPI_SQL = """
SELECT * EXCLUDE (delivered_messages), attempts_c - user_c AS eligible_attempts, 100.0::DOUBLE * success_c / nullif(attempts_c - user_c, 0) AS cssr_pct, sip_c::DOUBLE / nullif(attempts_c - user_c, 0) AS sip503_ratio,
  100.0::DOUBLE * rrc_s / nullif(rrc_a, 0) AS rrc_sr_pct, 100.0::DOUBLE * bearer_s / nullif(bearer_a, 0) AS bearer_sr_pct, packet_loss_ratio_N2 AS packet_loss_ratio, cpu_pct_N0 AS ims_cpu_pct,
  CASE WHEN len(delays) > 0 THEN list_sort(delays)[CAST((len(delays) * 95 + 99) // 100 AS INT)] END AS p95_delivery_ms, 100.0::DOUBLE * del_s / nullif(del_a, 0) AS delivery_sr_pct,
  delivered_c AS delivered_messages, queue_depth_N1 AS queue_depth, oldest_pending_seconds_N1 AS oldest_pending_seconds
FROM (SELECT f.*, p.b_cssr, p.b_rrc, p.b_bearer, p.b_p95, p.b_delivery,
  CASE WHEN quality = 'COMPLETE' THEN attempts END AS attempts_c, CASE WHEN quality = 'COMPLETE' THEN user_outcomes END AS user_c, CASE WHEN quality = 'COMPLETE' THEN technical_successes END AS success_c,
  CASE WHEN quality = 'COMPLETE' THEN sip503_count END AS sip_c, CASE WHEN quality = 'COMPLETE' THEN rrc_successes END AS rrc_s, CASE WHEN quality = 'COMPLETE' THEN rrc_attempts END AS rrc_a,
  CASE WHEN quality = 'COMPLETE' THEN bearer_successes END AS bearer_s, CASE WHEN quality = 'COMPLETE' THEN bearer_attempts END AS bearer_a, CASE WHEN quality = 'COMPLETE' THEN delivery_delay_ms END AS delays,
  CASE WHEN quality = 'COMPLETE' THEN delivery_successes END AS del_s, CASE WHEN quality = 'COMPLETE' THEN delivery_attempts END AS del_a, CASE WHEN quality = 'COMPLETE' THEN delivered_messages END AS delivered_c
  FROM final f LEFT JOIN profile p ON p.scope_id = f.scope_id AND p.hour_of_week = (isodow(f.window_start) - 1) * 24 + hour(f.window_start))"""


def kpi_sql(body: str, **more: str) -> str:
    return final_sql(body, profile=PROFILE_SQL, kpis=KPI_SQL, **more)


@query(
    "kpi_01_voice_kpis",
    kpi_sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, quality, eligible_attempts, {num_sql('cssr_pct')} AS cssr_pct, {num_sql('sip503_ratio')} AS sip503_ratio, {num_sql('rrc_sr_pct')} AS rrc_sr_pct, {num_sql('bearer_sr_pct')} AS bearer_sr_pct, {num_sql('packet_loss_ratio')} AS packet_loss_ratio, {num_sql('ims_cpu_pct')} AS ims_cpu_pct FROM kpis WHERE service = 'VOLTE'"),
)
def voice_kpis(t: Tables):
    return measured(t).where("service = 'VOLTE'").select(
        "scope_id", when("window_start"), "quality", "eligible_attempts", num("cssr_pct"), num("sip503_ratio"), num("rrc_sr_pct"),
        num("bearer_sr_pct"), num("packet_loss_ratio"), num("ims_cpu_pct"))


@query(
    "kpi_02_sms_kpis",
    kpi_sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, quality, p95_delivery_ms, {num_sql('delivery_sr_pct')} AS delivery_sr_pct, delivered_messages, queue_depth, oldest_pending_seconds FROM kpis WHERE service = 'SMS'"),
)
def sms_kpis(t: Tables):
    return measured(t).where("service = 'SMS'").select(
        "scope_id", when("window_start"), "quality", "p95_delivery_ms", num("delivery_sr_pct"), "delivered_messages", "queue_depth", "oldest_pending_seconds")


_VECTOR_SQL = """CASE WHEN service = 'VOLTE' THEN [cssr_pct - b_cssr, sip503_ratio, rrc_sr_pct - b_rrc, bearer_sr_pct - b_bearer, packet_loss_ratio, ims_cpu_pct]
  WHEN service = 'SMS' THEN [p95_delivery_ms / b_p95, p95_delivery_ms::DOUBLE, queue_depth::DOUBLE, oldest_pending_seconds::DOUBLE, delivery_sr_pct - b_delivery, delivered_messages::DOUBLE] END"""


@query(
    "kpi_03_feature_vectors",
    kpi_sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, service, eligible, CASE WHEN eligible THEN {num_sql("v[1]")} END AS f1, CASE WHEN eligible THEN {num_sql("v[2]")} END AS f2, CASE WHEN eligible THEN {num_sql("v[5]")} END AS f5, CASE WHEN eligible THEN {num_sql("v[6]")} END AS f6
FROM (SELECT *, coalesce(quality = 'COMPLETE' AND len(list_filter(v, lambda x: x IS NOT NULL AND abs(x) <= 1e9)) = 6, FALSE) AS eligible FROM (SELECT *, {_VECTOR_SQL} AS v FROM kpis))"""),
)
def feature_vectors(t: Tables):
    v = measured(t).withColumn("v", kpi.feature_vector())
    return v.select(
        "scope_id", when("window_start"), "service", (F.size("v") == 6).alias("eligible"),
        *[num(F.get("v", F.lit(i - 1)), f"f{i}") for i in (1, 2, 5, 6)])


@query(
    "kpi_04_window_identity",
    final_sql(f"""SELECT scope_id, {when_sql("window_start")} AS window_start, sha256('["' || scope_id || '","' || strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') || '","2"]') AS window_id FROM final"""),
)
def window_identity(t: Tables):
    return finalized(t).select("scope_id", when("window_start"), kpi.window_id(F.col("scope_id"), F.col("window_start")).alias("window_id"))


def _ratio(metric, scope, n, d, table):
    return f"SELECT {scope} AS scope_id, slot, '{metric}' AS metric_id, {n}::DOUBLE AS first, {d}::DOUBLE AS second, 100.0::DOUBLE * {n} / nullif({d}, 0) AS value FROM {table}"


_P5 = " UNION ALL ".join([
    _ratio("roaming.registration.success", "partner_id || direction", "reg_success", "reg_attempts", "roam5m"),
    _ratio("roaming.data.success", "partner_id || direction", "data_success", "data_attempts", "roam5m"),
    _ratio("roaming.voice.success", "partner_id || direction", "voice_success", "voice_attempts", "roam5m"),
    _ratio("mobileData.activation.success", "city_id", "data_success", "data_attempts", "city5m"),
    _ratio("mobileData.dns.success", "city_id", "dns_success", "dns_attempts", "city5m"),
    "SELECT city_id, slot, 'mobileData.throughput', user_throughput_mbps::DOUBLE, 1.0::DOUBLE, user_throughput_mbps::DOUBLE FROM city5m",
    "SELECT link_id, slot, 'transport.traffic', traffic_gbps::DOUBLE * 300, 300.0::DOUBLE, traffic_gbps::DOUBLE FROM link5m",
    "SELECT link_id, slot, 'transport.link.utilization', 30000.0::DOUBLE * traffic_gbps::DOUBLE / capacity, 300.0::DOUBLE, 100.0::DOUBLE * traffic_gbps::DOUBLE / capacity FROM link5m",
    "SELECT link_id, slot, 'transport.effectiveCapacity', capacity::DOUBLE, NULL, capacity::DOUBLE FROM link5m",
    "SELECT link_id, slot, 'transport.rtt.snapshot', rtt_ms::DOUBLE, NULL, rtt_ms::DOUBLE FROM link5m",
    "SELECT link_id, slot, 'transport.jitter', jitter_ms::DOUBLE, NULL, jitter_ms::DOUBLE FROM link5m",
])


@query(
    "kpi_05_native_primitives",
    sql(f"SELECT scope_id, slot, metric_id, {num_sql('first')} AS first, {num_sql('second')} AS second, {num_sql('value')} AS value, CASE WHEN value IS NULL THEN 'ZERO_DENOMINATOR' ELSE 'NONE' END AS null_reason FROM p",
        "city5m", "link5m", "roam5m", p=_P5),
)
def native(t: Tables):
    city = kpi.native_primitives(t.city5m.withColumn("scope_id", F.col("city_id")), "CITY", ["scope_id", "slot"])
    link = kpi.native_primitives(t.link5m.withColumn("scope_id", F.col("link_id")), "LINK", ["scope_id", "slot"])
    roam = kpi.native_primitives(t.roam5m.withColumn("scope_id", F.concat("partner_id", "direction")), "ROAMING", ["scope_id", "slot"])
    return city.unionByName(link).unionByName(roam).select("scope_id", "slot", "metric_id", num("first"), num("second"), num("value"), "null_reason")


@query(
    "kpi_06_single_slot_projection",
    sql(
        f"""
SELECT scope_id, {when_sql("ts")} AS ts, {num_sql("100.0::DOUBLE * numerator / nullif(denominator, 0)")} AS value,
  CASE WHEN denominator = 0 AND quality IN ('VALID', 'PARTIAL') THEN 'INSUFFICIENT_EVIDENCE' ELSE quality END AS quality,
  CASE WHEN denominator = 0 AND quality IN ('VALID', 'PARTIAL') THEN 'ZERO_DENOMINATOR' ELSE quality_reason END AS reason FROM judged""",
        "city5m", native=NATIVE_SQL, judged=NATIVE_QUALITY_SQL,
    ),
)
def projection(t: Tables):
    from vigilmesh.functions import quality
    from vigilmesh.functions.arithmetic import percent

    rows = native_rows(t)
    q = quality.native_quality(F.col("source_quality"), F.col("source_coverage"))
    r = quality.native_reason(F.col("source_quality"), F.col("source_coverage"))
    empty = (F.col("denominator") == 0) & q.isin("VALID", "PARTIAL")
    return rows.select("scope_id", when("ts"), num(percent(F.col("numerator"), F.col("denominator")), "value"),
                       F.when(empty, "INSUFFICIENT_EVIDENCE").otherwise(q).alias("quality"),
                       F.when(empty, "ZERO_DENOMINATOR").otherwise(r).alias("reason"))


@query(
    "kpi_07_native_resolution_series",
    sql(
        f"""
SELECT g.scope_id, g.slot, {num_sql("100.0::DOUBLE * f.data_success / nullif(f.data_attempts, 0)")} AS value, CASE WHEN f.slot IS NULL THEN 'MISSING' ELSE 'INSUFFICIENT_EVIDENCE' END AS quality,
  CASE WHEN f.slot IS NULL THEN 'NO_SOURCE_SLOT' WHEN f.data_attempts = 0 THEN 'ZERO_DENOMINATOR' ELSE 'NONE' END AS null_reason
FROM (SELECT scope_id, s AS slot FROM cities, range(8640) r(s)) g LEFT JOIN city_facts f ON f.scope_id = g.scope_id AND f.slot = g.slot""",
        "city_facts", "cities",
    ),
)
def native_series(t: Tables):
    from vigilmesh.functions.arithmetic import percent

    grid = t.cities.select("scope_id", F.explode(F.expr("sequence(0L, 8639L)")).alias("slot"))
    facts = t.city_facts.select("scope_id", "slot", "data_success", "data_attempts")
    j = grid.join(facts, ["scope_id", "slot"], "left")
    none = F.col("data_attempts").isNull()
    return j.select(
        "scope_id", "slot", num(percent(F.col("data_success"), F.col("data_attempts")), "value"),
        F.when(none, "MISSING").otherwise("INSUFFICIENT_EVIDENCE").alias("quality"),
        F.when(none, "NO_SOURCE_SLOT").when(F.col("data_attempts") == 0, "ZERO_DENOMINATOR").otherwise("NONE").alias("null_reason"))


@query(
    "kpi_08_domain_feature_vectors",
    sql(
        f"""
SELECT city_id, slot, {num_sql("a")} AS actual, CASE WHEN slot % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS actual_present, {num_sql("coalesce((a0 - 99.0::DOUBLE) / 99.0::DOUBLE, 0)")} AS residual, CASE WHEN slot % 7 = 0 OR slot % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS residual_present, 16 AS width
FROM (SELECT *, coalesce(a00, 0) AS a, CASE WHEN slot % 5 <> 0 THEN a00 END AS a0 FROM (SELECT city_id, slot, CASE WHEN slot % 7 <> 0 THEN 100.0::DOUBLE * dns_success / dns_attempts END AS a00 FROM city5m))""",
        "city5m",
    ),
)
def domain_vectors(t: Tables):
    rows = t.city5m.selectExpr(
        "city_id", "slot", "CASE WHEN slot % 7 <> 0 THEN 100D * dns_success / dns_attempts END AS actual", "dns_success AS numerator", "dns_attempts AS denominator",
        "CAST(NULL AS DOUBLE) AS sum_value", "CAST(NULL AS DOUBLE) AS sample_count", "CASE WHEN slot % 5 <> 0 THEN 99D END AS center", "1D AS coverage", "0D AS age_seconds")
    v = kpi.domain_features(rows)
    return v.select("city_id", "slot", num(F.col("features")[0], "actual"), F.col("features")[1].alias("actual_present"),
                    num(F.col("features")[10], "residual"), F.col("features")[11].alias("residual_present"), F.size("features").alias("width"))


# -- RUL --------------------------------------------------------------------------------------------

_VOICE_SQL = """
SELECT *, CASE WHEN quality <> 'COMPLETE' THEN 'INSUFFICIENT_DATA' WHEN b_cssr IS NULL THEN 'BASELINE_MISSING' WHEN eligible_attempts IS NULL OR success_c IS NULL OR eligible_attempts < 100 THEN 'INSUFFICIENT_DATA' ELSE 'EVALUATED' END AS rule_status,
  CAST(b_cssr AS DECIMAL(9,4)) * eligible_attempts - success_c * 100 AS wd FROM kpis WHERE service = 'VOLTE'"""
_VOICE2_SQL = """
SELECT *, rule_status = 'EVALUATED' AND wd > eligible_attempts AS breached, rule_status = 'EVALUATED' AND wd <= CAST(0.5 AS DECIMAL(3,2)) * eligible_attempts AS healthy_now FROM voice"""


@query(
    "rul_01_voice_setup_rule",
    kpi_sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, rule_status, breached, healthy_now, CASE WHEN breached THEN CASE WHEN wd >= 20000 THEN 'CRITICAL' WHEN wd >= 5000 THEN 'HIGH' ELSE 'MEDIUM' END END AS rule_severity,
  CASE WHEN rule_status = 'EVALUATED' THEN {num_sql("wd::DOUBLE / eligible_attempts")} END AS drop_pp, CASE WHEN rule_status = 'EVALUATED' THEN {num_sql("greatest(wd, 0)::DOUBLE / 100")} END AS extra_failures FROM voice2""",
        voice=_VOICE_SQL, voice2=_VOICE2_SQL),
)
def voice_rule(t: Tables):
    r = rules.voice_rule(measured(t).where("service = 'VOLTE'"))
    return r.select("scope_id", when("window_start"), "rule_status", F.coalesce("breached", F.lit(False)).alias("breached"), F.coalesce("healthy_now", F.lit(False)).alias("healthy_now"),
                    "rule_severity", num("drop_pp"), num("extra_failures"))


@query(
    "rul_02_ims_capacity_hypothesis",
    kpi_sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, coalesce(breached AND ims_cpu_pct >= 90 AND sip_c > 0 AND CAST(b_rrc AS DECIMAL(12,6)) - CAST(rrc_sr_pct AS DECIMAL(12,6)) <= 0.5
  AND CAST(b_bearer AS DECIMAL(12,6)) - CAST(bearer_sr_pct AS DECIMAL(12,6)) <= 0.5, FALSE) AS hypothesis FROM (SELECT * REPLACE (coalesce(ims_cpu_pct, CAST(attempts % 100 AS DOUBLE)) AS ims_cpu_pct) FROM voice2)""",
        voice=_VOICE_SQL, voice2=_VOICE2_SQL),
)
def ims_hypothesis(t: Tables):
    # Node evidence is rare in the given events, so the processor load is taken from the counters here.
    rows = measured(t).where("service = 'VOLTE'").withColumn("ims_cpu_pct", F.coalesce("ims_cpu_pct", (F.col("s.attempts") % 100).cast("double")))
    r = rules.voice_rule(rows)
    return r.select("scope_id", when("window_start"), rules.ims_capacity_hypothesis(r).alias("hypothesis"))


_SMS_SQL = """
SELECT *, coalesce(quality = 'COMPLETE' AND delivered_messages >= 30 AND p95_delivery_ms IS NOT NULL AND b_p95 > 0, FALSE) AS dr, queue_depth IS NOT NULL AS qr FROM kpis WHERE service = 'SMS'"""
_SMS2_SQL = """
SELECT *, coalesce(dr AND p95_delivery_ms > 20000 AND p95_delivery_ms > b_p95 * 3, FALSE) AS db, coalesce(qr AND queue_depth >= 100 AND oldest_pending_seconds > 60, FALSE) AS bb FROM sms"""


@query(
    "rul_03_sms_delivery_rule",
    kpi_sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, CASE WHEN NOT dr AND NOT qr THEN CASE WHEN b_p95 IS NULL THEN 'BASELINE_MISSING' ELSE 'INSUFFICIENT_DATA' END ELSE 'EVALUATED' END AS rule_status, db OR bb AS breached,
  coalesce(quality = 'COMPLETE' AND qr AND oldest_pending_seconds <= 30 AND (coalesce(dr AND p95_delivery_ms <= 10000 AND p95_delivery_ms <= b_p95 * 2, FALSE) OR coalesce(queue_depth = 0 AND delivered_messages = 0, FALSE)), FALSE) AND NOT (db OR bb) AS healthy_now,
  CASE WHEN db OR bb THEN CASE WHEN coalesce(qr AND queue_depth >= 1000 AND oldest_pending_seconds >= 300, FALSE) THEN 'CRITICAL' WHEN bb OR (db AND delivered_messages >= 100) THEN 'HIGH' ELSE 'MEDIUM' END END AS rule_severity,
  CASE WHEN db THEN delivered_messages ELSE 0 END AS affected_deliveries, CASE WHEN bb THEN queue_depth ELSE 0 END AS queued_messages FROM sms2""",
        sms=_SMS_SQL, sms2=_SMS2_SQL),
)
def sms_rule(t: Tables):
    r = rules.sms_rule(measured(t).where("service = 'SMS'"))
    return r.select("scope_id", when("window_start"), "rule_status", "breached", "healthy_now", "rule_severity", "affected_deliveries", "queued_messages")


def link_evidence(t: Tables):
    """Loss and RTT populations per link slot, with their eligibility inputs."""
    return t.link5m.selectExpr(
        "link_id", "slot", "ts", "traffic_micro DIV 1000 AS packets", "(traffic_micro DIV 1000) * loss_bp DIV 100 AS lost",
        "10 + slot % 60 AS samples", "(10 + slot % 60) * rtt_ms AS rtt_sum",
        "100D * traffic_micro / 1000000D / capacity AS utilization", "effective_capacity_gbps AS capacity",
        "CASE WHEN slot % 31 = 0 THEN 'STALE' ELSE 'VALID' END AS quality", "CASE WHEN slot % 37 = 0 THEN 'STALE' ELSE 'FRESH' END AS freshness",
        "1D AS actual", "CASE WHEN slot % 41 = 0 THEN 0.5D ELSE 1D END AS coverage", "ts AS observed_at",
        "timestampadd(SECOND, CASE WHEN slot % 43 = 0 THEN 601 ELSE 300 END, ts) AS as_of")


_LINK_SQL = """
SELECT link_id, slot, ts, traffic_micro // 1000 AS packets, (traffic_micro // 1000) * loss_bp // 100 AS lost, 10 + slot % 60 AS samples, (10 + slot % 60) * rtt_ms AS rtt_sum,
  100.0::DOUBLE * traffic_micro / 1000000.0::DOUBLE / capacity AS utilization, capacity, slot % 31 <> 0 AND slot % 37 <> 0 AND slot % 41 <> 0 AND slot % 43 <> 0 AS el FROM link5m"""


def absolute_sql(total: str, count: str, minimum: int, trigger: int, recovery: int, critical: int) -> str:
    return f"""CASE WHEN NOT el OR {count} < {minimum} THEN 'UNKNOWN' WHEN {total} > {trigger} * {count} THEN 'BREACH' WHEN {total} <= {recovery} * {count} THEN 'HEALTHY' ELSE 'GRAY' END AS verdict,
  CASE WHEN NOT el THEN 'INSUFFICIENT_EVIDENCE' WHEN {count} < {minimum} THEN 'LOW_VOLUME' WHEN {total} > {trigger} * {count} THEN 'TRIGGER_EXCEEDED' WHEN {total} <= {recovery} * {count} THEN 'RECOVERY_BOUNDARY' ELSE 'HYSTERESIS' END AS reason,
  CASE WHEN el AND {count} >= {minimum} AND {total} > {trigger} * {count} THEN CASE WHEN {total} > {critical} * {count} THEN 'CRITICAL' ELSE 'HIGH' END END AS severity"""


@query(
    "rul_04_transport_loss_and_rtt",
    sql(
        f"""
SELECT link_id, slot, 'loss' AS rule, {absolute_sql("lost * 100", "packets", 1000, 2, 1, 4)} FROM ev
UNION ALL SELECT link_id, slot, 'rtt', {absolute_sql("rtt_sum", "samples", 30, 100, 80, 200)} FROM ev""",
        "link5m", ev=_LINK_SQL,
    ),
)
def transport_rules(t: Tables):
    rows = link_evidence(t)
    ok = rules.evidence_eligible()
    loss = rules.absolute_rule(ok, F.col("lost"), F.col("packets"), policies.LOSS, 100)
    rtt = rules.absolute_rule(ok, F.col("rtt_sum"), F.col("samples"), policies.RTT)
    entry = [F.struct(F.lit(n).alias("rule"), *[c.alias(k) for k, c in r.items()]) for n, r in (("loss", loss), ("rtt", rtt))]
    return rows.select("link_id", "slot", F.explode(F.array(*entry)).alias("r")).select("link_id", "slot", "r.*")


@query(
    "rul_05_overload_candidates",
    sql("SELECT link_id, slot, el AND capacity > 0 AND utilization >= 85 AS candidate FROM ev", "link5m", ev=_LINK_SQL),
)
def overload(t: Tables):
    return link_evidence(t).select("link_id", "slot", rules.overload_candidate(rules.evidence_eligible(), F.col("utilization"), F.col("capacity")).alias("candidate"))


RATE_SQL = """
SELECT partner_id || ':' || direction AS scope_id, slot, 'ROAMING_' || p AS kind, n, d, CASE WHEN slot % 19 <> 0 THEN 98 + slot % 2 END AS center, CASE WHEN slot % 23 = 0 THEN 'other' ELSE 'seasonal-v1' END AS version, slot % 31 <> 0 AS el
FROM (SELECT partner_id, direction, slot, 'REGISTRATION' AS p, reg_success AS n, reg_attempts AS d FROM roam5m UNION ALL SELECT partner_id, direction, slot, 'DATA', data_success, data_attempts FROM roam5m
  UNION ALL SELECT partner_id, direction, slot, 'VOICE', voice_success, voice_attempts FROM roam5m)
UNION ALL SELECT city_id, slot, 'MOBILE_DATA_' || p, n, d, CASE WHEN slot % 19 <> 0 THEN 98 + slot % 2 END, CASE WHEN slot % 23 = 0 THEN 'other' ELSE 'seasonal-v1' END, slot % 31 <> 0
FROM (SELECT city_id, slot, 'ACTIVATION' AS p, data_success AS n, data_attempts AS d FROM city5m UNION ALL SELECT city_id, slot, 'DNS', dns_success, dns_attempts FROM city5m)"""


def rate_evidence(t: Tables):
    def shape(df, scope: str, kinds: list[tuple[str, str, str]]):
        packed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(n).alias("n"), F.col(d).alias("d")) for k, n, d in kinds])
        return df.select(F.expr(scope).alias("scope_id"), "slot", "ts", F.explode(packed).alias("e")).select("scope_id", "slot", "ts", "e.*")

    rows = shape(t.roam5m, "concat_ws(':', partner_id, direction)", [
        ("ROAMING_REGISTRATION", "reg_success", "reg_attempts"), ("ROAMING_DATA", "data_success", "data_attempts"), ("ROAMING_VOICE", "voice_success", "voice_attempts"),
    ]).unionByName(shape(t.city5m, "city_id", [
        ("MOBILE_DATA_ACTIVATION", "data_success", "data_attempts"), ("MOBILE_DATA_DNS", "dns_success", "dns_attempts")]))
    return rows.selectExpr(
        "*", "CASE WHEN slot % 19 <> 0 THEN 98 + slot % 2 END AS center", "CASE WHEN slot % 23 = 0 THEN 'other' ELSE 'seasonal-v1' END AS version",
        "CASE WHEN slot % 31 = 0 THEN 'PARTIAL' ELSE 'VALID' END AS quality", "'FRESH' AS freshness", "1D AS actual", "1D AS coverage", "ts AS observed_at", "timestampadd(SECOND, 300, ts) AS as_of")


_WD = "(center * d - n * 100)"
RATE_VERDICT_SQL = f"""CASE WHEN NOT el OR d < 100 OR center IS NULL OR version <> 'seasonal-v1' THEN 'UNKNOWN' WHEN {_WD} > d THEN 'BREACH' WHEN 2 * {_WD} <= d THEN 'HEALTHY' ELSE 'GRAY' END AS verdict,
  CASE WHEN NOT el THEN 'INSUFFICIENT_EVIDENCE' WHEN d < 100 THEN 'LOW_VOLUME' WHEN center IS NULL THEN 'BASELINE_UNAVAILABLE' WHEN version <> 'seasonal-v1' THEN 'BASELINE_VERSION_MISMATCH'
    WHEN {_WD} > d THEN 'TRIGGER_EXCEEDED' WHEN 2 * {_WD} <= d THEN 'RECOVERY_BOUNDARY' ELSE 'HYSTERESIS' END AS reason,
  CASE WHEN el AND d >= 100 AND version = 'seasonal-v1' AND {_WD} > d THEN CASE WHEN {_WD} > 2 * d THEN 'CRITICAL' ELSE 'HIGH' END END AS severity"""


def rate_verdicts(t: Tables):
    rows = rate_evidence(t)
    out = rules.rate_drop_rule(rules.evidence_eligible(), F.col("n"), F.col("d"), F.col("center"), F.col("version"))
    return rows.select("scope_id", "slot", "ts", "kind", "n", "d", "center", *[c.alias(k) for k, c in out.items()])


@query("rul_06_rate_drop_rule", sql(f"SELECT scope_id, slot, kind, {RATE_VERDICT_SQL} FROM ev", "city5m", "roam5m", ev=RATE_SQL))
def rate_drop(t: Tables):
    return rate_verdicts(t).select("scope_id", "slot", "kind", "verdict", "reason", "severity")


@query("rul_07_evidence_eligibility", sql("SELECT link_id, slot, el AS eligible FROM ev", "link5m", ev=_LINK_SQL))
def eligibility(t: Tables):
    return link_evidence(t).select("link_id", "slot", rules.evidence_eligible().alias("eligible"))


@query(
    "rul_08_minute_policy",
    sql(
        """
SELECT scope_id, kind, slot, CASE WHEN NOT ok THEN 'UNKNOWN' WHEN 99 * d - 100 * n >= 5 * d THEN 'BREACH' WHEN 99 * d - 100 * n <= d THEN 'HEALTHY' ELSE 'GRAY' END AS verdict,
  CASE WHEN age > 120 THEN 'STALE_SOURCE' WHEN NOT el THEN 'INSUFFICIENT_EVIDENCE' WHEN d < 100 THEN 'MINIMUM_VOLUME' WHEN slot % 19 = 0 THEN 'BASELINE_UNAVAILABLE'
    WHEN 99 * d - 100 * n >= 5 * d THEN 'STATIC_RATE_DROP' WHEN 99 * d - 100 * n <= d THEN 'OBSERVED_HEALTHY_POPULATION' ELSE 'HYSTERESIS_BAND' END AS reason,
  CASE WHEN ok AND 99 * d - 100 * n >= 5 * d THEN CASE WHEN 99 * d - 100 * n >= 20 * d THEN 'CRITICAL' ELSE 'HIGH' END END AS severity
FROM (SELECT *, el AND age <= 120 AND d >= 100 AND slot % 19 <> 0 AS ok FROM (SELECT scope_id, kind, slot, el, d, CASE WHEN slot % 3 = 0 THEN n * (70 + slot % 30) // 100 ELSE n END AS n, 100 + slot % 25 AS age FROM ev))""",
        "city5m", "roam5m", ev=RATE_SQL,
    ),
)
def minute_policy(t: Tables):
    rows = rate_evidence(t).withColumn("n", F.expr("CASE WHEN slot % 3 = 0 THEN n * (70 + slot % 30) DIV 100 ELSE n END")).withColumn("age", F.expr("100 + slot % 25"))
    out = rules.minute_rate_rule(F.col("quality") == "VALID", F.col("age"), F.col("n"), F.col("d"), F.expr("slot % 19 <> 0"))
    return rows.select("scope_id", "kind", "slot", *[c.alias(k) for k, c in out.items()])


@query(
    "rul_08_minute_utilization",
    sql(
        """
SELECT link_id, slot, CASE WHEN slot % 25 > 20 OR slot % 31 = 0 OR slot % 13 = 0 THEN 'UNKNOWN' WHEN utilization >= 85 THEN 'CANDIDATE' ELSE 'HEALTHY' END AS verdict,
  CASE WHEN slot % 25 > 20 THEN 'STALE_SOURCE' WHEN slot % 31 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN slot % 13 = 0 THEN 'TRANSPORT_EVIDENCE_INCOMPLETE' WHEN utilization >= 85 THEN 'UTILIZATION_ONLY' ELSE 'BELOW_OVERLOAD_CANDIDATE' END AS reason FROM ev""",
        "link5m", ev=_LINK_SQL,
    ),
)
def minute_utilization(t: Tables):
    out = rules.minute_utilization_rule(F.col("quality") == "VALID", F.expr("100 + slot % 25"), F.expr("slot % 13 <> 0"), F.col("utilization"))
    return link_evidence(t).select("link_id", "slot", *[c.alias(k) for k, c in out.items()])


@query(
    "rul_10_deviation_and_impact",
    sql(
        f"""
SELECT scope_id, slot, kind, {num_sql("CASE WHEN center IS NOT NULL THEN 100.0::DOUBLE * n / nullif(d, 0) - center END")} AS deviation, {num_sql(f"greatest({_WD}, 0) / 100.0::DOUBLE")} AS extra_failures FROM ev""",
        "city5m", "roam5m", ev=RATE_SQL,
    ),
)
def deviation(t: Tables):
    from vigilmesh.functions.arithmetic import percent

    rows = rate_verdicts(t)
    status = F.when(F.col("center").isNull(), "BASELINE_UNAVAILABLE").otherwise("DIRECT")
    dev = rules.baseline_deviation(percent(F.col("n"), F.col("d")), F.col("center"), status)
    extra = F.greatest(F.col("center") * F.col("d") - F.col("n") * 100, F.when(F.col("center").isNotNull(), 0)) / 100
    return rows.select("scope_id", "slot", "kind", num(dev, "deviation"), num(F.coalesce(extra, F.lit(0)), "extra_failures"))
