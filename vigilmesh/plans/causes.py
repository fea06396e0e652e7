"""Cause attribution: JON-11, CAU-1…5, RUL-9."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmesh.adapters import Tables, slot_ts as at_slot
from vigilmesh.operators import cause, rules
from vigilmesh.oracle_views import slot_ts, sql
from vigilmesh.plans.common import when, when_sql  # noqa: F401
from vigilmesh.plans.detection import _LINK_SQL, link_evidence
from vigilmesh.registry import query

# The same expressions build the inputs in both engines; only functions that read alike are used.
_SYMPTOM = """partner_id || '|' || direction || '|' || slot AS symptom_id, 'ROAMING' AS domain, 'd1' AS dataset, partner_id || ':' || direction AS scope_id,
  CASE WHEN slot % 29 = 0 THEN 't0' ELSE 't1' END AS topology, 'seasonal-v1' AS baseline_version, ts AS from_ts, ts + INTERVAL '300' SECOND AS to_ts, ts + INTERVAL '300' SECOND AS evaluated_at"""
_VERDICT = "CASE WHEN 99 * reg_attempts - 100 * reg_success > reg_attempts THEN 'BREACH' ELSE 'HEALTHY' END AS verdict"
_COMMON = """CASE WHEN slot % 37 = 0 THEN 'd2' ELSE 'd1' END AS e_dataset, CASE WHEN slot % 41 = 0 THEN 't9' WHEN slot % 29 = 0 THEN 't0' ELSE 't1' END AS e_topology,
  CASE WHEN slot % 43 = 0 THEN ts + INTERVAL '300' SECOND ELSE ts END AS e_from, CASE WHEN slot % 43 = 0 THEN ts + INTERVAL '600' SECOND ELSE ts + INTERVAL '300' SECOND END AS e_to,
  CASE WHEN slot % 47 = 0 THEN 'STALE' WHEN slot % 53 = 0 THEN 'PARTIAL' ELSE 'VALID' END AS q_state, 'FRESH' AS f_state, 1 AS coverage,
  CASE WHEN slot % 59 = 0 THEN ts + INTERVAL '360' SECOND ELSE ts + INTERVAL '300' SECOND END AS as_of, CASE WHEN slot % 61 = 0 THEN ts - INTERVAL '1000' SECOND ELSE ts END AS observed_at,
  slot % 73 <> 0 AS evidence_valid"""
_CLEAN = """'d1' AS e_dataset, CASE WHEN slot % 29 = 0 THEN 't0' ELSE 't1' END AS e_topology, ts AS e_from, ts + INTERVAL '300' SECOND AS e_to, 'VALID' AS q_state, 'FRESH' AS f_state, 1 AS coverage,
  ts + INTERVAL '300' SECOND AS as_of, ts AS observed_at, slot % 79 <> 0 AS evidence_valid"""
_LINK_PATH = "'src' || (slot % 2) AS source_id, 'p' || (slot % 3) AS path_id"
_HYPOTHESIS = "CASE WHEN slot % 31 = 0 THEN 'OTHER' ELSE 'ROAMING_DEPENDENCY_HYPOTHESIS' END AS hypothesis"
_RATE_A = """'roaming.registration.success' AS metric_id, reg_success AS total, reg_attempts AS population, TRUE AS is_ratio, CASE WHEN slot % 67 = 0 THEN NULL ELSE 99 END AS e_baseline,
  CASE WHEN slot % 71 = 0 THEN 'other' ELSE 'seasonal-v1' END AS e_baseline_version"""
_RTT = "'transport.rtt.mean' AS metric_id, {total} AS total, {pop} AS population, FALSE AS is_ratio, CAST(NULL AS INT) AS e_baseline, CAST(NULL AS VARCHAR(20)) AS e_baseline_version"
_OPPOSITE = "CASE WHEN direction = 'in' THEN 'out' ELSE 'in' END"

CANDIDATE_PARTS = [
    (f"'a' AS candidate_id, 'a-' || partner_id || direction || slot AS evidence_id, {_HYPOTHESIS}, {_LINK_PATH}, partner_id AS e_scope, direction AS e_direction, {_SYMPTOM}, {_COMMON}, {_RATE_A}", "TRUE"),
    (f"'b' AS candidate_id, 'b-' || partner_id || direction || slot AS evidence_id, {_HYPOTHESIS}, {_LINK_PATH}, 'L' || (slot % 12) AS e_scope, 'a-to-b' AS e_direction, {_SYMPTOM}, {_COMMON}, {_RTT.format(total='(20 + slot % 40) * (60 + slot % 90)', pop='20 + slot % 40')}", "TRUE"),
]
CONTROL_PARTS = [
    (f"'a' AS candidate_id, 'OPPOSITE_DIRECTION' AS kind, 'ca-' || partner_id || direction || slot AS evidence_id, {_LINK_PATH}, partner_id AS e_scope, {_OPPOSITE} AS e_direction, {_SYMPTOM}, {_CLEAN}, "
    f"'roaming.registration.success' AS metric_id, CASE WHEN slot % 5 = 0 THEN 900 ELSE 990 END AS total, 1000 AS population, TRUE AS is_ratio, 99 AS e_baseline, 'seasonal-v1' AS e_baseline_version", "slot % 7 <> 0"),
    (f"'b' AS candidate_id, CASE WHEN slot % 2 = 0 THEN 'CONTRADICTORY' ELSE 'OPPOSITE_DIRECTION' END AS kind, 'cb-' || partner_id || direction || slot AS evidence_id, {_LINK_PATH}, 'L' || (slot % 12) AS e_scope, "
    f"CASE WHEN slot % 2 = 0 THEN 'a-to-b' ELSE 'b-to-a' END AS e_direction, {_SYMPTOM}, {_CLEAN}, {_RTT.format(total='CASE WHEN slot % 4 = 0 OR slot % 3 = 1 THEN 5000 ELSE 15000 END', pop='100')}", "TRUE"),
]
CAND_SQL, CTL_SQL = (
    " UNION ALL ".join(f"SELECT {fields} FROM roam5m WHERE {keep}" for fields, keep in parts) for parts in (CANDIDATE_PARTS, CONTROL_PARTS))
SYM_SQL = f"SELECT {_SYMPTOM}, {_VERDICT} FROM roam5m"
REL_SQL = f"""
SELECT 'r-' || p.scope_id || '-' || g.t || '-' || w.path || '-' || w.src || '-' || c.k AS relation_id, p.scope_id, CASE WHEN g.t = 12 THEN p.partner_id ELSE 'L' || g.t END AS target_scope, 'p' || w.path AS path_id, 'src' || w.src AS source_id, 't1' AS topology,
  {slot_ts("0")} AS valid_from, CASE WHEN g.t = 3 THEN {slot_ts("4320")} ELSE {slot_ts("8640")} END AS valid_to
FROM partners p, range(13) g(t), (SELECT unnest([0, 1, 1, 2]) AS path, unnest([0, 0, 1, 1]) AS src) w, range(2) c(k) WHERE g.t <> 5 AND (c.k = 0 OR g.t = 4)"""


def frame(t: Tables, parts: list[tuple[str, str]]):
    """Several evidence rows per roaming slot, all from one pass over the slots."""
    rows = ", ".join(f"struct({fields}, {keep} AS kept)" for fields, keep in parts)
    return t.roam5m.selectExpr(f"inline(array({rows}))").where("kept").drop("kept")


def symptoms(t: Tables):
    return frame(t, [(f"{_SYMPTOM}, {_VERDICT}", "TRUE")])


def relations(t: Tables):
    """Configured relations: partners × targets × paths."""
    rows = t.partners.select(
        "scope_id", "partner_id", F.explode(F.expr("sequence(0, 12)")).alias("t")
    ).select("*", F.expr("explode(array(named_struct('path', 0, 'src', 0), named_struct('path', 1, 'src', 0), named_struct('path', 1, 'src', 1), named_struct('path', 2, 'src', 1))) AS w")).select(
        "*", F.expr("explode(CASE WHEN t = 4 THEN array(0, 1) ELSE array(0) END) AS k")).where("t <> 5")
    return rows.selectExpr(
        "concat('r-', scope_id, '-', t, '-', w.path, '-', w.src, '-', k) AS relation_id", "scope_id", "CASE WHEN t = 12 THEN partner_id ELSE concat('L', t) END AS target_scope",
        "concat('p', w.path) AS path_id", "concat('src', w.src) AS source_id", "'t1' AS topology", f"{at_slot('0')} AS valid_from",
        f"{at_slot('CASE WHEN t = 3 THEN 4320 ELSE 8640 END')} AS valid_to")


def candidates(t: Tables):
    rows = cause.mark_conflicts(
        frame(t, CANDIDATE_PARTS), ["symptom_id", "candidate_id"], F.sha2(F.concat_ws("|", "evidence_id", "hypothesis", "source_id", "path_id"), 256))
    return cause.eligibility(rows, relations(t))


def controls(t: Tables):
    return cause.eligibility(frame(t, CONTROL_PARTS), relations(t))


def judged_sql(items: str) -> str:
    return f"""
SELECT i.*, n.sm, n.om, n.ot, n.vm, n.sel, t.comparison, t.threshold, t.min_samples, CASE WHEN NOT evidence_valid THEN 'INVALID_EVIDENCE' WHEN e_dataset <> dataset THEN 'WRONG_DATASET_OR_NAMESPACE' WHEN e_topology <> i.topology THEN 'TOPOLOGY_MISMATCH'
  WHEN greatest(e_from, from_ts) >= least(e_to, to_ts) THEN 'NO_TIME_OVERLAP' WHEN q_state = 'STALE' THEN 'STALE_EVIDENCE' WHEN q_state <> 'VALID' THEN 'INVALID_QUALITY' WHEN as_of <> evaluated_at THEN 'WRONG_EVALUATION_TIME'
  WHEN epoch(evaluated_at) - epoch(observed_at) NOT BETWEEN 0 AND 600 THEN 'STALE_EVIDENCE' WHEN sm = 0 THEN 'WRONG_SCOPE_OR_PATH' WHEN om = 0 THEN 'SOURCE_NOT_AUTHORIZED' WHEN ot > 0 THEN 'TOPOLOGY_MISMATCH' WHEN vm = 0 THEN 'NO_EVENT_TIME_DEPENDENCY'
  WHEN vm > 1 THEN 'AMBIGUOUS_DEPENDENCY' WHEN comparison = 'DROP_PP_GT' AND e_baseline IS NULL THEN 'BASELINE_UNAVAILABLE' WHEN comparison = 'DROP_PP_GT' AND e_baseline_version <> baseline_version THEN 'BASELINE_VERSION_MISMATCH' WHEN population < min_samples THEN 'INSUFFICIENT_SAMPLES' END AS reason,
  CASE WHEN comparison = 'GT' THEN total > threshold * population ELSE e_baseline * population - 100 * total > threshold * population END AS impaired
FROM {items} i JOIN (SELECT i.symptom_id, i.candidate_id, count(r.relation_id) AS sm, count(*) FILTER (WHERE r.source_id = i.source_id) AS om, count(*) FILTER (WHERE r.source_id = i.source_id AND r.topology <> i.topology) AS ot,
    count(*) FILTER (WHERE r.source_id = i.source_id AND r.topology = i.topology AND valid_from <= greatest(e_from, from_ts) AND valid_to >= least(e_to, to_ts)) AS vm,
    min(relation_id) FILTER (WHERE r.source_id = i.source_id AND r.topology = i.topology AND valid_from <= greatest(e_from, from_ts) AND valid_to >= least(e_to, to_ts)) AS sel
  FROM {items} i LEFT JOIN rel r ON r.scope_id = i.scope_id AND r.target_scope = i.e_scope AND r.path_id = i.path_id GROUP BY 1, 2) n ON n.symptom_id = i.symptom_id AND n.candidate_id = i.candidate_id
LEFT JOIN (SELECT * FROM (VALUES ('transport.rtt.mean', 'GT', 100, 30), ('roaming.registration.success', 'DROP_PP_GT', 1, 100)) v(metric_id, comparison, threshold, min_samples)) t ON t.metric_id = i.metric_id"""


EFFECT_SQL = """
SELECT symptom_id, candidate_id, control_reason, control_reason IS NULL AND kind = 'OPPOSITE_DIRECTION' AS seen, control_reason IS NULL AND CASE WHEN kind = 'OPPOSITE_DIRECTION' THEN impaired ELSE NOT impaired END AS contra
FROM (SELECT l.*, CASE WHEN l.reason IS NOT NULL THEN l.reason WHEN NOT (l.e_scope = c.e_scope AND l.metric_id = c.metric_id AND CASE WHEN kind = 'OPPOSITE_DIRECTION' THEN l.e_direction <> c.e_direction ELSE l.e_direction = c.e_direction END) THEN 'WRONG_SCOPE_OR_PATH' END AS control_reason
  FROM jctl l JOIN jcand c ON c.symptom_id = l.symptom_id AND c.candidate_id = l.candidate_id)"""
VERDICT_SQL = """
SELECT c.*, CASE WHEN hypothesis <> 'ROAMING_DEPENDENCY_HYPOTHESIS' THEN 'UNSUPPORTED_HYPOTHESIS' WHEN reason IS NOT NULL THEN reason WHEN NOT impaired THEN 'BELOW_SUPPORT_THRESHOLD' WHEN coalesce(e.contra, FALSE) THEN 'CONTRADICTORY_CONTROL' WHEN NOT coalesce(e.seen, FALSE) THEN 'MISSING_REQUIRED_CONTROL' END AS final_reason
FROM jcand c LEFT JOIN (SELECT symptom_id, candidate_id, bool_or(seen) AS seen, bool_or(contra) AS contra FROM effects GROUP BY 1, 2) e ON e.symptom_id = c.symptom_id AND e.candidate_id = c.candidate_id"""
OUTCOME_SQL = """
SELECT s.symptom_id, s.verdict, CASE WHEN s.verdict = 'BREACH' AND v.n = 1 THEN 'SUPPORTED_HYPOTHESIS' ELSE 'UNDETERMINED' END AS status, CASE WHEN s.verdict = 'BREACH' AND v.n = 1 THEN v.sel END AS relation_id,
  CASE WHEN s.verdict <> 'BREACH' THEN 'NO_SYMPTOM' ELSE coalesce((SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT final_reason AS r FROM verdicts x WHERE x.symptom_id = s.symptom_id AND final_reason IS NOT NULL UNION ALL SELECT control_reason FROM effects y WHERE y.symptom_id = s.symptom_id AND control_reason IS NOT NULL
    UNION ALL SELECT 'AMBIGUOUS_CANDIDATES' WHERE v.n > 1)), CASE WHEN v.n = 0 THEN 'NO_DEPENDENCY' ELSE '' END) END AS reason_codes
FROM sym s LEFT JOIN (SELECT symptom_id, count(*) FILTER (WHERE final_reason IS NULL) AS n, min(sel) FILTER (WHERE final_reason IS NULL) AS sel FROM verdicts GROUP BY 1) v ON v.symptom_id = s.symptom_id"""
CAUSE_VIEWS = {"sym": SYM_SQL, "cand": CAND_SQL, "ctl": CTL_SQL, "rel": REL_SQL, "jcand": judged_sql("cand"), "jctl": judged_sql("ctl"), "effects": EFFECT_SQL, "verdicts": VERDICT_SQL}


def cause_sql(body: str, *views: str, **more: str) -> str:
    return sql(body, "roam5m", "partners", *views, **CAUSE_VIEWS, **more)


@query("jon_11_dependency_join", cause_sql("SELECT symptom_id, candidate_id, sm AS scope_matches, om AS source_matches, vm AS valid_matches, sel AS selected_relation FROM jcand"))
def dependency_join(t: Tables):
    rows = frame(t, CANDIDATE_PARTS)
    return cause.relation_counts(rows, relations(t)).select(
        "symptom_id", "candidate_id", "scope_matches", "source_matches", "valid_matches", "selected_relation")


@query("cau_01_candidate_eligibility", cause_sql("SELECT symptom_id, candidate_id, reason FROM jcand"))
def candidate_eligibility(t: Tables):
    return candidates(t).select("symptom_id", "candidate_id", "reason")


@query("cau_02_support_threshold", cause_sql("SELECT symptom_id, candidate_id, metric_id, impaired FROM jcand"))
def support_threshold(t: Tables):
    return candidates(t).select("symptom_id", "candidate_id", "metric_id", "impaired")


@query("cau_03_control_effects", cause_sql("SELECT symptom_id, candidate_id, control_reason, seen AS opposite_seen, contra AS contradicts FROM effects"))
def control_effects(t: Tables):
    return cause.control_effects(candidates(t), controls(t)).select("symptom_id", "candidate_id", "control_reason", "opposite_seen", "contradicts")


def results(t: Tables):
    return cause.outcomes(symptoms(t), cause.candidate_verdicts(candidates(t), controls(t)))


@query("cau_04_cause_outcomes", cause_sql("SELECT * FROM outcome", outcome=OUTCOME_SQL))
def cause_outcomes(t: Tables):
    return results(t).select("symptom_id", "verdict", "status", "relation_id", F.array_join("reason_codes", ",").alias("reason_codes"))


@query(
    "cau_05_cause_presentation",
    """
SELECT event_id, CASE WHEN ok THEN 'HYPOTHESIS' ELSE 'UNDETERMINED' END AS cause_status, CASE WHEN ok THEN trim(c) END AS probable_cause FROM (SELECT *, coalesce(event_id % 7 <> 0 AND event_id % 5 <> 0 AND trim(c) <> '' AND NOT contains(lower(c), 'undetermined') AND event_id % 4 > 1, FALSE) AS ok
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' IMS capacity ' WHEN 1 THEN 'Undetermined cause' ELSE 'SMSC backlog' END AS c FROM events))""",
)
def presentation(t: Tables):
    rows = t.events.select(
        "event_id", F.expr("CASE event_id % 3 WHEN 0 THEN ' IMS capacity ' WHEN 1 THEN 'Undetermined cause' ELSE 'SMSC backlog' END").alias("c"),
        F.expr("CASE event_id % 4 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('PING_RESULT', 'PROBE_WORKER_HEALTH') WHEN 2 THEN array('PING_RESULT', 'SMSC_QUEUE') ELSE array('SMS_DELIVERY_DELAY') END").alias("codes"))
    out = cause.presentation(F.expr("event_id % 7 = 0"), F.expr("event_id % 5 <> 0"), F.col("c"), F.lit("LOW"), F.col("codes"))
    return rows.select("event_id", out["cause_status"].alias("cause_status"), out["probable_cause"].alias("probable_cause"))


@query(
    "rul_09_overload_with_service",
    cause_sql(
        """
SELECT symptom_id, CASE WHEN NOT mapped THEN 'UNKNOWN' WHEN verdict = 'BREACH' AND NOT over THEN 'GRAY' WHEN verdict = 'BREACH' AND status <> 'SUPPORTED_HYPOTHESIS' THEN 'UNKNOWN' ELSE verdict END AS verdict,
  CASE WHEN NOT mapped THEN 'MAPPED_SERVICE_EVIDENCE_UNAVAILABLE' WHEN verdict = 'BREACH' AND NOT over THEN 'OVERLOAD_NOT_PRESENT' WHEN verdict = 'BREACH' AND status <> 'SUPPORTED_HYPOTHESIS' THEN 'UNSUPPORTED_MAPPED_SERVICE' ELSE 'MAPPED_SERVICE_' || verdict END AS reason
FROM (SELECT o.*, coalesce(l.el AND l.capacity > 0, FALSE) AND s.slot % 17 <> 0 AND c.reason IS NULL AS mapped, coalesce(l.el AND l.capacity > 0 AND l.utilization >= 30, FALSE) AS over FROM outcome o JOIN slots s ON s.symptom_id = o.symptom_id
  JOIN jcand c ON c.symptom_id = o.symptom_id AND c.candidate_id = 'a' LEFT JOIN ev l ON l.link_id = 'L' || (s.slot % 12) AND l.slot = s.slot)""",
        "link5m", outcome=OUTCOME_SQL, slots="SELECT partner_id || '|' || direction || '|' || slot AS symptom_id, slot FROM roam5m", ev=_LINK_SQL),
)
def overload_with_service(t: Tables):
    ok = rules.evidence_eligible()
    links = link_evidence(t).select(
        "link_id", "slot", (ok & (F.col("capacity") > 0)).alias("known"), (ok & (F.col("capacity") > 0) & (F.col("utilization") >= 30)).alias("over"))
    slots = t.roam5m.select(F.concat_ws("|", "partner_id", "direction", "slot").alias("symptom_id"), "slot", F.expr("concat('L', slot % 12)").alias("link_id"))
    mapped = candidates(t).where("candidate_id = 'a'").select("symptom_id", F.when(F.col("reason").isNull(), 1).otherwise(0).alias("mappings"))
    j = results(t).join(slots, "symptom_id").join(mapped, "symptom_id").join(links, ["link_id", "slot"], "left")
    out = rules.overload_with_service(
        F.coalesce("known", F.lit(False)), F.coalesce("over", F.lit(False)), F.col("verdict"), F.expr("slot % 17 = 0"), F.col("mappings"), F.col("status") == "SUPPORTED_HYPOTHESIS")
    return j.select("symptom_id", out["verdict"].alias("verdict"), out["reason"].alias("reason"))
