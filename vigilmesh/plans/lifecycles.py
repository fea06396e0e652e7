"""Episodes, incidents and read models: STR-13…21, JON-13…15, AGG-29, QRY-1…13."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmesh.adapters import ARCHIVE_END, ARCHIVE_START, Tables, slot_ts as at_slot
from vigilmesh.dictionary import dictionary_df
from vigilmesh.operators import episodes, guards, incidents, serving, topology
from vigilmesh.operators.filters import optional
from vigilmesh.operators.paging import page
from vigilmesh.operators.rollup import Request, reference_series, ts_lit
from vigilmesh.oracle_views import slot_ts, sql
from vigilmesh.plans.common import num, num_sql, when, when_sql
from vigilmesh.plans.rollups import publish, series_oracle
from vigilmesh.plans.selections import HOUR_VERDICT
from vigilmesh.registry import query

SERIES_EXPR = f"""
SELECT scope_id, window_start, window_end, attempts, success, amount, last_event_id, {HOUR_VERDICT} AS verdict,
  CASE WHEN peak > 40000 THEN 'CRITICAL' WHEN peak > 15000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  scope_id IN ('S1', 'S3', 'S5') AS backlog_required, CASE attempts % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS drained FROM kpi_hour"""


def series(t: Tables):
    """One judged window per scope and hour."""
    return t.kpi_hour.selectExpr(
        "scope_id", "window_start", "window_end", "attempts", "success", "amount", "last_event_id", f"{HOUR_VERDICT} AS verdict",
        "CASE WHEN peak > 40000 THEN 'CRITICAL' WHEN peak > 15000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity",
        "scope_id IN ('S1', 'S3', 'S5') AS backlog_required", "CASE attempts % 3 WHEN 1 THEN true WHEN 2 THEN false END AS drained")


def domain_series(t: Tables):
    return series(t).withColumn("severity", F.expr("CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END"))


_BASE = """SELECT *, CASE WHEN {dom} THEN CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END ELSE severity END AS sv, row_number() OVER (PARTITION BY scope_id ORDER BY window_start) AS rn FROM hours"""
_SEED = """
SELECT scope_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS ws, CAST(NULL AS TIMESTAMP) AS e, 0 AS bad, 0 AS healthy, FALSE AS active, CAST(NULL AS TIMESTAMP) AS cand,
  CAST(NULL AS TIMESTAMP) AS first_at, 0 AS seq, CAST(NULL AS VARCHAR) AS phase, CAST(NULL AS VARCHAR) AS sev, CAST(NULL AS VARCHAR) AS shown FROM (SELECT DISTINCT scope_id FROM hours)"""


def service_machine() -> dict[str, str]:
    """The service lifecycle as a row-by-row recursion: the sequential statement of the same machine."""
    step = """
SELECT scope_id, rn, ws, e2, CASE WHEN phase = 'RECOVERY' THEN 0 ELSE bad1 END, healthy1, opens OR (active AND phase <> 'RECOVERY'), cand1, CASE WHEN opens THEN cand1 ELSE first_at END,
  CASE WHEN opens THEN 1 WHEN phase IS NOT NULL THEN seq + 1 ELSE seq END, phase, CASE WHEN phase IN ('OPEN', 'UPDATE') AND verdict = 'BREACH' THEN sv ELSE sev END, CAST(NULL AS VARCHAR)
FROM (SELECT *, NOT active AND bad1 >= 2 AS opens, CASE WHEN NOT active THEN CASE WHEN bad1 >= 2 THEN 'OPEN' END WHEN NOT adjacent OR verdict = 'UNKNOWN' THEN 'UNKNOWN' WHEN healthy1 >= 3 THEN 'RECOVERY' ELSE 'UPDATE' END AS phase
  FROM (SELECT *, CASE WHEN verdict = 'BREACH' AND bad0 = 0 THEN ws ELSE cand END AS cand1, CASE WHEN verdict = 'BREACH' THEN bad0 + 1 ELSE 0 END AS bad1, CASE WHEN verdict = 'HEALTHY' THEN healthy0 + 1 ELSE 0 END AS healthy1
    FROM (SELECT m.scope_id, b.rn, b.window_start AS ws, b.window_end AS e2, b.verdict, b.sv, m.active, m.cand, m.first_at, m.seq, m.sev, coalesce(b.window_start = m.e, FALSE) AS adjacent,
        CASE WHEN coalesce(b.window_start = m.e, FALSE) THEN m.bad ELSE 0 END AS bad0, CASE WHEN coalesce(b.window_start = m.e, FALSE) THEN m.healthy ELSE 0 END AS healthy0
      FROM machine m JOIN base b ON b.scope_id = m.scope_id AND b.rn = m.rn + 1)))"""
    return {"hours": SERIES_EXPR, "base": _BASE.format(dom="FALSE"), "machine": f"{_SEED}\nUNION ALL{step}"}


def domain_machine(candidate: bool) -> dict[str, str]:
    """``candidate``: severity counts from the first breach of the run (domain) or from the opening (minute)."""
    raise_from_candidate = (
        "CASE WHEN v = 'BREACH' THEN CASE WHEN coalesce(sev, '') <> 'CRITICAL' THEN sv ELSE sev END WHEN NOT active THEN NULL ELSE sev END"
        if candidate
        else "CASE WHEN NOT active AND v = 'BREACH' THEN CASE WHEN bad1 >= 2 THEN sv END WHEN NOT active THEN NULL WHEN v = 'BREACH' AND sv = 'CRITICAL' THEN 'CRITICAL' ELSE sev END"
    )
    gate = (
        "CASE WHEN gap THEN 'UNKNOWN' WHEN active AND verdict = 'HEALTHY' AND breq AND drained IS NULL THEN 'UNKNOWN' WHEN active AND verdict = 'HEALTHY' AND breq AND NOT drained THEN 'GRAY' ELSE verdict END"
        if candidate else "CASE WHEN gap THEN 'UNKNOWN' ELSE verdict END"
    )
    step = f"""
SELECT scope_id, rn, ws, e2, CASE WHEN phase = 'RECOVERY' THEN 0 ELSE bad1 END, CASE WHEN phase = 'RECOVERY' THEN 0 ELSE healthy1 END, opens OR (active AND phase <> 'RECOVERY'), cand1,
  CASE WHEN opens THEN cand1 ELSE first_at END, CASE WHEN opens THEN 1 WHEN phase IS NOT NULL THEN seq + 1 ELSE seq END, phase, CASE WHEN phase = 'RECOVERY' THEN NULL ELSE sev1 END, sev1
FROM (SELECT *, NOT active AND bad1 >= 2 AS opens, {raise_from_candidate} AS sev1,
    CASE WHEN NOT active THEN CASE WHEN bad1 >= 2 THEN 'OPEN' END WHEN v = 'UNKNOWN' THEN 'UNKNOWN' WHEN healthy1 >= 3 THEN 'RECOVERY' ELSE 'UPDATE' END AS phase
  FROM (SELECT *, CASE WHEN v = 'BREACH' AND bad = 0 THEN ws ELSE cand END AS cand1, CASE WHEN v = 'BREACH' THEN bad + 1 ELSE 0 END AS bad1, CASE WHEN v = 'HEALTHY' THEN healthy + 1 ELSE 0 END AS healthy1
    FROM (SELECT *, {gate} AS v FROM (SELECT m.scope_id, b.rn, b.window_start AS ws, b.window_end AS e2, b.verdict, b.sv, b.backlog_required AS breq, b.drained, m.active, m.bad, m.healthy, m.cand, m.first_at, m.seq, m.sev,
        m.e IS NOT NULL AND m.e <> b.window_start AS gap
      FROM machine m JOIN base b ON b.scope_id = m.scope_id AND b.rn = m.rn + 1))))"""
    return {"hours": SERIES_EXPR, "base": _BASE.format(dom="TRUE"), "machine": f"{_SEED}\nUNION ALL{step}"}


def machine_sql(body: str, machine: dict[str, str], *views: str, **more: str) -> str:
    return sql(body, "kpi_hour", *views, recursive=True, **machine, **more)


def _transition_sql(shown: str) -> str:
    return f"SELECT scope_id, {when_sql('ws')} AS window_start, phase, CAST(seq AS BIGINT) AS sequence, {when_sql('first_at')} AS first_observed_at, {shown} AS severity FROM machine WHERE phase IS NOT NULL"


def _transitions(df):
    return df.select("scope_id", when("window_start"), "phase", "sequence", when("first_observed_at"), F.col("episode_severity").alias("severity"))


@query("str_13_service_episode_machine", machine_sql(_transition_sql("sev"), service_machine()))
def service_episodes(t: Tables):
    return _transitions(episodes.service_lifecycle(series(t), ["scope_id"]))


@query("str_14_domain_episode_machine", machine_sql(_transition_sql("shown"), domain_machine(True)))
def domain_episodes(t: Tables):
    return _transitions(episodes.domain_lifecycle(domain_series(t), ["scope_id"]))


@query("str_15_minute_episode_machine", machine_sql(_transition_sql("shown"), domain_machine(False)))
def minute_episodes(t: Tables):
    rows = domain_series(t).withColumn("backlog_required", F.lit(False))
    return _transitions(episodes.domain_lifecycle(rows, ["scope_id"], from_candidate=False))


@query(
    "str_14_replay_and_conflict",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, hour(window_start) % 5 = 0 AS conflict FROM kpi_hour""",
        "kpi_hour",
    ),
)
def replays(t: Tables):
    base = t.kpi_hour.select("scope_id", "window_start", "window_end", "attempts", F.lit(0).alias("arrival"))
    copies = base.withColumn("arrival", F.lit(1))
    changed = base.where("hour(window_start) % 5 = 0").withColumn("attempts", F.col("attempts") + 1).withColumn("arrival", F.lit(2))
    offers = base.unionByName(copies).unionByName(changed).withColumn("fp", F.sha2(F.col("attempts").cast("string"), 256))
    return episodes.one_per_window(offers, ["scope_id"], "arrival", "fp").select("scope_id", when("window_start"), "conflict")


_ARRIVAL = "CAST(epoch(window_start) AS BIGINT) * 10 + CASE WHEN hour(window_start) % 11 = 3 THEN 80000 ELSE 0 END"
_OFFERS_SQL = f"""
SELECT scope_id, window_start, window_end, attempts, verdict, CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, backlog_required, drained, o.revision, o.fp AS fingerprint, {_ARRIVAL} + o.d AS arrival
FROM (SELECT * FROM ({SERIES_EXPR})), (SELECT unnest([0, 1, 2, 3, 40000]) AS d, unnest([1, 1, 1, 2, 1]) AS revision, unnest(['a', 'a', 'b', 'a', 'b']) AS fp) o
WHERE o.d = 0 OR (o.d = 1 AND hour(window_start) % 5 = 0) OR (o.d IN (2, 40000) AND hour(window_start) % 7 = 1) OR (o.d = 3 AND hour(window_start) % 13 = 2)"""
_FIRST_SQL = """
SELECT *, window_start < max(window_end) OVER (PARTITION BY scope_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM (
  SELECT scope_id, window_start, revision, fingerprint, any_value(window_end) AS window_end, any_value(verdict) AS verdict, any_value(severity) AS severity, any_value(backlog_required) AS backlog_required,
    any_value(drained) AS drained, min(arrival) AS arrival, count(*) AS copies FROM offers GROUP BY ALL)"""
_JUDGED_SQL = """
SELECT *, CASE WHEN NOT coalesce(late, FALSE) THEN 'COMMITTED' WHEN max(CASE WHEN NOT coalesce(late, FALSE) THEN fingerprint END) OVER (PARTITION BY scope_id, window_start, revision) IS NOT NULL THEN 'CONFLICT' ELSE 'LATE' END AS outcome FROM firsts"""
OFFERED = {"offers": _OFFERS_SQL, "firsts": _FIRST_SQL, "judged": _JUDGED_SQL}


def offers(t: Tables):
    """Domain windows as delivered: some late by more than a window, some twice, some changed or revised afterwards."""
    arrival = F.unix_seconds("window_start") * 10 + F.expr("CASE WHEN hour(window_start) % 11 = 3 THEN 80000 ELSE 0 END")
    kinds = F.expr("""array(named_struct('d', 0L, 'revision', 1L, 'fingerprint', 'a'), named_struct('d', 1L, 'revision', 1L, 'fingerprint', 'a'), named_struct('d', 2L, 'revision', 1L, 'fingerprint', 'b'),
        named_struct('d', 3L, 'revision', 2L, 'fingerprint', 'a'), named_struct('d', 40000L, 'revision', 1L, 'fingerprint', 'b'))""")
    rows = domain_series(t).withColumn("o", F.explode(kinds)).where(
        "o.d = 0 OR (o.d = 1 AND hour(window_start) % 5 = 0) OR (o.d IN (2, 40000) AND hour(window_start) % 7 = 1) OR (o.d = 3 AND hour(window_start) % 13 = 2)")
    return rows.withColumn("arrival", arrival + F.col("o.d")).select("*", "o.revision", "o.fingerprint").drop("o")


@query(
    "str_14_admitted_windows",
    sql(f"SELECT scope_id, {when_sql('window_start')} AS window_start, CAST(revision AS BIGINT) AS revision, fingerprint, outcome, copies FROM judged", "kpi_hour", **OFFERED),
)
def admitted_windows(t: Tables):
    return episodes.admitted(offers(t), ["scope_id"]).select("scope_id", when("window_start"), "revision", "fingerprint", "outcome", "copies")


def _admitted_machine() -> dict[str, str]:
    machine = domain_machine(True)
    return {**OFFERED, **machine, "hours": "SELECT * FROM judged WHERE outcome = 'COMMITTED'"}


@query(
    "str_14_admitted_episode_machine",
    machine_sql(
        f"""
SELECT scope_id, 'TRANSITION' AS outcome, {when_sql('ws')} AS window_start, phase, CAST(seq AS BIGINT) AS sequence, {when_sql('first_at')} AS first_observed_at, shown AS severity FROM machine WHERE phase IS NOT NULL
UNION ALL SELECT scope_id, outcome, {when_sql('window_start')}, NULL, NULL, NULL, NULL FROM judged WHERE outcome = 'CONFLICT'""",
        _admitted_machine(),
    ),
)
def admitted_machine(t: Tables):
    return episodes.admitted_lifecycle(offers(t), ["scope_id"]).select(
        "scope_id", "outcome", when("window_start"), "phase", "sequence", when("first_observed_at"), "severity")


@query(
    "str_16_late_windows_dropped",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, coalesce(window_start < max(window_end) OVER (PARTITION BY scope_id ORDER BY last_event_id + CASE WHEN attempts % 4 = 0 THEN 500 ELSE 0 END, window_start
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM kpi_hour""",
        "kpi_hour",
    ),
)
def late_windows(t: Tables):
    rows = t.kpi_hour.withColumn("arrival", F.struct(F.expr("last_event_id + CASE WHEN attempts % 4 = 0 THEN 500 ELSE 0 END"), F.col("window_start")))
    return episodes.in_order(rows, ["scope_id"], "arrival").select("scope_id", when("window_start"), "late")


# -- incidents --------------------------------------------------------------------------------------

_SERVICE = "CASE WHEN CAST(substr(scope_id, 2) AS INT) % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END"


def detections(t: Tables):
    """Service transitions as detections, some of them not (yet) delivered."""
    d = episodes.service_lifecycle(series(t), ["scope_id"]).withColumn("service", F.expr(_SERVICE))
    return d.withColumn("episode_key", F.concat_ws(":", "scope_id", F.date_format("first_observed_at", "yyyyMMddHH")))


def delivered(t: Tables):
    return detections(t).where("NOT (scope_id IN ('S2', 'S7') AND sequence = 4)")


DET = {
    **service_machine(),
    "alldet": f"""
SELECT scope_id, {_SERVICE} AS service, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, phase, CAST(seq AS BIGINT) AS sequence, first_at AS first_observed_at, sev AS episode_severity,
  scope_id || ':' || strftime(first_at, '%Y%m%d%H') AS episode, CASE phase WHEN 'RECOVERY' THEN 'RECOVERED' WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'ONGOING' END AS technical_state FROM machine WHERE phase IS NOT NULL""",
    "det": "SELECT * FROM alldet WHERE NOT (scope_id IN ('S2', 'S7') AND sequence = 4)",
    "flagged": "SELECT *, row_number() OVER (PARTITION BY episode ORDER BY sequence) = sequence AS applied FROM det",
    "inc": """
SELECT episode, any_value(scope_id) AS scope_id, any_value(service) AS service, max(sequence) FILTER (WHERE applied) AS latest_sequence, count(*) FILTER (WHERE NOT applied) AS pending, min(first_observed_at) AS first_observed_at,
  arg_min(window_end, sequence) AS detected_at, arg_max(window_end, sequence) FILTER (WHERE applied) AS last_observed_at, arg_max(technical_state, sequence) FILTER (WHERE applied) AS technical_state,
  arg_max(episode_severity, sequence) FILTER (WHERE applied AND phase <> 'UNKNOWN') AS severity FROM flagged GROUP BY episode""",
}


def det_sql(body: str, *views: str, **more: str) -> str:
    return sql(body, "kpi_hour", *views, recursive=True, **DET, **more)


def keyed(df):
    """Readable episode keys instead of hashes, for comparison with the oracle."""
    return df.withColumn("episode_id", F.col("episode_key"))


def folded(t: Tables):
    return incidents.fold(keyed(delivered(t)))


@query(
    "str_17_contiguous_prefix_fold",
    det_sql(f"SELECT episode AS episode_id, scope_id, service, latest_sequence, pending, {when_sql('first_observed_at')} AS first_observed_at, {when_sql('last_observed_at')} AS last_observed_at, technical_state, severity FROM inc"),
)
def fold(t: Tables):
    return folded(t).select("episode_id", "scope_id", "service", "latest_sequence", "pending", when("first_observed_at"), when("last_observed_at"), "technical_state", "severity")


@query(
    "str_18_pending_reconcile",
    det_sql("SELECT a.episode AS episode_id, a.sequence FROM alldet a LEFT JOIN inc i ON i.episode = a.episode WHERE a.sequence = coalesce(i.latest_sequence, 0) + 1"),
)
def reconcile(t: Tables):
    return incidents.pending_ready(keyed(detections(t)), folded(t)).select("episode_id", "sequence")


@query(
    "str_19_successor_violations",
    det_sql(
        """
SELECT episode AS episode_id, sequence, CASE WHEN p_state = 'RECOVERED' THEN 'RECOVERED_CANNOT_REOPEN' WHEN p_ctx <> ctx THEN 'CONTEXT_CHANGED' WHEN ws2 < p_end THEN 'WINDOWS_OVERLAP' WHEN p_sev = 'CRITICAL' AND episode_severity <> 'CRITICAL' THEN 'SEVERITY_DECREASED' END AS violation
FROM (SELECT *, lag(technical_state) OVER w AS p_state, lag(ctx) OVER w AS p_ctx, lag(window_end) OVER w AS p_end, lag(episode_severity) OVER w AS p_sev
  FROM (SELECT *, CASE WHEN scope_id = 'S6' AND sequence = 3 THEN 'v2' ELSE 'v1' END AS ctx, CASE WHEN scope_id = 'S8' AND sequence = 2 THEN window_start - INTERVAL 1 HOUR ELSE window_start END AS ws2 FROM alldet) WINDOW w AS (PARTITION BY episode ORDER BY sequence))
WHERE p_state = 'RECOVERED' OR p_ctx <> ctx OR ws2 < p_end OR (p_sev = 'CRITICAL' AND episode_severity <> 'CRITICAL')"""),
)
def violations(t: Tables):
    d = keyed(detections(t)).withColumns({
        "context": F.expr("CASE WHEN scope_id = 'S6' AND sequence = 3 THEN 'v2' ELSE 'v1' END"),
        "window_start": F.expr("CASE WHEN scope_id = 'S8' AND sequence = 2 THEN timestampadd(HOUR, -1, window_start) ELSE window_start END"),
    })
    return incidents.successor_violations(d, ["context"]).select("episode_id", "sequence", "violation")


_TRAIL = """
SELECT *, lag(technical_state) OVER w AS b_state, lag(sev_after) OVER w AS b_sev, lag(sequence) OVER w AS b_seq FROM (SELECT *, last_value(CASE WHEN phase <> 'UNKNOWN' THEN episode_severity END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY sequence) AS sev_after FROM flagged WHERE applied) WINDOW w AS (PARTITION BY episode ORDER BY sequence)"""


@query("str_20_audit_trail", det_sql("SELECT episode AS episode_id, sequence, phase, b_state AS before_state, b_sev AS before_severity, technical_state AS after_state, sev_after AS after_severity FROM trail", trail=_TRAIL))
def audit(t: Tables):
    return incidents.audit_trail(keyed(delivered(t))).select(
        "episode_id", "sequence", "phase", F.col("before.technical_state").alias("before_state"), F.col("before.severity").alias("before_severity"),
        F.col("after.technical_state").alias("after_state"), F.col("after.severity").alias("after_severity"))


_RANK = "CASE {} WHEN 'MEDIUM' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END"
_KIND = f"""CASE WHEN b_seq IS NULL THEN CASE WHEN phase = 'OPEN' THEN 'OPEN' END WHEN phase = 'UPDATE' AND {_RANK.format('sev_after')} > {_RANK.format('b_sev')} THEN 'ESCALATED' WHEN phase = 'RECOVERY' AND b_state <> 'RECOVERED' THEN 'RECOVERED' END"""


@query("str_21_notification_kinds", det_sql(f"SELECT * FROM (SELECT episode AS episode_id, sequence, {_KIND} AS kind FROM trail) WHERE kind IS NOT NULL", trail=_TRAIL))
def notification_kinds(t: Tables):
    return incidents.notifications(keyed(delivered(t))).select("episode_id", "sequence", "kind")


@query(
    "agg_29_incident_counts",
    det_sql("SELECT scope_id, service, count(*) FILTER (WHERE technical_state = 'ONGOING') AS ongoing, count(*) FILTER (WHERE technical_state <> 'RECOVERED') AS unresolved, count(*) AS incidents FROM inc GROUP BY 1, 2"),
)
def incident_counts(t: Tables):
    return serving.open_counts(folded(t))


# -- JON-13…15 --------------------------------------------------------------------------------------

VERSIONS_SQL = "SELECT * FROM (VALUES ('g1', 't1'), ('g2', 't1'), ('g3', 't2')) v(catalogue_version, topology_version)"
BINDINGS_SQL = """
SELECT v AS catalogue_version, 'S' || s AS scope_id, CASE WHEN s % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END AS service, 'N' || ((s * 3 + CASE v WHEN 'g2' THEN 1 ELSE 0 END) % 25) AS node_id, s = 9 AS legacy
FROM range(10) a(s), (SELECT unnest(['g1', 'g2', 'g3']) AS v) WHERE NOT (v = 'g2' AND s < 4) AND NOT (v = 'g3' AND s = 5)"""
COVERAGE_SQL = """
SELECT scope_id, window_start, t AS topology_version, v AS catalogue_version FROM kpi_hour, (SELECT unnest(['t1', 't1', 't2']) AS t, unnest(['g1', 'g2', 'g3']) AS v) WHERE (v = 'g1' AND attempts % 3 = 1) OR (v = 'g2' AND attempts % 5 = 1) OR (v = 'g3' AND attempts % 2 = 1)"""


def versions(t: Tables):
    return t.spark.createDataFrame([("g1", "t1"), ("g2", "t1"), ("g3", "t2")], "catalogue_version string, topology_version string")


def bindings(t: Tables):
    rows = t.spark.range(30).selectExpr("id % 10 AS s", "concat('g', 1 + id DIV 10) AS catalogue_version")
    return rows.where("NOT (catalogue_version = 'g2' AND s < 4) AND NOT (catalogue_version = 'g3' AND s = 5)").selectExpr(
        "catalogue_version", "concat('S', s) AS scope_id", "CASE WHEN s % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END AS service",
        "concat('N', (s * 3 + CASE catalogue_version WHEN 'g2' THEN 1 ELSE 0 END) % 25) AS node_id", "s = 9 AS legacy")


def window_coverage(t: Tables):
    offers = "explode(array(named_struct('t', 't1', 'v', 'g1', 'k', attempts % 3), named_struct('t', 't1', 'v', 'g2', 'k', attempts % 5), named_struct('t', 't2', 'v', 'g3', 'k', attempts % 2))) AS o"
    return t.kpi_hour.selectExpr("scope_id", "window_start", offers).where("o.k = 1").selectExpr(
        "scope_id", "window_start", "o.t AS topology_version", "o.v AS catalogue_version")


OPENING_SQL = """
SELECT i.*, d.window_start AS opening_start, CASE WHEN hour(d.window_start) % 7 = 0 THEN NULL WHEN hour(d.window_start) % 2 = 0 THEN 't1' ELSE 't2' END AS topology_version FROM inc i LEFT JOIN det d ON d.episode = i.episode AND d.sequence = 1"""
LOCATED_SQL = """
SELECT o.*, coalesce(c.n, 0) AS coverage_matches, (SELECT count(*) FROM ver v JOIN bnd b ON b.catalogue_version = v.catalogue_version AND b.scope_id = o.scope_id AND b.service = o.service WHERE v.topology_version = o.topology_version AND (c.n IS NULL OR (c.n = 1 AND v.catalogue_version = c.v))) AS matches,
  (SELECT min(b.node_id) FROM ver v JOIN bnd b ON b.catalogue_version = v.catalogue_version AND b.scope_id = o.scope_id AND b.service = o.service WHERE v.topology_version = o.topology_version AND (c.n IS NULL OR (c.n = 1 AND v.catalogue_version = c.v))) AS node_any
FROM opening o LEFT JOIN (SELECT scope_id, window_start, topology_version, count(DISTINCT catalogue_version) AS n, min(catalogue_version) AS v FROM cov GROUP BY 1, 2, 3) c
  ON c.scope_id = o.scope_id AND c.window_start = o.opening_start AND c.topology_version = o.topology_version"""
LOC_VIEWS = {"ver": VERSIONS_SQL, "bnd": BINDINGS_SQL, "cov": COVERAGE_SQL, "opening": OPENING_SQL, "located": LOCATED_SQL}


def openings(t: Tables):
    """Incidents with the window and topology version of their first detection."""
    first = keyed(delivered(t)).where("sequence = 1").select(
        "episode_id", F.col("window_start").alias("opening_start"),
        F.expr("CASE WHEN hour(window_start) % 7 = 0 THEN NULL WHEN hour(window_start) % 2 = 0 THEN 't1' ELSE 't2' END").alias("topology_version"))
    return folded(t).join(first, "episode_id", "left")


def located(t: Tables):
    return topology.resolve_location(openings(t), window_coverage(t), versions(t), bindings(t))


@query("jon_13_temporal_version_resolution", det_sql("SELECT episode AS episode_id, topology_version, CAST(least(coverage_matches, 2) AS INT) AS coverage_matches, matches, CASE WHEN matches = 1 THEN node_any END AS node_id FROM located", **LOC_VIEWS))
def version_resolution(t: Tables):
    return located(t).select("episode_id", "topology_version", "coverage_matches", "matches", "node_id")


_CLIMB_SQL = """
SELECT node_id, [node_id] AS path, parent_id AS parent, node_type AS type, 1 AS depth FROM nodes
UNION ALL SELECT c.node_id, list_prepend(n.node_id, c.path), n.parent_id, n.node_type, c.depth + 1 FROM climb c JOIN nodes n ON n.node_id = c.parent WHERE c.depth < 5 AND NOT list_contains(c.path, n.node_id)"""
_ANC_SQL = "SELECT node_id, array_to_string(path, '/') AS path, parent IS NULL AND type = 'COUNTRY' AS complete FROM climb QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY depth DESC) = 1"
ANCESTRY = {"climb": _CLIMB_SQL, "anc": _ANC_SQL}


@query("jon_14_recursive_ancestry", sql("SELECT * FROM anc", "nodes", recursive=True, **ANCESTRY))
def ancestry(t: Tables):
    return topology.ancestry(t.nodes).select("node_id", F.array_join("path", "/").alias("path"), "complete")


@query(
    "jon_15_latest_detection_per_incident",
    det_sql("SELECT i.episode AS episode_id, d.sequence, d.phase, o.phase AS opening_phase FROM inc i JOIN det d ON d.episode = i.episode AND d.sequence = i.latest_sequence JOIN det o ON o.episode = i.episode AND o.sequence = 1"),
)
def latest_detection(t: Tables):
    d = keyed(delivered(t)).select("episode_id", "sequence", "phase")
    latest = folded(t).select("episode_id", F.col("latest_sequence").alias("sequence")).join(d, ["episode_id", "sequence"])
    opening = d.where("sequence = 1").select("episode_id", F.col("phase").alias("opening_phase"))
    return latest.join(opening, "episode_id").select("episode_id", "sequence", "phase", "opening_phase")


# -- QRY --------------------------------------------------------------------------------------------

NOW = "2024-01-30 23:01:00"


def _quality(df):
    return df.withColumn("quality", F.expr("CASE WHEN last_event_id % 13 = 0 THEN 'MISSING' ELSE 'COMPLETE' END"))


@query(
    "qry_01_service_overview",
    det_sql(
        f"""
SELECT s.scope_id, {when_sql("k.window_end")} AS window_end, CASE WHEN k.window_end IS NULL THEN 'NEVER_SEEN' WHEN k.last_event_id % 13 = 0 THEN 'MISSING' WHEN epoch(TIMESTAMP '{NOW}') - epoch(k.window_end) > 90 THEN 'STALE' ELSE 'FRESH' END AS freshness,
  CAST(coalesce(c.ongoing, 0) AS BIGINT) AS ongoing, CAST(coalesce(c.unresolved, 0) AS BIGINT) AS unresolved
FROM (SELECT 'S' || id AS scope_id FROM range(12) r(id)) s LEFT JOIN (SELECT * FROM kpi_hour WHERE window_end <= TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY window_start DESC) = 1) k ON k.scope_id = s.scope_id
LEFT JOIN (SELECT scope_id, count(*) FILTER (WHERE technical_state = 'ONGOING') AS ongoing, count(*) FILTER (WHERE technical_state <> 'RECOVERED') AS unresolved FROM inc GROUP BY 1) c ON c.scope_id = s.scope_id"""),
)
def overview(t: Tables):
    scopes = t.spark.range(12).selectExpr("concat('S', id) AS scope_id")
    return serving.overview(scopes, _quality(t.kpi_hour), folded(t), ts_lit(NOW)).select("scope_id", when("window_end"), "freshness", "ongoing", "unresolved")


@query(
    "qry_02_kpi_history_page",
    sql(
        f"""
SELECT event_id, {when_sql("window_start")} AS window_start, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (ORDER BY window_start, event_id) AS position FROM (SELECT * FROM obs
  WHERE kind = 'SERVICE' AND scope_id = 'S4' AND window_start >= TIMESTAMP '2024-01-10 00:00:00' AND window_start < TIMESTAMP '2024-01-11 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY service, scope_id, window_start ORDER BY received_at DESC, event_id DESC) = 1)) WHERE position <= 50""",
        "obs",
    ),
)
def history(t: Tables):
    from vigilmesh.operators.latest import newest

    rows = optional(t.obs, kind="SERVICE", scope_id="S4", source_id=None).where(
        (F.col("window_start") >= ts_lit("2024-01-10 00:00:00")) & (F.col("window_start") < ts_lit("2024-01-11 00:00:00")))
    canonical = newest(rows.select("service", "scope_id", "window_start", "received_at", "event_id"), ["service", "scope_id", "window_start"], ["received_at", "event_id"])
    return page(canonical, [F.col("window_start"), F.col("event_id")], 50).select("event_id", when("window_start"), "position")


CITY_SQL = """SELECT b.node_id AS city_id, b.scope_id, b.service FROM bnd b WHERE b.catalogue_version = 'g1' AND NOT b.legacy"""


@query(
    "qry_03_city_summaries",
    det_sql(
        f"""
SELECT c.city_id, c.scope_id, {when_sql("k.window_end")} AS window_end, {num_sql("100.0::DOUBLE * k.success / k.attempts")} AS observed, coalesce(n.incidents, 0) AS incidents
FROM city c LEFT JOIN (SELECT * FROM kpi_hour QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY window_start DESC) = 1) k ON k.scope_id = c.scope_id LEFT JOIN (SELECT scope_id, count(*) AS incidents FROM inc GROUP BY 1) n ON n.scope_id = c.scope_id""",
        bnd=BINDINGS_SQL, city=CITY_SQL),
)
def city_summaries(t: Tables):
    from vigilmesh.operators.latest import newest

    cities = bindings(t).where("catalogue_version = 'g1' AND NOT legacy").select(F.col("node_id").alias("city_id"), "scope_id", "service")
    latest = newest(t.kpi_hour, ["scope_id"], ["window_start"]).select("scope_id", "window_end", (F.col("success") * 100.0 / F.col("attempts")).alias("observed"))
    counts = serving.open_counts(folded(t)).groupBy("scope_id").agg(F.sum("incidents").alias("incidents"))
    return cities.join(latest, "scope_id", "left").join(counts, "scope_id", "left").select(
        "city_id", "scope_id", when("window_end"), num("observed"), F.coalesce("incidents", F.lit(0)).alias("incidents"))


PRIORITY_NOW = "2024-01-20 12:00:30"
_PRI_SQL = f"""
SELECT *, CASE WHEN band = 0 THEN impact END AS comparable FROM (SELECT *, CASE WHEN technical_state = 'RECOVERED' THEN 2 WHEN technical_state = 'ONGOING' AND epoch(TIMESTAMP '{PRIORITY_NOW}') - epoch(last_observed_at) BETWEEN 0 AND 90 THEN 0 ELSE 1 END AS band,
  CASE WHEN latest_sequence % 3 = 0 THEN NULL ELSE latest_sequence * 10 + pending END AS impact FROM located)"""


@query(
    "qry_04_priority_incidents",
    det_sql(
        f"""
SELECT episode AS episode_id, band, severity, comparable AS comparable_impact, CASE WHEN matches = 1 THEN node_any END AS node_id,
  CAST(row_number() OVER (ORDER BY band, CASE WHEN band = 0 THEN CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END ELSE 3 END, CASE WHEN band = 0 THEN CASE service WHEN 'SMS' THEN 0 ELSE 1 END ELSE 2 END, comparable DESC NULLS LAST, first_observed_at, episode) AS INT) AS position
FROM pri ORDER BY position LIMIT 100""",
        **LOC_VIEWS, pri=_PRI_SQL),
)
def priorities(t: Tables):
    rows = located(t).withColumn("impact", F.expr("CASE WHEN latest_sequence % 3 = 0 THEN NULL ELSE latest_sequence * 10 + pending END"))
    ranked = serving.priority_columns(rows, ts_lit(PRIORITY_NOW))
    return page(ranked, serving.priority_order(), 100).select("episode_id", "band", "severity", "comparable_impact", "node_id", "position")


@query(
    "qry_05_incident_location",
    det_sql(
        """
SELECT l.episode AS episode_id, CASE WHEN r IS NULL THEN a.path END AS path, r AS null_reason FROM (SELECT *, CASE WHEN matches = 1 AND scope_id = 'S9' THEN 'UNALLOCATED' WHEN topology_version IS NULL THEN 'CAPTURED_VERSION_MISSING' WHEN coverage_matches > 1 THEN 'AMBIGUOUS_CATALOGUE_VERSION'
  WHEN matches = 0 THEN 'BINDING_NOT_FOUND' WHEN matches > 1 THEN 'AMBIGUOUS_CATALOGUE_VERSION' END AS r FROM located) l LEFT JOIN anc a ON a.node_id = CASE WHEN l.matches = 1 THEN l.node_any END""",
        "nodes", **LOC_VIEWS, **ANCESTRY),
)
def location(t: Tables):
    j = located(t).join(topology.ancestry(t.nodes), "node_id", "left")
    reason = topology.location_reason(F.col("complete"))
    return j.select("episode_id", F.when(reason.isNull(), F.array_join("path", "/")).alias("path"), reason.alias("null_reason"))


@query(
    "qry_06_topology_children",
    sql("SELECT p.node_id, p.node_type, count(c.node_id) AS children, min(c.node_id) AS first_child FROM nodes p LEFT JOIN nodes c ON c.parent_id = p.node_id GROUP BY 1, 2", "nodes"),
)
def children(t: Tables):
    child = t.nodes.select(F.col("node_id").alias("child_id"), F.col("parent_id").alias("p_id"))
    return t.nodes.join(child, F.col("node_id") == F.col("p_id"), "left").groupBy("node_id", "node_type").agg(
        F.count("child_id").alias("children"), F.min("child_id").alias("first_child"))


@query(
    "qry_07_incident_impact_state",
    det_sql(
        f"""
SELECT i.episode AS episode_id, d.phase, CASE d.phase WHEN 'UNKNOWN' THEN 'STALE' WHEN 'RECOVERY' THEN 'RECOVERED' ELSE 'CURRENT' END AS impact_state, o.sequence AS origin_sequence, {when_sql("o.window_end")} AS origin_end
FROM inc i JOIN det d ON d.episode = i.episode AND d.sequence = i.latest_sequence LEFT JOIN det o ON o.episode = i.episode AND o.sequence = (SELECT max(x.sequence) FROM det x WHERE x.episode = i.episode AND x.sequence <= i.latest_sequence AND x.phase <> 'UNKNOWN')"""),
)
def impact_state(t: Tables):
    d = serving.impact_origin(keyed(delivered(t)))
    latest = folded(t).select("episode_id", F.col("latest_sequence").alias("sequence"))
    return latest.join(d, ["episode_id", "sequence"]).select(
        "episode_id", "phase", incidents.impact_state(F.col("phase")).alias("impact_state"), F.col("origin.sequence").alias("origin_sequence"), when(F.col("origin.window_end"), "origin_end"))


@query(
    "qry_08_domain_incident_filters",
    det_sql(
        f"""
SELECT episode AS episode_id, {when_sql("first_observed_at")} AS first_observed_at, technical_state FROM inc WHERE service = 'SMS' AND list_contains(['C' || CAST(substr(scope_id, 2) AS INT) % 5, 'C9'], 'C3')
  AND last_observed_at > TIMESTAMP '2024-01-05 00:00:00' AND first_observed_at < TIMESTAMP '2024-01-25 00:00:00'"""),
)
def domain_filters(t: Tables):
    rows = folded(t).withColumn("city_ids", F.expr("array(concat('C', CAST(substr(scope_id, 2) AS INT) % 5), 'C9')"))
    return optional(
        rows, service="SMS", technical_state=None, city_ids=lambda c: F.array_contains(c, "C3"),
        last_observed_at=lambda c: c > ts_lit("2024-01-05 00:00:00"), first_observed_at=lambda c: c < ts_lit("2024-01-25 00:00:00"),
    ).select("episode_id", when("first_observed_at"), "technical_state")


@query(
    "qry_09_evidence_timeline",
    det_sql(f"SELECT episode AS episode_id, sequence, phase, {when_sql('window_start')} AS window_start, applied, b_seq AS previous_sequence FROM (SELECT f.*, t.b_seq FROM flagged f LEFT JOIN trail t ON t.episode = f.episode AND t.sequence = f.sequence)", trail=_TRAIL),
)
def timeline(t: Tables):
    d = incidents.with_prefix(keyed(delivered(t)))
    trail = incidents.audit_trail(keyed(delivered(t))).select("episode_id", "sequence", F.col("before.sequence").alias("previous_sequence"))
    return d.join(trail, ["episode_id", "sequence"], "left").select("episode_id", "sequence", "phase", when("window_start"), "applied", "previous_sequence")


_Q10 = Request("2026-09-12 03:07:00", "2026-10-02 21:11:00", "6h")


@query("qry_10_metric_series_with_guards", series_oracle(["volte.setup.success", "sms.queue", "volte.setup.p95"], _Q10))
def guarded_series(t: Tables):
    return publish(reference_series(t.city_facts, t.cities, ["volte.setup.success", "sms.queue", "volte.setup.p95"], _Q10))


_REQUESTS_SQL = f"""
SELECT c.scope_id || '/' || k.fault AS request_id, CASE k.fault WHEN 'dataset' THEN 'other' ELSE 'archive' END AS dataset_id, CASE WHEN k.fault = 'domain' THEN 'SMS' WHEN starts_with(k.metric, 'roaming') THEN 'ROAMING' ELSE 'VOLTE' END AS domain, k.metric AS metric_id,
  CASE WHEN k.fault = 'scope' THEN c.scope_id || '?' WHEN starts_with(k.metric, 'roaming') THEN 'N1-DEMO-01:in' ELSE c.scope_id END AS scope_id, CASE k.fault WHEN 'buckets' THEN '1s' WHEN 'hours' THEN '1h' ELSE '5m' END AS resolution,
  TIMESTAMP '{ARCHIVE_START}' - CASE k.fault WHEN 'early' THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END AS requested_from, TIMESTAMP '{ARCHIVE_END}' AS requested_to
FROM cities c, (SELECT unnest(['none', 'hours', 'dataset', 'domain', 'metric', 'scope', 'buckets', 'early', 'direction', 'mixed', 'contract', 'resolution']) AS fault,
  unnest(['volte.attempts', 'volte.established', 'volte.attempts', 'volte.attempts', 'volte.none', 'volte.attempts', 'volte.attempts', 'volte.attempts', 'roaming.activeOutbound', 'volte.drop.rate', 'volte.handover.success', 'volte.abnormalReleases']) AS metric) k"""
_SHAPES_SQL = """
SELECT city_id AS scope_id, ts, m.metric AS metric_id, CASE WHEN m.metric = 'volte.drop.rate' AND slot % 50 = 0 THEN 'RATIO' ELSE m.unit END AS unit, m.aggregation,
  CASE m.metric WHEN 'volte.handover.success' THEN 'kpi-v0' ELSE 'kpi-v1' END AS policy_version, 't1' AS topology_version, CASE m.metric WHEN 'volte.abnormalReleases' THEN 60 ELSE 300 END AS seconds
FROM city5m, (SELECT unnest(['volte.attempts', 'volte.established', 'volte.drop.rate', 'volte.handover.success', 'volte.abnormalReleases']) AS metric, unnest(['COUNT', 'COUNT', 'PERCENT', 'PERCENT', 'COUNT']) AS unit,
  unnest(['COUNT_SUM', 'COUNT_SUM', 'RATIO_OF_SUMS', 'RATIO_OF_SUMS', 'COUNT_SUM']) AS aggregation) m"""


def series_requests(t: Tables):
    """Twelve requests per city, one for each guard and two that pass."""
    kinds = [("none", "volte.attempts"), ("hours", "volte.established"), ("dataset", "volte.attempts"), ("domain", "volte.attempts"), ("metric", "volte.none"),
             ("scope", "volte.attempts"), ("buckets", "volte.attempts"), ("early", "volte.attempts"), ("direction", "roaming.activeOutbound"),
             ("mixed", "volte.drop.rate"), ("contract", "volte.handover.success"), ("resolution", "volte.abnormalReleases")]
    offered = F.array(*[F.struct(F.lit(f).alias("fault"), F.lit(m).alias("metric")) for f, m in kinds])
    return t.cities.withColumn("k", F.explode(offered)).selectExpr(
        "concat(scope_id, '/', k.fault) AS request_id", "IF(k.fault = 'dataset', 'other', 'archive') AS dataset_id",
        "CASE WHEN k.fault = 'domain' THEN 'SMS' WHEN startswith(k.metric, 'roaming') THEN 'ROAMING' ELSE 'VOLTE' END AS domain", "k.metric AS metric_id",
        "CASE WHEN k.fault = 'scope' THEN concat(scope_id, '?') WHEN startswith(k.metric, 'roaming') THEN 'N1-DEMO-01:in' ELSE scope_id END AS scope_id",
        "CASE k.fault WHEN 'buckets' THEN '1s' WHEN 'hours' THEN '1h' ELSE '5m' END AS resolution",
        f"timestampadd(MINUTE, IF(k.fault = 'early', -5, 0), timestamp'{ARCHIVE_START}') AS requested_from", f"timestamp'{ARCHIVE_END}' AS requested_to")


def metric_shapes(t: Tables):
    """Stored metric windows with their contract; some metrics break it, one only at times."""
    metrics = [("volte.attempts", "COUNT", "COUNT_SUM"), ("volte.established", "COUNT", "COUNT_SUM"), ("volte.drop.rate", "PERCENT", "RATIO_OF_SUMS"),
               ("volte.handover.success", "PERCENT", "RATIO_OF_SUMS"), ("volte.abnormalReleases", "COUNT", "COUNT_SUM")]
    kinds = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.lit(a).alias("aggregation")) for m, u, a in metrics])
    return t.city5m.withColumn("m", F.explode(kinds)).selectExpr(
        "'archive' AS dataset_id", "city_id AS scope_id", "ts AS bucket_start", "m.metric AS metric_id",
        "IF(m.metric = 'volte.drop.rate' AND slot % 50 = 0, 'RATIO', m.unit) AS unit", "m.aggregation",
        "IF(m.metric = 'volte.handover.success', 'kpi-v0', 'kpi-v1') AS policy_version", "'t1' AS topology_version",
        "IF(m.metric = 'volte.abnormalReleases', 60, 300) AS source_resolution_seconds")


@query(
    "qry_10_series_guards",
    sql(
        """
SELECT r.request_id, CASE WHEN resolution = '1s' THEN 'TOO_MANY_BUCKETS' WHEN d.metric IS NULL THEN 'UNKNOWN_METRIC' WHEN dataset_id <> 'archive' THEN 'UNKNOWN_DATASET' WHEN r.request_id LIKE '%/early' THEN 'OUTSIDE_HISTORY'
    WHEN NOT starts_with(r.metric_id, 'roaming') AND r.scope_id NOT IN (SELECT scope_id FROM cities) THEN 'UNKNOWN_SCOPE' WHEN r.metric_id = 'roaming.activeOutbound' THEN 'SNAPSHOT_DIRECTION'
    WHEN s.shapes > 1 THEN 'MIXED_SHAPES' WHEN s.policy <> 'kpi-v1' OR s.seconds <> 300 THEN 'CONTRACT_MISMATCH' END AS reason, coalesce(s.windows, 0) AS windows
FROM requests r LEFT JOIN (SELECT unnest(['volte.attempts', 'volte.established', 'volte.drop.rate', 'volte.handover.success', 'volte.abnormalReleases', 'roaming.activeOutbound']) AS metric, unnest(['VOLTE', 'VOLTE', 'VOLTE', 'VOLTE', 'VOLTE', 'ROAMING']) AS dom) d
  ON d.metric = r.metric_id AND d.dom = r.domain
LEFT JOIN (SELECT scope_id, metric_id, count(DISTINCT (unit, aggregation, policy_version, topology_version, seconds)) AS shapes, min(policy_version) AS policy, min(seconds) AS seconds, count(*) AS windows FROM shapes GROUP BY 1, 2) s
  ON s.scope_id = r.scope_id AND s.metric_id = r.metric_id AND r.dataset_id = 'archive'""",
        "city5m", "cities", requests=_REQUESTS_SQL, shapes=_SHAPES_SQL,
    ),
)
def series_guards(t: Tables):
    datasets = t.spark.createDataFrame(
        [("archive", 300, ARCHIVE_START, ARCHIVE_END)], "dataset_id string, source_resolution_seconds int, available_from string, available_to string"
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("available_from", "available_to")})
    scopes = t.cities.unionByName(t.partners.select("scope_id")).withColumn("topology_version", F.lit("t1"))
    judged = guards.judge(series_requests(t), metric_shapes(t), datasets, scopes, dictionary_df(t.spark))
    return judged.select("request_id", "reason", "windows")


@query(
    "qry_11_snapshots_at_instant",
    sql(
        f"""
SELECT p.scope_id, {when_sql("s.ts")} AS snapshot_at, s.active_users, CAST(epoch({slot_ts("6000")}) - epoch(s.ts) AS BIGINT) AS age_seconds, CASE WHEN s.ts IS NULL THEN 'MISSING' WHEN epoch({slot_ts("6000")}) - epoch(s.ts) > 600 THEN 'STALE' ELSE 'VALID' END AS quality
FROM partners p LEFT JOIN (SELECT * FROM roam_facts WHERE ts <= {slot_ts("6000")} QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY ts DESC) = 1) s ON s.scope_id = p.scope_id""",
        "roam_facts", "partners",
    ),
)
def snapshots(t: Tables):
    from vigilmesh.functions.timebins import seconds_between
    from vigilmesh.operators.asof import latest_at

    at = F.expr(at_slot("6000"))
    found = latest_at(t.roam_facts, ["scope_id"], "ts", at, ["active_users"])
    j = t.partners.select("scope_id").join(found, "scope_id", "left")
    age = seconds_between(F.col("found.ts"), at)
    return j.select("scope_id", when(F.col("found.ts"), "snapshot_at"), "found.active_users", age.alias("age_seconds"),
                    F.when(age.isNull(), "MISSING").when(age > 600, "STALE").otherwise("VALID").alias("quality"))


@query(
    "qry_12_inventory_as_of",
    sql(f"SELECT link_id, nominal_gbps, a, b FROM link_inventory WHERE valid_from <= {slot_ts('4350')} AND valid_to > {slot_ts('4350')} AND (a = 'C3' OR b = 'C3' OR a = 'C9' OR b = 'C9')", "link_inventory"),
)
def inventory(t: Tables):
    at = F.expr(at_slot("4350"))
    one = topology.inventory_at(t.link_inventory, at, F.lit("C3"))
    two = topology.inventory_at(t.link_inventory, at, F.lit("C9"))
    return one.unionByName(two).distinct().select("link_id", "nominal_gbps", "a", "b")


@query(
    "qry_13_notification_history",
    det_sql(
        f"""
SELECT n.analyst, count(*) AS total, count(*) FILTER (WHERE n.sequence % 2 = 1) AS unread, count(i.episode) AS with_incident FROM (SELECT 'A' || CAST(substr(episode, 2, 1) AS INT) % 3 AS analyst, * FROM (SELECT episode, sequence, {_KIND} AS kind FROM trail) WHERE kind IS NOT NULL) n
LEFT JOIN inc i ON i.episode = n.episode GROUP BY 1""",
        trail=_TRAIL),
)
def notification_history(t: Tables):
    events = incidents.notifications(keyed(delivered(t))).select("episode_id", "sequence", "kind", F.expr("concat('A', CAST(substr(scope_id, 2, 1) AS INT) % 3)").alias("analyst"))
    known = folded(t).select("episode_id", F.lit(1).alias("incident"))
    return events.join(known, "episode_id", "left").groupBy("analyst").agg(
        F.count("*").alias("total"), F.count_if(F.col("sequence") % 2 == 1).alias("unread"), F.count("incident").alias("with_incident"))
