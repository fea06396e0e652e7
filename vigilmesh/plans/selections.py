"""Projection, window-function, ordering and set queries: PRJ, WIN, SRT, SET."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmesh.adapters import ARCHIVE_END, ARCHIVE_START, Tables, slot_ts as at_slot
from vigilmesh.operators import filters
from vigilmesh.operators.episodes import streaks
from vigilmesh.operators.latest import empirical_rank, newest, unambiguous
from vigilmesh.operators.paging import page
from vigilmesh.operators.rollup import latest_revision, ts_lit
from vigilmesh.oracle_views import slot_ts, sql
from vigilmesh.plans.common import num, num_sql, when, when_sql
from vigilmesh.registry import query


@query(
    "prj_01_half_open_range_filter",
    sql(
        f"""
SELECT city_id, slot, voice_attempts FROM city5m WHERE ts >= {slot_ts("1000")} AND ts < {slot_ts("5000")}
  AND city_id IN ('C1', 'C2', 'C3')""",
        "city5m",
    ),
)
def half_open(t: Tables):
    lo, hi = F.expr(at_slot("1000")), F.expr(at_slot("5000"))
    return t.city5m.where(filters.half_open(F.col("ts"), lo, hi) & F.col("city_id").isin("C1", "C2", "C3")).select(
        "city_id", "slot", "voice_attempts")


@query(
    "prj_02_optional_filters",
    sql("SELECT partner_id, direction, slot, reg_attempts FROM roam5m WHERE direction = 'in' AND reg_attempts >= 500", "roam5m"),
)
def optional(t: Tables):
    return filters.optional(
        t.roam5m, direction="in", country_id=None, partner_id=None, reg_attempts=lambda c: c >= 500
    ).select("partner_id", "direction", "slot", "reg_attempts")


@query(
    "prj_03_array_containment_and_overlap",
    sql(
        f"""
SELECT episode, {when_sql("lo")} AS lo FROM (SELECT scope_id || ':' || strftime(window_start, '%Y%m%d%H') AS episode,
  window_start AS lo, window_start + to_seconds(attempts * 1800) AS hi, ['C' || (attempts % 10), 'C' || (success % 10)] AS cities FROM kpi_hour)
WHERE list_contains(cities, 'C2') AND lo < TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-05 00:00:00' < hi""",
        "kpi_hour",
    ),
)
def containment(t: Tables):
    rows = t.kpi_hour.select(
        F.concat_ws(":", "scope_id", F.date_format("window_start", "yyyyMMddHH")).alias("episode"),
        F.col("window_start").alias("lo"),
        F.expr("timestampadd(SECOND, attempts * 1800, window_start)").alias("hi"),
        F.expr("array(concat('C', attempts % 10), concat('C', success % 10))").alias("cities"),
    )
    a, b = ts_lit("2024-01-05 00:00:00"), ts_lit("2024-01-20 00:00:00")
    return rows.where(
        F.array_contains("cities", "C2") & filters.overlaps(F.col("lo"), F.col("hi"), a, b)
    ).select("episode", when("lo"))


@query(
    "prj_04_bucket_bounds",
    f"""
SELECT event_id, {when_sql("lo")} AS effective_from, {when_sql("hi")} AS effective_to, lo < ts AS partial_start, hi > te AS partial_end,
  CAST((epoch(hi) - epoch(lo)) / 900 AS BIGINT) AS points
FROM (SELECT event_id, ts, te, TIMESTAMP '1970-01-01' + to_seconds((epoch_us(ts) // 900000000) * 900) AS lo,
  TIMESTAMP '1970-01-01' + to_seconds(((epoch_us(te) + 899999999) // 900000000) * 900) AS hi
  FROM (SELECT event_id, ts, ts + to_seconds(600 + event_id % 7200) AS te FROM events))""",
)
def bounds(t: Tables):
    end = F.expr("timestampadd(SECOND, 600 + event_id % 7200, ts)")
    b = filters.bucket_bounds(F.col("ts"), F.col("te"), 900)
    return t.events.withColumn("te", end).select(
        "event_id", when(b["effective_from"], "effective_from"), when(b["effective_to"], "effective_to"),
        *[b[n].alias(n) for n in ("partial_start", "partial_end", "points")])


@query(
    "prj_05_kpi_array_pivot",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, {num_sql("100.0::DOUBLE * success / attempts")} AS "cssrPct",
  CAST(attempts AS DOUBLE) AS "eligibleAttempts", CAST(NULL AS DOUBLE) AS "imsCpuPct" FROM kpi_hour""",
        "kpi_hour",
    ),
)
def kpi_pivot(t: Tables):
    rows = t.kpi_hour.select(
        "scope_id", "window_start",
        F.array(
            F.struct(F.lit("cssrPct").alias("name"), (F.col("success") * 100.0 / F.col("attempts")).alias("observed")),
            F.struct(F.lit("eligibleAttempts").alias("name"), F.col("attempts").cast("double").alias("observed")),
        ).alias("kpis"),
    )
    wide = filters.kpi_columns(rows, ["cssrPct", "eligibleAttempts", "imsCpuPct"])
    return wide.select("scope_id", when("window_start"), num("cssrPct"), "eligibleAttempts", "imsCpuPct")


@query(
    "prj_06_nested_view_projection",
    sql(
        """
SELECT slot, split_part(partner_id, '-', 1) AS country_id, direction AS direction_id, replace(lower('MOBILE_DATA'), '_', '-') AS domain,
  reg_attempts FROM roam5m""",
        "roam5m",
    ),
)
def nested_view(t: Tables):
    nested = t.roam5m.select(
        "slot",
        F.struct(
            F.lit("MOBILE_DATA").alias("domain"),
            F.struct(F.col("partner_id").alias("partnerId"), F.col("direction").alias("directionId")).alias("scope"),
        ).alias("context"),
        "reg_attempts",
    )
    return nested.select(
        "slot", F.split_part(F.col("context.scope.partnerId"), F.lit("-"), F.lit(1)).alias("country_id"),
        F.col("context.scope.directionId").alias("direction_id"),
        F.replace(F.lower(F.col("context.domain")), F.lit("_"), F.lit("-")).alias("domain"), "reg_attempts")


# -- WIN --------------------------------------------------------------------------------------------


@query(
    "win_01_canonical_row_per_window",
    sql(
        f"""
SELECT service, scope_id, {when_sql("window_start")} AS window_start, event_id, quality FROM obs WHERE kind = 'SERVICE'
QUALIFY row_number() OVER (PARTITION BY service, scope_id, window_start ORDER BY received_at DESC, event_id DESC) = 1""",
        "obs",
    ),
)
def canonical(t: Tables):
    rows = t.obs.where("kind = 'SERVICE'").select("service", "scope_id", "window_start", "received_at", "event_id", "quality")
    return newest(rows, ["service", "scope_id", "window_start"], ["received_at", "event_id"]).select(
        "service", "scope_id", when("window_start"), "event_id", "quality")


@query(
    "win_02_latest_revision_per_slot",
    sql(
        """
SELECT scope_id, slot, revision, numerator, denominator, quality FROM revisions
QUALIFY row_number() OVER (PARTITION BY scope_id, slot ORDER BY revision DESC) = 1""",
        "revisions",
    ),
)
def revisions(t: Tables):
    return latest_revision(t.revisions, ("scope_id", "slot")).select(
        "scope_id", "slot", "revision", "numerator", "denominator", "quality")


@query(
    "win_03_ambiguity_count",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, matches, CASE WHEN matches = 1 THEN e END AS event_id
FROM (SELECT scope_id, window_start, count(*) AS matches, max(event_id) AS e FROM obs GROUP BY 1, 2)""",
        "obs",
    ),
)
def ambiguity(t: Tables):
    rows = t.obs.select("scope_id", "window_start", "event_id")
    return unambiguous(rows, ["scope_id", "window_start"]).select("scope_id", when("window_start"), "matches", "event_id")


@query(
    "win_04_oldest_pending_per_scope",
    sql(
        f"""
SELECT scope_id, {when_sql("min(window_start)")} AS oldest_pending, count(*) AS pending FROM (SELECT DISTINCT scope_id, window_start
  FROM obs b WHERE NOT EXISTS (SELECT 1 FROM obs r WHERE r.scope_id = b.scope_id AND r.window_start = b.window_start AND r.kind = 'SERVICE'))
GROUP BY 1""",
        "obs",
    ),
)
def oldest_pending(t: Tables):
    windows = t.obs.groupBy("scope_id", "window_start").agg(F.bool_or(F.col("kind") == "SERVICE").alias("served"))
    return windows.where(~F.col("served")).groupBy("scope_id").agg(
        F.min("window_start").alias("w"), F.count("*").alias("pending")
    ).select("scope_id", when("w", "oldest_pending"), "pending")


@query(
    "win_05_previous_next_adjacency",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, lag(window_end) OVER w = window_start AS adjacent,
  CAST(epoch(lead(window_start) OVER w) - epoch(window_end) AS BIGINT) AS gap_after
FROM kpi_hour WINDOW w AS (PARTITION BY scope_id ORDER BY window_start)""",
        "kpi_hour",
    ),
)
def adjacency(t: Tables):
    # kpi_hour has at most one row per scope and hour, so a partition is as long as the calendar.
    order = Window.partitionBy("scope_id").orderBy("window_start")
    return t.kpi_hour.select(
        "scope_id", when("window_start"),
        (F.lag("window_end").over(order) == F.col("window_start")).alias("adjacent"),
        (F.unix_seconds(F.lead("window_start").over(order)) - F.unix_seconds("window_end")).alias("gap_after"))


HOUR_VERDICT = (
    "CASE WHEN attempts < 1 THEN 'UNKNOWN' WHEN success * 2 <= attempts THEN 'BREACH' "
    "WHEN success = attempts THEN 'HEALTHY' ELSE 'GRAY' END"
)


@query(
    "win_06_consecutive_streaks",
    sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, verdict,
  CASE WHEN verdict = 'BREACH' THEN row_number() OVER (PARTITION BY scope_id, run ORDER BY window_start) ELSE 0 END AS bad,
  CASE WHEN verdict = 'HEALTHY' THEN row_number() OVER (PARTITION BY scope_id, run ORDER BY window_start) ELSE 0 END AS healthy
FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY scope_id ORDER BY window_start) AS run
  FROM (SELECT *, coalesce(lag(window_end) OVER w = window_start AND lag(verdict) OVER w = verdict, FALSE) AS same
    FROM (SELECT *, {HOUR_VERDICT} AS verdict FROM kpi_hour) WINDOW w AS (PARTITION BY scope_id ORDER BY window_start)))""",
        "kpi_hour",
    ),
)
def streak_counts(t: Tables):
    rows = t.kpi_hour.withColumn("verdict", F.expr(HOUR_VERDICT))
    return streaks(rows, ["scope_id"]).select("scope_id", when("window_start"), "verdict", "bad", "healthy")


@query(
    "win_07_calibration_rank",
    sql(
        f"""
SELECT vec_id, {num_sql("(SELECT count(*) FROM vectors c WHERE c.split = 'calibration' AND c.f0 <= v.f0)::DOUBLE / (SELECT count(*) FROM vectors c WHERE c.split = 'calibration')")} AS rank
FROM vectors v WHERE split IN ('validation', 'test')""",
        "vectors",
    ),
)
def calibration_rank(t: Tables):
    probes = t.vectors.where("split IN ('validation', 'test')").select("vec_id", "f0")
    known = t.vectors.where("split = 'calibration'").select("f0")
    return empirical_rank(probes, known, "f0").select("vec_id", num("rank"))


# -- SRT --------------------------------------------------------------------------------------------

_PRIORITY_SQL = """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS band,
  CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS severity,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS impact, o_orderdate AS first_at FROM orders"""


def _priorities(t: Tables):
    return t.raw("orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS band",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS severity",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS impact",
        "o_orderdate AS first_at")


@query(
    "srt_01_priority_order",
    f"""
SELECT id, band, severity, impact, CAST(row_number() OVER (ORDER BY band, severity, impact DESC NULLS LAST, first_at, id) AS INT) AS position
FROM ({_PRIORITY_SQL}) ORDER BY position LIMIT 100""",
)
def priority_order(t: Tables):
    order = [F.col("band"), F.col("severity"), F.col("impact").desc_nulls_last(), F.col("first_at"), F.col("id")]
    return page(_priorities(t), order, 100).select("id", "band", "severity", "impact", "position")


@query(
    "srt_02_page_with_total",
    f"""
SELECT id, CAST(position AS INT) AS position, total > 240 AS has_next, total FROM (SELECT *, row_number() OVER (ORDER BY first_at DESC, id DESC) AS position,
  count(*) OVER () AS total FROM ({_PRIORITY_SQL}) WHERE impact IS NOT NULL) WHERE position > 200 AND position <= 240""",
)
def paged(t: Tables):
    from vigilmesh.operators.paging import total

    rows = _priorities(t).where("impact IS NOT NULL")
    chosen = page(rows, [F.col("first_at").desc(), F.col("id").desc()], 40, 200)
    return chosen.select("id", "position", "has_next", total(rows).scalar().alias("total"))


@query(
    "srt_03_latest_row_per_key",
    sql(
        """
SELECT scope_id, event_id, amount FROM obs QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY window_start DESC, received_at DESC, event_id DESC) = 1""",
        "obs",
    ),
)
def latest(t: Tables):
    return newest(t.obs.select("scope_id", "window_start", "received_at", "event_id", "amount"), ["scope_id"],
                  ["window_start", "received_at", "event_id"]).select("scope_id", "event_id", "amount")


# -- SET --------------------------------------------------------------------------------------------


@query(
    "set_01_union_of_domain_projections",
    sql(
        """
SELECT domain, scope_id, slot, n, d FROM (SELECT 'VOLTE' AS domain, city_id AS scope_id, slot, voice_success AS n, voice_attempts AS d FROM city5m
UNION ALL SELECT 'TRANSPORT', link_id, slot, traffic_micro, capacity * 1000000 FROM link5m
UNION ALL SELECT 'ROAMING', partner_id || ':' || direction, slot, reg_success, reg_attempts FROM roam5m)""",
        "city5m", "link5m", "roam5m",
    ),
)
def union_domains(t: Tables):
    voice = t.city5m.selectExpr("'VOLTE' AS domain", "city_id AS scope_id", "slot", "voice_success AS n", "voice_attempts AS d")
    transport = t.link5m.selectExpr("'TRANSPORT' AS domain", "link_id AS scope_id", "slot", "traffic_micro AS n", "capacity * 1000000 AS d")
    roaming = t.roam5m.selectExpr("'ROAMING' AS domain", "concat_ws(':', partner_id, direction) AS scope_id", "slot", "reg_success AS n", "reg_attempts AS d")
    return voice.unionByName(transport).unionByName(roaming)


# Every row takes part: a third of the documents has its key shifted out of the labels' range.
_KEY = "CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id"
_A = f"SELECT {_KEY} FROM documents"
_B = "SELECT doc_id FROM labels"


def _docs(t: Tables):
    return t.raw("documents").selectExpr(_KEY), t.raw("labels").select("doc_id")


@query(
    "set_02_label_key_sets",
    f"""
SELECT 'BOTH' AS part, doc_id FROM ({_A} INTERSECT {_B}) UNION ALL SELECT 'UNLABELLED', doc_id FROM ({_A} EXCEPT {_B})
UNION ALL SELECT 'WITHOUT_FEATURE', doc_id FROM ({_B} EXCEPT {_A})""",
)
def key_sets(t: Tables):
    a, b = _docs(t)
    parts = [("BOTH", a.intersect(b)), ("UNLABELLED", a.subtract(b)), ("WITHOUT_FEATURE", b.subtract(a))]
    out = [p.select(F.lit(n).alias("part"), "doc_id") for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "set_03_observed_subset_of_expected",
    sql(
        """
SELECT count(*) AS unexpected FROM (SELECT scope_id, source_id, node_id FROM obs WHERE kind = 'NODE'
EXCEPT SELECT scope_id, source_id, node_id FROM catalogue WHERE role = 'NODE')""",
        "obs", "catalogue",
    ),
)
def subset(t: Tables):
    seen = t.obs.where("kind = 'NODE'").select("scope_id", "source_id", "node_id").distinct()
    known = t.catalogue.where("role = 'NODE'").select("scope_id", "source_id", "node_id")
    return seen.exceptAll(known).agg(F.count("*").alias("unexpected"))


@query("set_04_distinct_dimension_values", sql("SELECT DISTINCT scope_id, source_id, kind, quality FROM obs", "obs"))
def distinct(t: Tables):
    return t.obs.select("scope_id", "source_id", "kind", "quality").distinct()
