"""Hand-derived cases at exact boundaries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions import leakage, quality, timebins
from vigilmesh.functions.arithmetic import half_up, histogram_quantile, nearest_rank, percent
from vigilmesh.operators import episodes, incidents, ingest, rules, topology, windows
from vigilmesh.operators.baseline import fit
from vigilmesh.operators.rollup import Request, reference_series
from vigilmesh.streaming.machines import Episode, domain_step, service_step


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]).select(column).first()[0]


@pytest.mark.parametrize("counts, expected", [
    ([0] * 9, None),
    ([10] + [0] * 8, 0.475),
    ([95, 5] + [0] * 7, 0.5),                      # rank falls exactly on the first edge
    ([94, 6] + [0] * 7, 0.5 + (95 - 94) / 6 * 0.5),
    ([0] * 8 + [20], 30 + 0.95 * 30),
    ([57, 3] + [0] * 7, 0.5),                      # 0.95 * 60 is not exact in doubles
])
def test_histogram_p95(spark, counts, expected):
    got = spark.createDataFrame([(counts,)], "h array<bigint>").select(
        histogram_quantile(F.col("h"), policies.VOICE_EDGES)).first()[0]
    assert got is None if expected is None else got == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("values, expected", [([], None), ([7], 7), (list(range(1, 21)), 19), (list(range(1, 101)), 95), ([3, 1, 2], 3)])
def test_nearest_rank(spark, values, expected):
    assert spark.createDataFrame([(values,)], "a array<bigint>").select(nearest_rank(F.col("a"))).first()[0] == expected


def test_null_instead_of_zero(spark):
    row = spark.range(1).select(percent(F.lit(0), F.lit(0)).alias("a"), percent(F.lit(0), F.lit(5)).alias("b"),
                                half_up(F.lit(2.5)).alias("c"), half_up(F.lit(2.4999)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (None, 0.0, 3, 2)


def test_quality_ranks_round_trip(spark):
    names = list(policies.QUALITY_RANK)
    df = spark.createDataFrame([(n,) for n in names], "q string")
    assert [r[0] for r in df.select(quality.from_rank(quality.rank(F.col("q")))).collect()] == names


def test_request_bounds():
    b = timebins.request_bounds("2026-09-10 09:07:00", "2026-09-10 10:10:00", "15m")
    assert (b["points"], b["partial_start"], b["partial_end"]) == (5, True, True)
    assert timebins.request_bounds("2026-09-10 00:00:00", "2026-10-10 00:00:00", "5m")["points"] == 8640
    with pytest.raises(ValueError):
        timebins.request_bounds("2026-09-10 00:00:00", "2026-10-11 00:00:00", "5m")
    with pytest.raises(ValueError):
        timebins.request_bounds("2026-09-10 00:00:00", "2026-09-11 00:00:00", "1m")


def verdicts(spark, text, gaps=()):
    """B, H, G, U letters as one-minute windows; ``gaps`` lists positions preceded by a missing minute."""
    names = {"B": "BREACH", "H": "HEALTHY", "G": "GRAY", "U": "UNKNOWN"}
    at, rows = datetime(2026, 1, 1), []
    for i, letter in enumerate(text):
        at += timedelta(minutes=2 if i in gaps else 1)
        rows.append(("s", at, at + timedelta(minutes=1), names[letter], "HIGH", False, None))
    return spark.createDataFrame(
        rows, "scope_id string, window_start timestamp, window_end timestamp, verdict string, severity string, "
        "backlog_required boolean, drained boolean")


@pytest.mark.parametrize("text, gaps, service, domain", [
    ("B", (), [], []),
    ("BB", (), ["OPEN"], ["OPEN"]),
    ("BGB", (), [], []),
    ("BB", (1,), [], []),
    ("BBHHH", (), ["OPEN", "UPDATE", "UPDATE", "RECOVERY"], ["OPEN", "UPDATE", "UPDATE", "RECOVERY"]),
    ("BBHHGHHH", (), ["OPEN"] + ["UPDATE"] * 5 + ["RECOVERY"], ["OPEN"] + ["UPDATE"] * 5 + ["RECOVERY"]),
    ("BBU", (), ["OPEN", "UNKNOWN"], ["OPEN", "UNKNOWN"]),
    # After a gap the service machine counts its own window, the domain machine does not.
    ("BBHHH", (2,), ["OPEN", "UNKNOWN", "UPDATE", "RECOVERY"], ["OPEN", "UNKNOWN", "UPDATE", "UPDATE"]),
    ("BBB", (1,), ["OPEN"], []),
    ("BBHHHBB", (), ["OPEN", "UPDATE", "UPDATE", "RECOVERY", "OPEN"], ["OPEN", "UPDATE", "UPDATE", "RECOVERY", "OPEN"]),
    ("HHHBB", (), ["OPEN"], ["OPEN"]),
])
def test_lifecycles(spark, text, gaps, service, domain):
    df = verdicts(spark, text, gaps)
    got = lambda f: [r.phase for r in f.orderBy("window_start").collect()]
    assert got(episodes.service_lifecycle(df, ["scope_id"])) == service
    assert got(episodes.domain_lifecycle(df, ["scope_id"])) == domain
    # the sequential machines agree
    rows = [(int(r.window_start.timestamp()), int(r.window_end.timestamp()), r.verdict) for r in df.orderBy("window_start").collect()]
    a, b = Episode(), Episode()
    assert [x[0] for x in (service_step(a, s, e, v, "HIGH") for s, e, v in rows) if x] == service
    assert [x[0] for x in (domain_step(b, s, e, v, "HIGH", False, None) for s, e, v in rows) if x] == domain


def test_late_window_changes_nothing():
    state = Episode()
    service_step(state, 0, 60, "BREACH", "HIGH")
    service_step(state, 60, 120, "BREACH", "HIGH")
    assert service_step(state, 0, 60, "HEALTHY", "HIGH") is None and state.end == 120 and state.active


def test_backlog_gate_and_severity():
    state = Episode()
    for start in (0, 300):
        domain_step(state, start, start + 300, "BREACH", "CRITICAL" if start == 0 else "HIGH", True, None)
    assert state.severity == "CRITICAL"
    phases = [domain_step(state, s, s + 300, "HEALTHY", "HIGH", True, d)[0]
              for s, d in ((600, None), (900, False), (1200, True), (1500, True), (1800, True))]
    assert phases == ["UNKNOWN", "UPDATE", "UPDATE", "UPDATE", "RECOVERY"]


@pytest.mark.parametrize("attempts, success, base, expected", [
    (1000, 970, 98.0, (False, False)),   # exactly one point down: not a breach
    (1000, 969, 98.0, (True, False)),
    (1000, 975, 98.0, (False, True)),    # exactly half a point: healthy
    (1000, 974, 98.0, (False, False)),
    (99, 0, 98.0, (False, False)),       # too few attempts
])
def test_voice_rule_boundaries(spark, attempts, success, base, expected):
    df = spark.createDataFrame([("COMPLETE", attempts, success, base)], "quality string, eligible_attempts bigint, technical_successes bigint, b_cssr double")
    r = rules.voice_rule(df).first()
    assert (bool(r.breached), bool(r.healthy_now)) == expected


@pytest.mark.parametrize("lost, verdict, severity", [(10, "HEALTHY", None), (20, "GRAY", None), (21, "BREACH", "HIGH"), (40, "BREACH", "HIGH"), (41, "BREACH", "CRITICAL")])
def test_loss_rule_boundaries(spark, lost, verdict, severity):
    out = rules.absolute_rule(F.lit(True), F.lit(lost), F.lit(1000), policies.LOSS, 100)
    row = spark.range(1).select(*[c.alias(k) for k, c in out.items()]).first()
    assert (row.verdict, row.severity) == (verdict, severity)


def test_snapshot_older_than_600_seconds_is_stale(spark):
    rows = [("C", datetime(2026, 9, 10, 9, 0), 5, 0), ("C", datetime(2026, 9, 10, 9, 5), 7, 0)]
    facts = spark.createDataFrame(rows, "scope_id string, ts timestamp, sms_queue bigint, sms_oldest_seconds bigint")
    scopes = spark.createDataFrame([("C",)], "scope_id string")
    out = {(r.metric_id, r.bucket_start.strftime("%H:%M")): r for r in reference_series(
        facts, scopes, ["sms.queue", "sms.queueGrowth"], Request("2026-09-10 09:00:00", "2026-09-10 09:30:00", "5m")).collect()}
    q = lambda m, t: out[(m, t)].quality
    assert (q("sms.queue", "09:05"), q("sms.queue", "09:10"), q("sms.queue", "09:15")) == ("INSUFFICIENT_EVIDENCE", "PARTIAL", "STALE")
    assert out[("sms.queueGrowth", "09:05")].value == 2
    assert out[("sms.queueGrowth", "09:00")].null_reason == "OPENING_SNAPSHOT_UNAVAILABLE"


def test_partial_opening_edge_has_no_growth(spark):
    rows = [("C", datetime(2026, 9, 10, 8, 55), 1, 0), ("C", datetime(2026, 9, 10, 9, 5), 4, 0)]
    facts = spark.createDataFrame(rows, "scope_id string, ts timestamp, sms_queue bigint, sms_oldest_seconds bigint")
    scopes = spark.createDataFrame([("C",)], "scope_id string")

    def growth(start):
        return reference_series(facts, scopes, ["sms.queueGrowth"], Request(start, "2026-09-10 09:15:00", "15m")).first()

    assert growth("2026-09-10 09:00:00").value == 3
    assert growth("2026-09-10 09:05:00").null_reason == "OPENING_SNAPSHOT_UNAVAILABLE"


def test_clock_change_shares_slots(spark):
    # 25 October 2026: 00:30 and 01:30 UTC are both 03:30 local.
    df = spark.createDataFrame([(datetime(2026, 10, 25, h, 30),) for h in (0, 1)], "ts timestamp")
    slots = [tuple(r) for r in df.select(*timebins.local_slot(F.col("ts")).values()).collect()]
    assert slots[0] == slots[1] and slots[0][0] == 42 and slots[0][1] == "WEEKEND"


def test_seasonal_fit_needs_three_days(spark):
    start = datetime(2026, 9, 14, 9, 0)  # a Monday

    def samples(days):
        return spark.createDataFrame(
            [("m", "s", start + timedelta(days=d), start + timedelta(days=d, minutes=5), float(v), 1.0, True) for d, v in days],
            "metric_id string, scope_id string, from_ts timestamp, to_ts timestamp, value double, coverage double, eligible boolean")

    none = spark.createDataFrame([], "e_from timestamp, e_to timestamp")
    bounds = ("2026-09-14 00:00:00", "2026-09-17 00:00:00")
    cell = fit(samples([(0, 90), (1, 96), (2, 99)]), none, *bounds).collect()
    assert [(c.center, c.mad, c.distinct_days, c.expected_days) for c in cell] == [(96.0, 3.0, 3, 3)]
    assert fit(samples([(0, 90), (1, 96)]), none, *bounds).count() == 0


def test_truth_guard(spark):
    nested = spark.createDataFrame([], "a int, b struct<c: array<struct<groundTruth: int>>>")
    assert leakage.truth_paths(nested.schema) == ["b.c[].groundTruth"]
    with pytest.raises(ValueError):
        leakage.reject_truth(nested)
    assert leakage.reject_truth(spark.createDataFrame([], "expectedSeconds int, cpuPct double")) is not None


def test_containment_is_cycle_safe(spark):
    nodes = spark.createDataFrame([("a", "b", "REGION"), ("b", "a", "REGION"), ("r", None, "COUNTRY"), ("x", "r", "REGION")],
                                  "node_id string, parent_id string, node_type string")
    got = {r.node_id: (r.path, r.complete) for r in topology.ancestry(nodes).collect()}
    assert got["x"] == (["r", "x"], True) and got["r"] == (["r"], True)
    assert got["a"][0] == ["b", "a"] and not got["a"][1]


def test_gap_discovery(spark):
    t = lambda m: datetime(2026, 1, 1, 0, m)
    known = spark.createDataFrame([("s", t(0), t(1)), ("s", t(3), t(4))], "scope_id string, window_start timestamp, window_end timestamp")
    got = windows.expected_gaps(known, F.lit("2026-01-01 00:06:00").cast("timestamp"))
    assert [r.window_start.minute for r in got.orderBy("window_start").collect()] == [1, 2, 4, 5]


def test_receipt_at_closure_is_late(spark):
    end = datetime(2026, 1, 1, 0, 1)
    df = spark.createDataFrame([(end, end + timedelta(seconds=s)) for s in (9, 10)], "window_end timestamp, received_at timestamp")
    assert [r[0] for r in df.select(ingest.is_late()).collect()] == [False, True]


def test_prefix_stops_at_a_gap(spark):
    base = datetime(2026, 1, 1)
    rows = [("e", i, "s", "SMS", base, base + timedelta(minutes=i), base + timedelta(minutes=i + 1), "UPDATE" if i > 1 else "OPEN", "ONGOING", "HIGH") for i in (1, 2, 4)]
    df = spark.createDataFrame(rows, "episode_id string, sequence bigint, scope_id string, service string, first_observed_at timestamp, window_start timestamp, window_end timestamp, phase string, technical_state string, episode_severity string")
    r = incidents.fold(df).first()
    assert (r.latest_sequence, r.pending) == (2, 1)
