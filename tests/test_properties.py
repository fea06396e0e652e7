"""Order, replay and partition count change nothing; distributed algorithms equal brute force."""

import math
import random

from pyspark.sql import functions as F

from vigilmesh.models import scaling, selection
from vigilmesh.operators import episodes, ingest, ranks, rollup
from vigilmesh.operators.asof import asof_join
from vigilmesh.operators.latest import empirical_rank
from vigilmesh.operators.primitives import replay_safe_ratio
from vigilmesh.adapters import ARCHIVE_END, ARCHIVE_START
from vigilmesh.plans.lifecycles import series


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_shuffled_partitions_change_nothing(tables):
    base = series(tables)
    want = rows(episodes.service_lifecycle(base, ["scope_id"]).select("scope_id", "window_start", "phase", "sequence"))
    for n in (1, 7):
        mixed = base.repartition(n, F.rand(n))
        assert rows(episodes.service_lifecycle(mixed, ["scope_id"]).select("scope_id", "window_start", "phase", "sequence")) == want


def test_replays_change_no_ratio(tables):
    base = tables.city_facts.select("scope_id", "slot", F.col("data_success").alias("numerator"), F.col("data_attempts").alias("denominator"))
    once = replay_safe_ratio(base, ["scope_id"], "slot", 8640)
    thrice = replay_safe_ratio(base.union(base).union(base), ["scope_id"], "slot", 8640)
    assert rows(once.drop("duplicate_inputs")) == rows(thrice.drop("duplicate_inputs"))


def test_rollup_is_additive_over_resolutions(tables):
    def total(resolution):
        out = rollup.reference_series(tables.city_facts, tables.cities, ["sms.submitted"], rollup.Request(ARCHIVE_START, ARCHIVE_END, resolution))
        return rows(out.groupBy("scope_id").agg(F.sum("value").alias("v")))

    assert total("5m") == total("1h") == total("6h")


def brute_outcomes(deliveries):
    """Deliveries in arrival order, one by one."""
    ids, keys, out = {}, set(), []
    for arrival, event, key, content, late in sorted(deliveries):
        if event in ids:
            out.append((arrival, "DUPLICATE" if ids[event] == (key, content) else "EVENT_ID_CONFLICT"))
        elif key in keys:
            out.append((arrival, "NATURAL_KEY_CONFLICT"))
        elif late:
            out.append((arrival, "LATE_OBSERVATION"))
        else:
            ids[event] = (key, content)
            keys.add(key)
            out.append((arrival, "ACCEPTED"))
    return out


def test_deduplication_equals_one_by_one(spark):
    for seed in range(3):
        rng = random.Random(seed)
        given = [(i, f"e{rng.randrange(12)}", f"k{rng.randrange(12)}", f"c{rng.randrange(2)}", rng.random() < 0.25) for i in range(60)]
        df = spark.createDataFrame(given, "arrival bigint, event_id string, source_id string, content_hash string, late boolean").selectExpr(
            "*", "'s' AS scope_id", "'NODE' AS kind", "timestamp'2026-01-01 00:00:00' AS window_start")
        got = sorted((r.arrival, r.outcome) for r in ingest.classify(df).collect())
        assert got == brute_outcomes(given)


def test_nearest_ranks_equal_sorting(spark):
    rng = random.Random(5)
    given = [(rng.choice("ab"), rng.choice([rng.randrange(10), rng.randrange(10**6), 10**12 + rng.randrange(50)])) for _ in range(4000)]
    df = spark.createDataFrame(given, "k string, v bigint")
    got = {r.k: r for r in ranks.nearest_ranks(df, ["k"], "v", [1, 50, 95, 99, 100]).collect()}
    for key in "ab":
        values = sorted(v for k, v in given if k == key)
        for p in (1, 50, 95, 99, 100):
            assert got[key][f"p{p}"] == values[-(-p * len(values) // 100) - 1]
        assert (got[key].samples, got[key]["min"], got[key]["max"]) == (len(values), values[0], values[-1])


def test_exact_quantiles_equal_sorting(spark):
    rng = random.Random(6)
    given = [(rng.choice("ab"), rng.choice([0.5, rng.gauss(0, 1), rng.gauss(0, 1) * 1e6])) for _ in range(3001)]
    df = spark.createDataFrame(given, "k string, value double")
    for q in (0.5, 0.99):
        got = {r.k: r.quantile for r in scaling.exact_quantiles(df, ["k"], q).collect()}
        for key in "ab":
            values = sorted(v for k, v in given if k == key)
            at = (len(values) - 1) * q
            lo, hi = values[math.floor(at)], values[math.ceil(at)]
            assert abs(got[key] - (lo + (hi - lo) * (at - math.floor(at)))) < 1e-9 * max(1, abs(hi))


def test_empirical_rank_equals_counting(spark):
    rng = random.Random(7)
    known = [round(rng.random(), 2) for _ in range(500)]
    probes = [round(rng.random() * 1.2 - 0.1, 3) for _ in range(300)]
    got = empirical_rank(
        spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "id int, x double"),
        spark.createDataFrame([(v,) for v in known], "x double"), "x").collect()
    assert len(got) == len(probes)
    for r in got:
        assert abs(r["rank"] - sum(v <= r.x for v in known) / len(known)) < 1e-12


def test_asof_equals_scanning(spark):
    rng = random.Random(8)
    right = sorted({(rng.choice("ab"), rng.randrange(0, 40_000) * 10) for _ in range(400)})
    left = [(i, rng.choice("abc"), rng.randrange(0, 40_000) * 10) for i in range(300)]
    l = spark.createDataFrame(left, "id int, k string, s bigint").withColumn("at", F.timestamp_seconds("s"))
    r = spark.createDataFrame([(k, s, s * 2) for k, s in right], "k string, s bigint, v bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for inclusive in (True, False):
        got = {x.id: x.found.v if x.found else None for x in asof_join(l, r, ["k"], "at", "ts", ["v"], 7200, inclusive).collect()}
        for i, key, s in left:
            before = [t for k, t in right if k == key and (t <= s if inclusive else t < s)]
            assert got[i] == (max(before) * 2 if before else None)


def brute_match(truth, found, tolerance):
    pairs = []
    for t in truth:
        for d in found:
            overlap = min(t[3], d[3]) - max(t[2], d[2])
            if t[0] == d[0] and overlap > -tolerance:
                pairs.append((-max(overlap, 0.0), d[4], d[1], t[1]))
    used_t, used_d, out = set(), set(), set()
    for _, _, d, t in sorted(pairs):
        if t not in used_t and d not in used_d:
            used_t.add(t), used_d.add(d), out.add((t, d))
    return out


def test_greedy_matching_equals_one_by_one(spark):
    rng = random.Random(9)

    def make(letter, n):
        out = []
        for i in range(n):
            s = float(rng.randrange(0, 20_000))
            out.append((rng.choice("gh"), f"{letter}{i}", s, s + rng.randrange(100, 6000), s + 60))
        return out

    truth, found = make("t", 40), make("d", 45)
    schema = "g string, id string, start_s double, end_s double, detected_s double"
    pairs = selection.overlap_pairs(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema), "g", 300)
    got = {(r.truth_id, r.detected_id) for r in selection.greedy_match(pairs).collect()}
    assert got == brute_match(truth, found, 300)


def test_matching_by_clusters_equals_one_by_one(spark):
    """Composite keys, clusters settled at once or in rounds, delays and unseen recoveries against plain Python."""
    rng = random.Random(12)
    names = selection.COMPATIBLE

    def episode(letter, i):
        start = rng.randrange(0, 40000)
        key = (f"g{rng.randrange(2)}", "SMS", rng.choice("ab"), rng.choice("xy"))
        return (*key, f"{letter}{i}", float(start), float(start + rng.randrange(60, 5000)))

    truth = [(*e, e[5] + 60, e[6] + 10) for e in (episode("t", i) for i in range(120))]
    found = [(*e, e[5] + 30, None if i % 4 == 0 else e[6] + 20) for i, e in enumerate(episode("d", i) for i in range(150))]
    fields = ", ".join(f"`{n}` string" for n in names) + ", id string, start_s double, end_s double"
    t = spark.createDataFrame(truth + [(None, "SMS", "a", "x", "tn", 0.0, 100.0, 60.0, 110.0)], fields + ", first_finalized_s double, recovered_s double")
    d = spark.createDataFrame(found + [(None, "SMS", "a", "x", "dn", 0.0, 100.0, 30.0, 110.0)], fields + ", detected_s double, recovered_s double")
    offers = sorted(
        (-max(min(a[6], b[6]) - max(a[5], b[5]), 0), b[7], b[4], a[4], a, b)
        for a in truth for b in found if a[:4] == b[:4] and min(a[6], b[6]) - max(a[5], b[5]) > -300)
    taken, want = set(), set()
    for _, _, did, tid, a, b in offers:
        if tid not in taken and did not in taken:
            taken |= {tid, did}
            want.add((tid, did, b[7] - a[5], b[7] - a[7], None if b[8] is None else b[8] - a[8], b[8] is None))
    pairs = selection.candidate_pairs(t, d, 300)
    assert pairs.count() == len(offers)
    for at_once in (5000, 3, 0):
        matched = selection.match_episodes(pairs, at_once=at_once)
        got = {(r.truth_id, r.detected_id, r.detection_delay, r.finalized_delay, r.recovery_delay, r.recovery_unobserved) for r in matched.collect()}
        assert got == want, at_once
    report = selection.matching_report(t, d, pairs, selection.match_episodes(pairs), ["domain"]).first()
    unmatched = {b[4] for *_, b in offers} - taken
    assert (report.tp, report.fp, report.fn, report.duplicates) == (len(want), 151 - len(want), 121 - len(want), len(unmatched))
    assert report.recovery_unobserved == sum(w[5] for w in want)
    assert selection.match_episodes(selection.candidate_pairs(t.limit(0), d, 300)).count() == 0


def test_pairs_of_few_and_of_crowded_clusters_are_the_same(spark):
    """Episodes that meet cluster by cluster or cell by cell against plain Python, also ones that end before they start; pairs are found once."""
    rng = random.Random(31)

    def episode(letter, i):
        start = rng.randrange(0, 60000)
        return (f"g{rng.randrange(3)}", "SMS", "a", "x", f"{letter}{i}", float(start), float(start + rng.randrange(-250, 9000)))

    truth = [(*e, e[5] + 60, e[6] + 10) for e in (episode("t", i) for i in range(90))]
    found = [(*e, e[5] + 30, e[6] + 20) for e in (episode("d", i) for i in range(90))]
    truth += [("g0", None, "a", "x", "tn", 0.0, 100.0, 60.0, 110.0), ("g0", "SMS", "a", "x", "te", None, 100.0, 60.0, 110.0)]
    fields = ", ".join(f"`{n}` string" for n in selection.COMPATIBLE) + ", id string, start_s double, end_s double"
    t = spark.createDataFrame(truth, fields + ", first_finalized_s double, recovered_s double")
    d = spark.createDataFrame(found, fields + ", detected_s double, recovered_s double")
    want = {(a[4], b[4]) for a in truth[:90] for b in found if a[:4] == b[:4] and min(a[6], b[6]) - max(a[5], b[5]) > -300}
    clusters = []
    for at_once in (10**9, 40, 0):
        pairs = selection.candidate_pairs(t, d, 300, at_once=at_once)
        rows = pairs.collect()
        assert len(rows) == len(want) and {(r.truth_id, r.detected_id) for r in rows} == want
        clusters.append({(r.truth_id, r.cluster) for r in rows})
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert clusters[0] == clusters[1] == clusters[2]
