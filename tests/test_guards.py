"""Guards of series requests, ancestry by doubling, and admission of delivered windows, on small hand cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilmesh.dictionary import dictionary_df
from vigilmesh.operators import episodes, guards, topology

AT = datetime(2026, 9, 10, 9)


def test_first_guard_that_holds_is_the_reason(spark):
    window = ("d", "volte.attempts", "C1", AT, "COUNT", "COUNT_SUM", "kpi-v1", "t1", 300)
    other = lambda **kw: tuple({**dict(zip(("d", "m", "s", "at", "unit", "agg", "policy", "topology", "seconds"), window)), **kw}.values())
    stored = [window, other(s="C2"), other(s="C2", at=AT + timedelta(minutes=5), unit="X"), other(s="C3", topology="t0"), other(s="C4", seconds=60), other(s="C5", at=AT - timedelta(days=2), unit="X")]
    windows = spark.createDataFrame(stored, "dataset_id string, metric_id string, scope_id string, bucket_start timestamp, unit string, aggregation string, policy_version string, topology_version string, source_resolution_seconds int")
    day = AT + timedelta(days=1)
    ask = lambda i, scope="C1", metric="volte.attempts", domain="VOLTE", dataset="d", step="5m", start=AT, end=day: (i, dataset, domain, metric, scope, step, start, end)
    requests = spark.createDataFrame(
        [
            ask("ok"), ask("no windows", "C9"), ask("mixed", "C2"), ask("topology", "C3"), ask("seconds", "C4"), ask("mixed outside", "C5"),
            ask("metric", metric="none"), ask("domain", domain="SMS"), ask("null metric", metric=None), ask("dataset", dataset="e"), ask("null dataset", dataset=None),
            ask("scope", "C?"), ask("null scope", None), ask("step", step="2m"), ask("null step", step=None), ask("backwards", start=day, end=AT), ask("null end", end=None),
            ask("buckets", step="1s"), ask("early", start=AT - timedelta(days=9)), ask("late", end=day + timedelta(days=90)),
            ask("direction", "P:in", "roaming.activeOutbound", "ROAMING"), ask("right direction", "P:out", "roaming.activeOutbound", "ROAMING"),
        ],
        "request_id string, dataset_id string, domain string, metric_id string, scope_id string, resolution string, requested_from timestamp, requested_to timestamp")
    datasets = spark.createDataFrame([("d", 300, AT - timedelta(days=3), AT + timedelta(days=30))], "dataset_id string, source_resolution_seconds int, available_from timestamp, available_to timestamp")
    scopes = spark.createDataFrame([(s, "t1") for s in ("C1", "C2", "C3", "C4", "C5", "C9", "P:in", "P:out")], "scope_id string, topology_version string")
    judged = guards.judge(requests, windows, datasets, scopes, dictionary_df(spark))
    got = {r.request_id: r.reason for r in judged.collect()}
    assert got == {
        "ok": None, "no windows": None, "mixed": "MIXED_SHAPES", "topology": "CONTRACT_MISMATCH", "seconds": "CONTRACT_MISMATCH", "mixed outside": None,
        "metric": "UNKNOWN_METRIC", "domain": "UNKNOWN_METRIC", "null metric": "UNKNOWN_METRIC", "dataset": "UNKNOWN_DATASET", "null dataset": "UNKNOWN_DATASET",
        "scope": "UNKNOWN_SCOPE", "null scope": "UNKNOWN_SCOPE", "step": "UNSUPPORTED_RANGE", "null step": "UNSUPPORTED_RANGE", "backwards": "UNSUPPORTED_RANGE", "null end": "UNSUPPORTED_RANGE",
        "buckets": "TOO_MANY_BUCKETS", "early": "OUTSIDE_HISTORY", "late": "TOO_MANY_BUCKETS" if 91 * 288 > 8641 else "OUTSIDE_HISTORY",
        "direction": "SNAPSHOT_DIRECTION", "right direction": None}
    assert {r.request_id for r in guards.answered(judged).collect()} == {k for k, v in got.items() if v is None}
    assert guards.judge(requests.limit(0), windows, datasets, scopes, dictionary_df(spark)).count() == 0


def climbed(nodes, depth):
    """Paths by walking up one node at a time."""
    known, out = {n[0]: n for n in nodes}, {}
    for node_id, parent, kind in nodes:
        path, top = [node_id], (node_id, parent, kind)
        while len(path) < depth and top[1] in known and top[1] not in path:
            top = known[top[1]]
            path.append(top[0])
        out[node_id] = (path[::-1], top[1] is None and top[2] == "COUNTRY")
    return out


def test_ancestry_of_chains_cycles_and_strays(spark):
    nodes = [("root", None, "COUNTRY"), ("far", "gone", "COUNTRY"), ("stray", "far", "X"), ("odd", None, None)]
    nodes += [(f"c{i}", f"c{i - 1}" if i else "root", "X") for i in range(12)]
    nodes += [(f"r{i}", f"r{(i + 1) % 3}", "X") for i in range(3)] + [("tail", "r1", "X"), ("tip", "tail", "X"), ("self", "self", "X"), ("below", "self", "X")]
    frame = spark.createDataFrame(nodes, "node_id string, parent_id string, node_type string").repartition(3)
    for depth in (1, 2, 3, 5, 8, 13, 20):
        got = {r.node_id: (r.path, r.complete) for r in topology.ancestry(frame, depth).collect()}
        assert got == climbed(nodes, depth), depth


def test_a_large_family_below_one_parent(spark):
    leaves = spark.range(5000).selectExpr("concat('l', id) AS node_id", "'root' AS parent_id", "'X' AS node_type")
    frame = leaves.unionByName(spark.createDataFrame([("root", None, "COUNTRY")], "node_id string, parent_id string, node_type string"))
    assert topology.ancestry(frame).where("complete AND size(path) <= 2").count() == 5001


def test_admitted_windows_by_hand(spark):
    at = lambda n: AT + timedelta(hours=n)
    offers = [  # hour, revision, fingerprint, arrival
        (0, 1, "a", 1), (0, 1, "a", 2), (1, 1, "a", 3), (1, 1, "b", 4), (1, 1, "b", 5), (1, 2, "a", 6), (0, 1, "c", 7),
        (4, 1, "a", 8), (3, 1, "a", 9), (3, 1, "b", 10), (4, 1, "a", 11), (5, 2, "a", 12), (5, 1, "a", 13)]
    frame = spark.createDataFrame([("A", at(h), at(h + 1), r, f, a) for h, r, f, a in offers], "scope_id string, window_start timestamp, window_end timestamp, revision bigint, fingerprint string, arrival bigint")
    got = {((r.window_start - AT).total_seconds() // 3600, r.revision, r.fingerprint): (r.outcome, r.copies) for r in episodes.admitted(frame, ["scope_id"]).collect()}
    assert got == {
        (0, 1, "a"): ("COMMITTED", 2), (1, 1, "a"): ("COMMITTED", 1), (1, 1, "b"): ("CONFLICT", 2), (1, 2, "a"): ("LATE", 1), (0, 1, "c"): ("CONFLICT", 1),
        (4, 1, "a"): ("COMMITTED", 2), (3, 1, "a"): ("LATE", 1), (3, 1, "b"): ("LATE", 1), (5, 2, "a"): ("COMMITTED", 1), (5, 1, "a"): ("LATE", 1)}
    assert episodes.admitted(frame.where(F.lit(False)), ["scope_id"]).count() == 0
