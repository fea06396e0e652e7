"""Streams over files give what the batch operators give."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilmesh.operators import episodes as batch_episodes
from vigilmesh.operators import ingest, windows
from vigilmesh.plans.ingestion import envelopes
from vigilmesh.plans.lifecycles import domain_series, offers, series
from vigilmesh.sources import observations
from vigilmesh.streaming import flows, identities, silence, stateful

NODES = ["N0", "N1", "N2"]
SERVICE = ["attempts", "technicalSuccesses", "deliveredMessages"]
NODE = ["cpuPct", "queueDepth"]


def run(query):
    query.awaitTermination(240)
    assert query.exception() is None


def ordered_files(df, path, column, pieces):
    """Write ``df`` as numbered files that follow ``column``, so that a file stream sees it in order."""
    frame = df.orderBy(column).toPandas()
    step = max(1, -(-len(frame) // pieces))
    for i in range(pieces):
        part = frame.iloc[i * step : (i + 1) * step]
        if len(part):
            df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_service_episodes_stream_equals_batch(spark, tables, tmp_path):
    source = series(tables).select("scope_id", "window_start", "window_end", "verdict", "severity")
    path = str(tmp_path / "in")
    ordered_files(source, path, "window_start", 4)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(flows.write_table(stateful.episodes(stream), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = batch_episodes.service_lifecycle(series(tables), ["scope_id"]).select(
        "scope_id", "window_start", "phase", "sequence", "first_observed_at", F.col("episode_severity").alias("severity"))
    assert want.count() > 20
    assert rows(got.select(want.columns)) == rows(want)


def test_two_domains_of_a_scope_are_two_machines(spark, tables, tmp_path):
    one = domain_series(tables).select(
        "scope_id", "window_start", "window_end", "verdict", "severity", "backlog_required", "drained")
    # The second domain sees the first one's windows a day later, under the same scopes.
    other = one.withColumns({c: F.col(c) + F.expr("INTERVAL 1 DAY") for c in ("window_start", "window_end")})
    source = one.withColumn("domain", F.lit("sms")).unionByName(other.withColumn("domain", F.lit("data")))
    path, keys = str(tmp_path / "in"), ("domain", "scope_id")
    ordered_files(source, path, "window_start", 3)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(flows.write_table(stateful.episodes(stream, domain=True, keys=keys), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = batch_episodes.domain_lifecycle(source, list(keys)).select(
        *keys, "window_start", "phase", "sequence", "first_observed_at", F.col("episode_severity").alias("severity"))
    assert rows(got.select(want.columns)) == rows(want)


def test_domain_episodes_stream_equals_batch(spark, tables, tmp_path):
    source = domain_series(tables).select(
        "scope_id", "window_start", "window_end", "verdict", "severity", "backlog_required", "drained")
    path = str(tmp_path / "in")
    ordered_files(source, path, "window_start", 3)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(flows.write_table(stateful.episodes(stream, domain=True), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = batch_episodes.domain_lifecycle(domain_series(tables), ["scope_id"]).select(
        "scope_id", "window_start", "phase", "sequence", "first_observed_at", F.col("episode_severity").alias("severity"))
    assert rows(got.select(want.columns)) == rows(want)


def envelope_stream(spark, tables, tmp_path, pieces=3):
    source = envelopes(tables)
    path = str(tmp_path / "envelopes")
    ordered_files(source, path, "received_at", pieces)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_close_once_and_equal_batch(spark, tables, tmp_path):
    stream = flows.timely_receipts(envelope_stream(spark, tables, tmp_path), tables.catalogue)
    closed = flows.closed_windows(stream, tables.catalogue, NODES, SERVICE, NODE).select(
        "scope_id", "window_start", "window_end", "quality", "accepted", "s.event_id")
    run(flows.write_table(closed, str(tmp_path / "out"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "out"))

    valid = observations.validate(envelopes(tables), tables.catalogue).where(F.col("reason").isNull())
    receipts = observations.receipts(valid).where(~ingest.is_late())
    flat = receipts.select("*", *[F.col(f"metrics.{f}").alias(f) for f in [*SERVICE, *NODE]])
    want = windows.finalize(windows.approve_nodes(flat, tables.catalogue), NODES, SERVICE, NODE).select(
        "scope_id", "window_start", "window_end", "quality", "accepted", "s.event_id")
    horizon = want.agg(F.max("window_end")).first()[0]
    due = want.where(F.col("window_end") < F.lit(horizon) - F.expr("INTERVAL 10 SECONDS"))
    assert rows(got) == rows(due)
    assert got.count() == got.select("scope_id", "window_start").distinct().count()


DELIVERED = ["event_id", "scope_id", "source_id", "kind", "window_start", "window_end", "received_at", "content_hash", "arrival"]


def in_steps(spark, source, column, tmp_path, flow, cuts):
    """Run ``flow`` over files that follow ``column``, once per cut: each run but the first is a restart."""
    path, out, ck = (str(tmp_path / name) for name in ("in", "out", "ck"))
    low = None
    for cut in [*cuts, None]:
        part = source if low is None else source.where(F.col(column) >= low)
        part = part if cut is None else part.where(F.col(column) < cut)
        ordered_files(part, path, column, 2)
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
        run(flows.write_table(flow(stream), out, ck))
        low = cut
    return spark.read.parquet(out)


def test_streamed_outcomes_equal_batch(spark, tables, tmp_path):
    source = tables.obs_dup.withColumn("event_id", F.col("event_id").cast("string")).select(DELIVERED)
    got = in_steps(spark, source, "arrival", tmp_path, identities.outcomes, [])
    want = ingest.classify(source.withColumn("late", ingest.is_late()))
    assert rows(got.select("arrival", "outcome")) == rows(want.select("arrival", "outcome"))
    assert got.select("outcome").distinct().count() >= 4


def reused_ids(spark):
    """Ids that come again in another minute, scope or kind, across and within files, with copies and late ones."""
    at = lambda minute, second=0: datetime(2024, 1, 1, 0, minute, second)
    out = []

    def deliver(event_id, scope, source, minute, content, received=None, kind="SERVICE"):
        received = received or at(minute + 1, 5)
        out.append((event_id, scope, source, kind, at(minute), at(minute + 1), received, content, len(out) + 1))

    for minute in range(12):
        deliver(f"a{minute}", "A", "src", minute, f"h{minute}")
        deliver(f"n{minute}", "A", "node", minute, f"n{minute}", kind="NODE")
        if minute % 3 == 1:
            deliver(f"a{minute - 1}", "A", "src2", minute, f"h{minute - 1}")  # reused in the next minute
            deliver(f"a{minute}", "B", "src", minute, f"h{minute}")  # and in another scope
            deliver(f"n{minute}", "A", "node", minute, "changed", kind="NODE")
        if minute % 4 == 2:
            deliver(f"a{minute}", "A", "src", minute, f"h{minute}")  # a copy
            deliver(f"x{minute}", "A", "src", minute, "other")  # the natural key is taken
            deliver(f"late{minute}", "B", "src", minute, "late", at(minute + 1, 10))
            deliver(f"late{minute}", "B", "src", minute + 1, "in time", at(minute + 2))
            deliver(f"late{minute}", "B", "src", minute + 2, "again", at(minute + 2))
    schema = "event_id string, scope_id string, source_id string, kind string, window_start timestamp, window_end timestamp, received_at timestamp, content_hash string, arrival bigint"
    return spark.createDataFrame(out, schema).select(DELIVERED)


def test_ids_reused_in_another_minute_conflict_over_restarts(spark, tmp_path):
    source = reused_ids(spark)
    got = in_steps(spark, source, "arrival", tmp_path, identities.outcomes, [12, 13, 30])
    want = ingest.classify(source.withColumn("late", ingest.is_late()))
    assert rows(got.select("arrival", "event_id", "outcome")) == rows(want.select("arrival", "event_id", "outcome"))
    moved = got.where("outcome = 'EVENT_ID_CONFLICT' AND source_id = 'src2'")
    assert moved.count() == 4


def test_id_that_lost_its_natural_key_is_not_freed_in_the_stream(spark, tmp_path):
    """The one difference from the batch operator, as documented."""
    at = datetime(2024, 1, 1)
    minute = lambda n: at + timedelta(minutes=n)
    deliveries = [("first", 0, 1), ("second", 0, 2), ("second", 1, 3)]
    source = spark.createDataFrame(
        [(e, "A", "src", "SERVICE", minute(m), minute(m + 1), minute(m + 1), e, a) for e, m, a in deliveries], reused_ids(spark).schema)
    got = {r.arrival: r.outcome for r in in_steps(spark, source, "arrival", tmp_path, identities.outcomes, []).collect()}
    want = {r.arrival: r.outcome for r in ingest.classify(source.withColumn("late", ingest.is_late())).collect()}
    assert got == {1: "ACCEPTED", 2: "NATURAL_KEY_CONFLICT", 3: "EVENT_ID_CONFLICT"}
    assert want == {**got, 3: "ACCEPTED"}


START = datetime(2024, 1, 1)


def minutes_of(spark, by_scope):
    at = lambda n: START + timedelta(minutes=n)
    return spark.createDataFrame(
        [(scope, at(n), at(n + 1)) for scope, some in by_scope.items() for n in some], "scope_id string, window_start timestamp, window_end timestamp")


def ranges_of(spark, *ranges):
    at = lambda n: START + timedelta(minutes=n)
    return spark.createDataFrame([(s, at(a), at(b)) for s, a, b in ranges], "scope_id string, monitored_from timestamp, monitored_through timestamp")


def test_silent_scopes_are_told_once_over_restarts_and_equal_batch(spark, tmp_path):
    known = minutes_of(spark, {
        "clock": range(60), "ranged": [n for n in range(30) if n not in (5, 6, 20)], "open": [3, 4, 9, 31], "outside": [1, 40]})
    ranges = ranges_of(
        spark, ("ranged", 0, 30), ("silent", 0, 4), ("silent", 10, 13), ("silent", 2, 5), ("silent", 8, 8), ("ahead", 55, 90), ("outside", 2, 5))
    flow = lambda s: silence.silent_windows(s.withWatermark("window_end", "10 seconds"), ranges)
    cuts = [START + timedelta(minutes=n) for n in (3, 25, 26)]
    got = in_steps(spark, known, "window_start", tmp_path, flow, cuts)
    due = F.lit(START + timedelta(minutes=60) - timedelta(seconds=10))
    want = windows.silent_windows(known, ranges, due)
    assert rows(got.select(want.columns)) == rows(want)
    counts = dict(got.groupBy("scope_id").count().collect())
    assert counts == {"ranged": 3, "silent": 8, "open": 52, "ahead": 4, "outside": 3}


def test_silence_without_a_catalogue_of_ranges(spark, tmp_path):
    known = minutes_of(spark, {"clock": range(30), "late starter": [12, 11, 20]})
    got = in_steps(spark, known, "window_start", tmp_path, lambda s: silence.silent_windows(s.withWatermark("window_end", "10 seconds")), [])
    assert sorted(r.window_start.minute for r in got.collect()) == [*range(13, 20), *range(21, 29)]


def test_live_clock_tells_silence_without_any_input(spark, tmp_path):
    """Nothing arrives after the first file; the wall clock alone makes windows due."""
    path, out, ck = (str(tmp_path / name) for name in ("in", "out", "ck"))
    now = datetime.now().replace(microsecond=0)
    at = lambda n: now + timedelta(seconds=n)
    schema = "scope_id string, window_start timestamp, window_end timestamp"
    ordered_files(spark.createDataFrame([("talker", at(0), at(1))], schema), path, "window_start", 1)
    ranges = spark.createDataFrame([("silent", at(-2), at(4))], "scope_id string, monitored_from timestamp, monitored_through timestamp")
    stream = spark.readStream.schema(schema).parquet(path)
    told = silence.silent_windows(stream, ranges, live=True, seconds=1, lateness=1).where("scope_id = 'silent'")
    query = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.read.schema(silence.SILENT).parquet(out).count() < 6:
            time.sleep(1)
        time.sleep(2)
    finally:
        query.stop()
    got = sorted(r.window_start for r in spark.read.parquet(out).collect())
    assert got == [at(n) for n in range(-2, 4)]


OFFER = ["scope_id", "window_start", "window_end", "verdict", "severity", "backlog_required", "drained", "revision", "fingerprint", "arrival"]


def test_replays_and_conflicts_of_domain_windows_over_restarts(spark, tables, tmp_path):
    source = offers(tables).where("scope_id IN ('S1', 'S2')").select(OFFER)
    third = source.agg(F.percentile_approx("arrival", [0.33, 0.66])).first()[0]
    got = in_steps(spark, source, "arrival", tmp_path, stateful.admitted_episodes, third)
    want = batch_episodes.admitted_lifecycle(source, ["scope_id"])
    assert rows(got.select(want.columns)) == rows(want)
    outcomes = dict(got.groupBy("outcome").count().collect())
    assert outcomes["CONFLICT"] > 20 and outcomes["TRANSITION"] > 20
    # Everything once more is replays only: no transition, no second conflict, in the stream after another restart.
    again = source.withColumn("arrival", F.col("arrival") + 10**9)
    before = got.count()
    ordered_files(again, str(tmp_path / "in"), "arrival", 2)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(flows.write_table(stateful.admitted_episodes(stream), str(tmp_path / "out"), str(tmp_path / "ck")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == before


def test_forgotten_fingerprints_are_only_late(spark, tmp_path):
    at = lambda n: START + timedelta(hours=n)
    windows_ = [("A", at(n), at(n + 1), "HEALTHY", "HIGH", False, None, 1, f"f{n}", n) for n in range(60)]
    windows_ += [("A", at(n), at(n + 1), "HEALTHY", "HIGH", False, None, 1, "changed", 100 + n) for n in (2, 59)]
    schema = "scope_id string, window_start timestamp, window_end timestamp, verdict string, severity string, backlog_required boolean, drained boolean, revision bigint, fingerprint string, arrival bigint"
    source = spark.createDataFrame(windows_, schema)
    got = in_steps(spark, source, "arrival", tmp_path, lambda s: stateful.admitted_episodes(s, remembered=10 * 3600), [20, 40, 60, 100])
    assert [(r.outcome, r.window_start) for r in got.collect()] == [("CONFLICT", at(59))]


def test_streamed_service_evidence_equals_batch(spark, tmp_path):
    """Verdicts on nodes, and services whose nodes never came, told when their minute is evicted."""
    at = lambda n: START + timedelta(minutes=n)
    out = []
    for n in range(30):
        for scope in ("A", "B"):
            out.append((len(out), scope, "svc", None, "SERVICE", at(n), at(n + 1), "COMPLETE", None))
        if n % 3:
            out.append((len(out), "A", "src", "N0", "NODE", at(n), at(n + 1), "COMPLETE" if n % 4 else "INCOMPLETE", 1.0 if n % 5 else None))
            out.append((len(out), "A", "other", "N0", "NODE", at(n), at(n + 1), "COMPLETE", 1.0))
        if n % 7 == 0:
            out.append((len(out), "B", "src", None, "HEARTBEAT", at(n), at(n + 1), "COMPLETE", None))
    schema = "event_id bigint, scope_id string, source_id string, node_id string, kind string, window_start timestamp, window_end timestamp, quality string, cpu_pct double"
    source = spark.createDataFrame(out, schema).withColumns({c: F.lit(None).cast("double") for c in ("packet_loss_ratio", "queue_depth")})
    catalogue = spark.createDataFrame([("A", "src", "NODE", "N0")], "scope_id string, source_id string, role string, node_id string")
    flow = lambda s: windows.service_evidence(s, catalogue, flows.LATENESS)
    got = in_steps(spark, source, "window_end", tmp_path, flow, [at(12)])
    want = windows.service_evidence(source, catalogue, flows.LATENESS)
    settled = want.where((F.col("verdict") != "NODE_MISSING") | (F.col("window_start") < F.lit(at(29) - timedelta(seconds=10))))
    assert rows(got.select(want.columns)) == rows(settled)
    verdicts = dict(got.groupBy("verdict").count().collect())
    assert set(verdicts) == {"NODE_MISSING", "ACCEPTED", "UNAPPROVED_DEPENDENCY", "QUALITY_INELIGIBLE", "MEASUREMENT_MISSING", "NOT_NODE"}


def test_streamed_node_verdicts_and_coverage_equal_batch(spark, tables, tmp_path):
    offered = tables.obs_metrics.withColumns({
        "for_scope": F.expr("CASE WHEN event_id % 29 = 0 THEN 'S?' ELSE scope_id END"),
        "for_window": F.expr("CASE WHEN event_id % 31 = 0 THEN window_end ELSE window_start END")})
    got = in_steps(spark, offered, "window_end", tmp_path / "nodes", lambda s: windows.node_evidence(s, tables.catalogue).select("event_id", "verdict"), [])
    assert rows(got) == rows(windows.node_evidence(offered, tables.catalogue).select("event_id", "verdict"))

    def coverage(receipts):
        s = windows.coverage_snapshot(receipts.withWatermark("window_start", "70 seconds"), tables.catalogue)
        state = windows.coverage_state(F.col("expected"), F.col("usable"), F.lit(False))
        return s.select("scope_id", "window_start", "expected", "received", "usable", "issues", state.alias("state"))

    middle = tables.obs.agg(F.percentile_approx(F.unix_seconds("window_start"), 0.5)).first()[0]
    cut = tables.obs.select(F.timestamp_seconds(F.lit(middle))).first()[0]
    got = in_steps(spark, tables.obs, "window_start", tmp_path / "coverage", coverage, [cut])
    horizon = tables.obs.agg(F.max("window_start")).first()[0] - timedelta(seconds=70)
    want = coverage(tables.obs).where(F.col("window_start") <= F.lit(horizon))
    assert rows(got.select(want.columns)) == rows(want) and want.select("state").distinct().count() >= 2


def test_dead_letters_survive_a_restart(spark, tables, tmp_path):
    source = envelopes(tables)
    path = str(tmp_path / "envelopes")
    ordered_files(source, path, "received_at", 2)
    out, ck = str(tmp_path / "dead"), str(tmp_path / "ck")
    for _ in range(2):  # the second run finds nothing new and must write nothing twice
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
        run(flows.write_dead_letters(stream, tables.catalogue, out, ck))
    got = spark.read.parquet(out)
    want = observations.validate(source, tables.catalogue).where(F.col("reason").isNotNull())
    assert rows(got.select("arrival", "reason_code")) == rows(want.select("arrival", "reason"))


def test_counts_and_state_in_update_mode(spark, tables, tmp_path):
    stream = flows.timely_receipts(envelope_stream(spark, tables, tmp_path), tables.catalogue)
    query = (
        flows.bucket_counts(stream).writeStream.format("memory").queryName("bucket_counts").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    run(query)
    got = spark.table("bucket_counts").groupBy("scope_id", "window_start").agg(F.max("accepted_input_count").alias("n"))
    valid = observations.validate(envelopes(tables), tables.catalogue).where(F.col("reason").isNull())
    want = windows.bucket_counts(observations.receipts(valid).where(~ingest.is_late()))
    assert rows(got) == rows(want.select("scope_id", "window_start", "accepted_input_count"))
