"""One-minute observations: JSON documents, batch or stream, and what makes one acceptable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilmesh import policies
from vigilmesh.operators.validation import first_reason

L, D, S, TS = T.LongType(), T.DoubleType(), T.StringType(), T.TimestampType()

# The field names and types of schema version 2 and what it requires.
METRICS = T.StructType(
    [T.StructField(n, L) for n in (
        "attempts", "technicalSuccesses", "technicalFailures", "userOutcomes", "rrcAttempts", "rrcSuccesses",
        "bearerAttempts", "bearerSuccesses", "sip503Count", "deliveryAttempts", "deliverySuccesses",
        "deliveredMessages",
    )]
    + [T.StructField("deliveryDelayMs", T.ArrayType(L))]
    + [T.StructField(n, D) for n in ("cpuPct", "packetLossRatio", "throughputMbps")]
    + [T.StructField("queueDepth", L), T.StructField("oldestPendingAgeSeconds", D)]
)

OBSERVATION = T.StructType(
    [T.StructField("schemaVersion", T.IntegerType())]
    + [T.StructField(n, S) for n in ("eventId", "sourceId", "scopeId", "kind")]
    + [T.StructField(n, TS) for n in ("windowStart", "windowEnd", "emittedAt")]
    + [T.StructField(n, S) for n in ("quality", "service", "nodeId")]
    + [T.StructField("metrics", METRICS), T.StructField("_corrupt", S)]
)

REQUIRED = ["eventId", "sourceId", "scopeId", "kind", "windowStart", "windowEnd", "emittedAt", "quality"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Envelope rows (key, payload, received_at) from line files, as a batch."""
    return spark.read.schema("key string, payload string, received_at timestamp, arrival bigint").json(path)


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return (
        spark.readStream.schema("key string, payload string, received_at timestamp, arrival bigint")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def stream_kafka(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """The same envelope from a topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )
    return raw.selectExpr(
        "CAST(key AS STRING) AS key", "CAST(value AS STRING) AS payload", "timestamp AS received_at",
        "partition", "offset AS arrival",
    )


def parse(envelopes: DataFrame) -> DataFrame:
    """``o``: the parsed document; ``o._corrupt`` is set for text that is not one JSON object."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return envelopes.withColumn("o", F.from_json("payload", OBSERVATION, options))


def authorise(parsed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``known_scope`` and ``authorised`` from the catalogue, whose rows are the configured sources."""
    approved = catalogue.groupBy("scope_id").agg(
        F.collect_set(F.when(F.col("role") == "SERVICE", F.concat_ws("|", "service", "source_id"))).alias("services"),
        F.collect_set(F.when(F.col("role") == "NODE", F.concat_ws("|", "node_id", "source_id"))).alias("nodes"),
        F.collect_set("source_id").alias("sources"),
    )
    o = F.col("o")
    joined = parsed.join(approved, o["scopeId"] == F.col("scope_id"), "left")
    allowed = (
        F.when(o["kind"] == "SERVICE", F.array_contains("services", F.concat_ws("|", o["service"], o["sourceId"])))
        .when(o["kind"] == "NODE", F.array_contains("nodes", F.concat_ws("|", o["nodeId"], o["sourceId"])))
        .otherwise(F.array_contains("sources", o["sourceId"]))
    )
    return joined.withColumn("known_scope", F.col("scope_id").isNotNull()).withColumn("authorised", allowed).drop(
        "scope_id", "services", "nodes", "sources"
    )


def counters_inconsistent(o: Column) -> Column:
    m = o["metrics"]

    def more(a: str, b: str) -> Column:
        return m[a] > m[b]

    voice = (
        (m["attempts"] != m["technicalSuccesses"] + m["technicalFailures"] + m["userOutcomes"])
        | more("technicalSuccesses", "attempts") | more("rrcSuccesses", "rrcAttempts")
        | more("bearerSuccesses", "bearerAttempts") | more("sip503Count", "technicalFailures")
    )
    sms = (
        more("deliverySuccesses", "deliveryAttempts") | (m["deliveredMessages"] != F.size(m["deliveryDelayMs"]))
        | more("deliveredMessages", "deliverySuccesses")
    )
    node = (m["queueDepth"] == 0) & (m["oldestPendingAgeSeconds"] != 0)
    bad = (
        F.when((o["kind"] == "SERVICE") & (o["service"] == "VOLTE"), voice)
        .when((o["kind"] == "SERVICE") & (o["service"] == "SMS"), sms)
        .when(o["kind"] == "NODE", node)
    )
    return m.isNotNull() & F.coalesce(bad, F.lit(False))


def rejection_reason() -> Column:
    """Why an authorised, parsed envelope is rejected; null when it may go on to de-duplication."""
    o = F.col("o")
    absent = F.lit(False)
    for name in REQUIRED:
        absent = absent | o[name].isNull()
    absent = (
        absent
        | ((o["kind"] == "SERVICE") & o["service"].isNull())
        | ((o["kind"] == "NODE") & o["nodeId"].isNull())
        | ~o["kind"].isin("SERVICE", "NODE", "HEARTBEAT")
        | ~o["quality"].isin("COMPLETE", "INCOMPLETE", "MISSING")
    )
    span = F.unix_micros(o["windowEnd"]) - F.unix_micros(o["windowStart"])
    aligned = F.pmod(F.unix_micros(o["windowStart"]), F.lit(policies.MINUTE_SECONDS * 1_000_000)) == 0
    return first_reason([
        (o.isNull() | o["_corrupt"].isNotNull(), "MALFORMED_JSON"),
        (absent, "SCHEMA_INVALID"),
        ((span != policies.MINUTE_SECONDS * 1_000_000) | ~aligned | (o["emittedAt"] < o["windowEnd"]),
         "SEMANTIC_INVALID"),
        (~F.col("known_scope"), "SEMANTIC_INVALID"),
        (~F.coalesce("authorised", F.lit(False)), "SOURCE_UNAUTHORIZED"),
        (counters_inconsistent(o), "SEMANTIC_INVALID"),
        (~F.col("key").eqNullSafe(o["scopeId"]), "KEY_MISMATCH"),
    ])


def validate(envelopes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Envelopes with ``o`` and ``reason``. Stateless, so the same call serves batch and stream."""
    return authorise(parse(envelopes), catalogue).withColumn("reason", rejection_reason())


def dead_letters(rejected: DataFrame) -> DataFrame:
    """Bounded evidence of each rejection: reason, hash, the first 64 KiB and true sizes.

    Ids, keys and payloads beyond the bound are stored cut, each with a flag that says so.
    """
    raw = F.encode("payload", "UTF-8")
    size = F.octet_length("payload")
    bound = policies.DEAD_LETTER_ID_CHARS

    def safe(text):
        return F.replace(text, F.lit("\x00"), F.lit("\\u0000"))

    event_id, key = safe(F.col("o.eventId")), safe(F.col("key"))
    return rejected.select(
        "arrival",
        F.col("reason").alias("reason_code"),
        F.substring(event_id, 1, bound).alias("event_id"),
        F.coalesce(F.length(event_id) > bound, F.lit(False)).alias("event_id_truncated"),
        F.substring(key, 1, bound).alias("message_key"),
        F.coalesce(F.length(key) > bound, F.lit(False)).alias("message_key_truncated"),
        F.sha2(raw, 256).alias("payload_hash"),
        F.substring(raw, 1, policies.DEAD_LETTER_RAW_BYTES).alias("raw_payload"),
        size.alias("payload_size"),
        (size > policies.DEAD_LETTER_RAW_BYTES).alias("payload_truncated"),
    )


def receipts(valid: DataFrame) -> DataFrame:
    """Flat accepted-candidate rows with their natural key and content hash."""
    o = F.col("o")
    return valid.select(
        "arrival", "received_at", o["eventId"].alias("event_id"), o["scopeId"].alias("scope_id"),
        o["sourceId"].alias("source_id"), o["kind"].alias("kind"), o["service"].alias("service"),
        o["nodeId"].alias("node_id"), o["windowStart"].alias("window_start"), o["windowEnd"].alias("window_end"),
        o["emittedAt"].alias("emitted_at"), o["quality"].alias("quality"), o["metrics"].alias("metrics"),
        F.sha2(F.to_json(o), 256).alias("content_hash"),
    )
