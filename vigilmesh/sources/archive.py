"""The five-minute CSV archive: pinned layouts, typed reading, identities, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilmesh.functions.fingerprint import identity
from vigilmesh.operators.rollup import HISTOGRAMS, SNAPSHOTS, SUMS  # noqa: F401  (re-exported layout groups)

# Column order of each archive file.
LAYOUT = {
    "city_kpi_5m.csv": (
        "ts timestamp, city_id string, voice_attempts bigint, voice_success bigint, voice_drops bigint, "
        "voice_holding_seconds decimal(22,6), voice_baseline_erlang decimal(22,6), "
        "voice_setup_elapsed_seconds decimal(22,6), voice_setup_hist string, sms_submitted bigint, "
        "sms_delivered bigint, sms_expired bigint, sms_queue bigint, sms_oldest_seconds decimal(22,6), "
        "sms_delay_hist string, data_attempts bigint, data_success bigint, dns_attempts bigint, dns_success bigint, "
        "user_throughput_mbps decimal(22,6), ho_attempts bigint, ho_success bigint"
    ),
    "link_kpi_5m.csv": (
        "ts timestamp, link_id string, traffic_gbps decimal(22,6), effective_capacity_gbps decimal(22,6), "
        "loss_pct decimal(22,6), rtt_ms decimal(22,6), jitter_ms decimal(22,6), interface_errors bigint, "
        "queue_drops bigint"
    ),
    "roaming_kpi_5m.csv": (
        "ts timestamp, country_id string, direction string, partner_id string, active_users bigint, "
        "reg_attempts bigint, reg_success bigint, data_attempts bigint, data_success bigint, voice_attempts bigint, "
        "voice_success bigint, sms_attempts bigint, sms_success bigint, rtt_ms decimal(22,6)"
    ),
    "cities.csv": "id string, name string, latitude decimal(9,6), longitude decimal(9,6), demand_share decimal(9,6)",
    "links.csv": "id string, a string, b string, nominal_capacity_gbps decimal(18,6)",
    "countries.csv": "id string, name string, partner_id string",
    "scenario_events.csv": (
        "id string, scenario_type string, domain string, title string, city_id string, link_id string, "
        "country_id string, direction string, start_ts timestamp, end_ts timestamp, severity string, synthetic boolean"
    ),
}
HISTOGRAM_COLUMNS = ["voice_setup_hist", "sms_delay_hist"]


def header_of(name: str) -> str:
    return ",".join(f.strip().split()[0] for f in LAYOUT[name].split(", "))


def read_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One archive file (or a folder of parts): each part's header checked, bad records kept in ``_corrupt``.

    Records are single lines, so the file is read as lines and each line is typed whole. The CSV
    reader types only the columns a query reads, which would let the set of corrupt records depend
    on the query.
    """
    lines = spark.read.text(f"{folder}/{name}").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    is_header = F.trim("line") == header_of(name)
    others = lines.groupBy("file").agg(F.count_if(is_header).alias("headers")).where("headers = 0").limit(1).collect()
    if others:
        raise ValueError(f"header of {name} differs from its layout: {others[0]['file']}")
    return parse_lines(lines.where(~is_header).select("line"), "line", name)


def with_histograms(rows: DataFrame) -> DataFrame:
    for name in HISTOGRAM_COLUMNS:
        if name in rows.columns:
            rows = rows.withColumn(name, parse_histogram(F.col(name)))
    return rows


def parse_lines(lines: DataFrame, text: str, name: str) -> DataFrame:
    """Rows of one layout from a column of CSV lines; the same typing as ``read_file``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("r", F.from_csv(text, F.lit(LAYOUT[name] + ", _corrupt string"), options))
    return with_histograms(parsed.select("r.*"))


def parse_histogram(text: Column) -> Column:
    """Nine counts of ``{a,b,…}``; null when the text is not such a list."""
    body = F.regexp_extract(text, r"^\{([0-9]+(?:,[0-9]+){8})\}$", 1)
    return F.when(body != "", F.transform(F.split(body, ","), lambda x: x.cast("bigint")))


def natural_id(dataset: str, kind: str, scope: Column, direction: Column, country: Column, partner: Column, ts: Column):
    return identity(dataset, kind, scope, direction, country, partner, F.unix_seconds(ts), F.lit(300))


def duplicate_identities(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def completeness(rows: DataFrame, scopes: DataFrame, slots: int) -> DataFrame:
    """Received against expected slots of every inventory scope, including scopes without any row."""
    seen = rows.groupBy("scope_id").agg(
        F.count("*").alias("row_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    count = F.coalesce("row_count", F.lit(0))
    return scopes.select("scope_id").join(seen, "scope_id", "left").select(
        "scope_id",
        count.alias("row_count"),
        F.lit(slots).cast("bigint").alias("expected_slots"),
        (F.lit(slots) - count).alias("missing_slots"),
        "first_ts",
        "last_ts",
        (count == slots).alias("complete"),
    )


def manifest_check(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose row count differs from the manifest, or that only one side names."""
    return counts.join(manifest, "file", "full").withColumn(
        "matches", F.col("row_count").eqNullSafe(F.col("manifest_rows"))
    )


def metric_windows(city: DataFrame, link: DataFrame, roaming: DataFrame) -> DataFrame:
    """The archive as long metric windows of the three domains."""
    def shape(df: DataFrame, domain: str, metric: str, scope: str, direction: str, n: str, d: str) -> DataFrame:
        return df.selectExpr(
            f"'{domain}' AS domain", f"'{metric}' AS metric_id", f"{scope} AS scope_id", f"{direction} AS direction",
            "ts AS bucket_start", f"CAST({n} AS DECIMAL(22,6)) AS numerator", f"CAST({d} AS DECIMAL(22,6)) AS denominator",
        )

    return (
        shape(city, "VOLTE", "volte.setup.success", "city_id", "''", "voice_success", "voice_attempts")
        .unionByName(shape(link, "TRANSPORT", "transport.link.utilization", "link_id", "'a-to-b'", "traffic_gbps",
                           "effective_capacity_gbps"))
        .unionByName(shape(roaming, "ROAMING", "roaming.registration.success", "partner_id", "direction", "reg_success",
                           "reg_attempts"))
    )
