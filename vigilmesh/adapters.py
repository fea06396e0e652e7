"""Domain tables derived from the generic tables of a folder.

Every adapter is declarative, so filters and column pruning of a query reach the Parquet scan.
``oracle_views.py`` states the same derivations as SQL text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilmesh.session import prepare

# The five-minute archive covers 30 days from this instant.
ARCHIVE_START = "2026-09-10 09:00:00"
ARCHIVE_END = "2026-10-10 09:00:00"
ARCHIVE_START_EPOCH = 1_789_030_800
ARCHIVE_SLOTS = 8640
PRICE_EDGES = [8000, 16000, 24000, 32000, 40000, 52000, 64000, 80000]


def slot_ts(slot: str) -> str:
    return f"timestamp_seconds({ARCHIVE_START_EPOCH} + ({slot}) * 300)"


class Tables:
    """Lazy access to the source tables of one folder and to the domain tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- one-minute observations -------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def obs(self) -> DataFrame:
        """One observation per event: scope, source, minute window, quality and receipt time."""
        end = "timestampadd(SECOND, 60, date_trunc('minute', ts))"
        return self.events.selectExpr(
            "event_id",
            "concat('S', user_id % 10) AS scope_id",
            "concat('src', user_id % 3) AS source_id",
            "CASE event_type WHEN 'view' THEN 'NODE' WHEN 'signup' THEN 'HEARTBEAT' ELSE 'SERVICE' END AS kind",
            "CASE WHEN event_type IN ('view', 'signup') THEN NULL "
            "WHEN user_id % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END AS service",
            "CASE WHEN event_type = 'view' THEN concat('N', user_id % 3) END AS node_id",
            "date_trunc('minute', ts) AS window_start",
            f"{end} AS window_end",
            f"timestampadd(SECOND, event_id % 5, {end}) AS emitted_at",
            f"timestampadd(SECOND, event_id % 20, {end}) AS received_at",
            "CASE WHEN event_id % 13 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS quality",
            "CAST(round(value * 100) AS BIGINT) AS amount",
        )

    @cached_property
    def obs_metrics(self) -> DataFrame:
        return self.with_metrics(self.obs)

    @staticmethod
    def with_metrics(observations: DataFrame) -> DataFrame:
        """Observations with the counters of their kind; columns of other kinds are null."""
        a, voice, sms, node = "amount", "service = 'VOLTE'", "service = 'SMS'", "kind = 'NODE'"

        def only(condition: str, value: str, name: str) -> str:
            return f"CASE WHEN {condition} THEN {value} END AS {name}"

        return observations.selectExpr(
            "*",
            only(voice, f"100 + {a} % 900", "attempts"),
            only(voice, f"({a} % 11) * (1 + {a} % 4)", "technical_failures"),
            only(voice, f"{a} % 7", "user_outcomes"),
            only(voice, f"100 + {a} % 900 - ({a} % 11) * (1 + {a} % 4) - {a} % 7", "technical_successes"),
            only(voice, f"(({a} % 11) * (1 + {a} % 4)) DIV 2", "sip503_count"),
            only(voice, f"105 + {a} % 900", "rrc_attempts"),
            only(voice, f"105 + {a} % 900 - {a} % 4", "rrc_successes"),
            only(voice, f"103 + {a} % 900", "bearer_attempts"),
            only(voice, f"103 + {a} % 900 - {a} % 3", "bearer_successes"),
            only(sms, f"60 + {a} % 300", "delivery_attempts"),
            only(sms, f"60 + {a} % 300 - {a} % 13", "delivery_successes"),
            only(sms, f"1 + {a} % 47", "delivered_messages"),
            only(sms, f"transform(sequence(1L, 1 + {a} % 47), i -> ({a} * i * 31) % 60000)", "delivery_delay_ms"),
            only(node, f"CAST({a} % 101 AS DOUBLE)", "cpu_pct"),
            only(node, f"({a} % 50) / 1000D", "packet_loss_ratio"),
            only(node, f"{a} % 1500", "queue_depth"),
            only(node, f"CASE WHEN {a} % 1500 = 0 THEN 0 ELSE {a} % 400 END", "oldest_pending_seconds"),
        )

    @cached_property
    def obs_dup(self) -> DataFrame:
        """Deliveries: originals, exact copies and altered copies, of one scan. ``arrival`` is the topic offset."""
        copies = "array_compact(array(0, CASE WHEN event_id % 17 = 0 THEN 1 END, CASE WHEN event_id % 23 = 0 THEN 2 END))"
        return (
            self.obs.selectExpr("*", f"explode({copies}) AS delivery")
            .withColumn("amount", F.expr("CASE WHEN delivery = 2 THEN amount + 1 ELSE amount END"))
            .withColumn("arrival", F.expr("event_id * 4 + delivery"))
            .withColumn(
                "content_hash",
                F.expr(
                    "sha2(concat_ws('|', event_id, scope_id, source_id, kind, unix_seconds(window_start), quality, "
                    "amount), 256)"
                ),
            )
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        """Approved (scope, role, source) triples: a fixed list of at most 60 rows."""
        rows = self.spark.range(60).selectExpr(
            "concat('S', id % 10) AS scope_id", "CAST(id DIV 10 AS INT) AS k"
        )
        return rows.selectExpr(
            "scope_id",
            "CASE WHEN k < 3 THEN 'SERVICE' ELSE 'NODE' END AS role",
            "CASE WHEN k < 3 THEN NULL ELSE concat('N', k - 3) END AS node_id",
            "concat('src', k % 3) AS source_id",
            "CASE WHEN CAST(substring(scope_id, 2) AS INT) % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END AS service",
        ).where("NOT (role = 'NODE' AND scope_id = 'S7' AND node_id = 'N2')")

    @cached_property
    def kpi_hour(self) -> DataFrame:
        """Per scope and hour: event volume, successes, extremes. At most one row per scope-hour."""
        return self.events.groupBy(
            F.expr("concat('S', user_id % 10)").alias("scope_id"), F.date_trunc("hour", "ts").alias("window_start")
        ).agg(
            F.count("*").alias("attempts"),
            F.expr("count_if(event_type <> 'error')").alias("success"),
            F.expr("count_if(event_type = 'view')").alias("views"),
            F.expr("sum(CAST(round(value * 100) AS BIGINT))").alias("amount"),
            F.expr("max(CAST(round(value * 100) AS BIGINT))").alias("peak"),
            F.max("event_id").alias("last_event_id"),
        ).withColumn("window_end", F.expr("timestampadd(SECOND, 3600, window_start)"))

    # -- five-minute archive -----------------------------------------------------------------

    @cached_property
    def city5m(self) -> DataFrame:
        """City primitives per five-minute slot, with nine-bin voice and SMS histograms."""
        price = "l_extendedprice"
        branches = " ".join(f"WHEN {price} < {edge} THEN {i}" for i, edge in enumerate(PRICE_EDGES))
        lines = self.raw("lineitem").selectExpr(
            "concat('C', l_suppkey % 10) AS city_id",
            f"(l_orderkey * 7 + l_linenumber) % {ARCHIVE_SLOTS} AS slot",
            "CAST(l_quantity AS BIGINT) AS q",
            "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) * "
            "CAST(round(l_discount * 100) AS BIGINT) DIV 100 ELSE 0 END AS fail",
            "CAST(l_quantity AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) DIV 100 AS drop",
            "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents",
            f"CASE {branches} ELSE {len(PRICE_EDGES)} END AS bin",
            "l_partkey AS p",
            "CAST(l_linenumber AS BIGINT) AS n",
        )
        voice_bins = [F.expr(f"sum(CASE WHEN bin = {i} THEN q - fail ELSE 0 END)") for i in range(9)]
        sms_bins = [F.expr(f"sum(CASE WHEN (p + bin) % 9 = {i} THEN q - q DIV 20 ELSE 0 END)") for i in range(9)]
        return (
            lines.groupBy("city_id", "slot")
            .agg(
                F.expr("sum(q)").alias("voice_attempts"),
                F.expr("sum(q - fail)").alias("voice_success"),
                F.expr("sum(least(drop, q - fail))").alias("voice_drops"),
                F.expr("sum(cents)").alias("holding_ms"),
                F.expr("sum(q * (p % 50))").alias("setup_ms"),
                F.array(*voice_bins).alias("voice_setup_hist"),
                F.expr("sum(q + n)").alias("sms_submitted"),
                F.expr("sum(q - q DIV 20)").alias("sms_delivered"),
                F.expr("sum(q DIV 20)").alias("sms_expired"),
                F.expr("sum(p % 200)").alias("sms_queue"),
                F.expr("max(p % 700)").alias("sms_oldest_seconds"),
                F.array(*sms_bins).alias("sms_delay_hist"),
                F.expr("sum(2 * q)").alias("data_attempts"),
                F.expr("sum(2 * q - fail)").alias("data_success"),
                F.expr("sum(3 * q)").alias("dns_attempts"),
                F.expr("sum(3 * q - drop)").alias("dns_success"),
                F.expr("sum(p % 97)").alias("user_throughput_mbps"),
                F.expr("sum(n)").alias("ho_attempts"),
                F.expr("sum(n - CASE WHEN fail > 0 THEN 1 ELSE 0 END)").alias("ho_success"),
            )
            .withColumn("ts", F.expr(slot_ts("slot")))
            .withColumn("voice_holding_seconds", F.expr("CAST(holding_ms AS DECIMAL(20,0)) * CAST(0.001 AS DECIMAL(4,3))"))
            .withColumn("voice_setup_elapsed_seconds", F.expr("CAST(setup_ms AS DECIMAL(20,0)) * CAST(0.001 AS DECIMAL(4,3))"))
        )

    @cached_property
    def link5m(self) -> DataFrame:
        """Link primitives: the row of the newest order per (link, slot)."""
        rows = self.raw("orders").selectExpr(
            "concat('L', o_custkey % 12) AS link_id",
            f"(o_orderkey * 7) % {ARCHIVE_SLOTS} AS slot",
            "o_orderkey AS k",
            "o_custkey AS c",
            "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
        )
        newest = rows.groupBy("link_id", "slot").agg(F.expr("max_by(struct(k, c, cents), k)").alias("r"))
        return newest.selectExpr(
            "link_id",
            "slot",
            f"{slot_ts('slot')} AS ts",
            "20 + 10 * (r.c % 3) AS capacity",
            "least(r.cents DIV 3, (20 + 10 * (r.c % 3)) * 1000000) AS traffic_micro",
            "r.k % 5 AS loss_bp",
            "10 + r.c % 140 AS rtt_ms",
            "r.k % 17 AS jitter_ms",
            "r.k % 7 AS interface_errors",
            "r.c % 11 AS queue_drops",
        ).selectExpr(
            "*",
            "CAST(traffic_micro AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS traffic_gbps",
            "CAST(capacity AS DECIMAL(18,0)) AS effective_capacity_gbps",
            "CAST(loss_bp AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS loss_pct",
        )

    @cached_property
    def roam5m(self) -> DataFrame:
        """Roaming primitives per partner, direction and slot."""
        orders = self.raw("orders").selectExpr(
            "o_custkey",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END AS direction",
            f"(o_orderkey * 7) % {ARCHIVE_SLOTS} AS slot",
            "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
        )
        customers = self.raw("customer").select("c_custkey", "c_nationkey")
        return (
            orders.join(customers, orders.o_custkey == customers.c_custkey)
            .groupBy("c_nationkey", "direction", "slot")
            .agg(
                F.expr("sum(cents % 1000)").alias("reg_attempts"),
                F.expr("sum(cents % 1000 - (cents % 1000) DIV 40)").alias("reg_success"),
                F.expr("sum(cents % 700)").alias("data_attempts"),
                F.expr("sum(cents % 700 - (cents % 700) DIV 30)").alias("data_success"),
                F.expr("sum(cents % 300)").alias("voice_attempts"),
                F.expr("sum(cents % 300 - (cents % 300) DIV 25)").alias("voice_success"),
                F.expr("sum(cents % 200)").alias("sms_attempts"),
                F.expr("sum(cents % 200 - (cents % 200) DIV 50)").alias("sms_success"),
                F.expr("sum(cents % 90)").alias("active_users"),
                F.expr("max(20 + cents % 150)").alias("rtt_ms"),
            )
            .withColumn("country_id", F.expr("concat('N', c_nationkey)"))
            .withColumn("partner_id", F.expr("concat('N', c_nationkey, '-DEMO-01')"))
            .withColumn("ts", F.expr(slot_ts("slot")))
            .drop("c_nationkey")
        )

    # -- metric windows, revisions -------------------------------------------------------------

    @cached_property
    def revisions(self) -> DataFrame:
        """Voice set-up windows with a corrected second revision for every eleventh slot."""
        base = self.city5m.selectExpr(
            "city_id AS scope_id",
            "slot",
            "ts AS bucket_start",
            "voice_success AS numerator",
            "voice_attempts AS denominator",
            "CASE WHEN slot % 29 = 0 THEN 'STALE' WHEN slot % 13 = 0 THEN 'PARTIAL' ELSE 'VALID' END AS quality",
            "CASE WHEN slot % 13 = 0 THEN 500000 ELSE 1000000 END AS coverage_ppm",
            "slot % 37 = 0 AS source_unknown",
        )
        second = base.where("slot % 11 = 0").selectExpr(
            "scope_id", "slot", "bucket_start", "greatest(numerator - 1, 0) AS numerator", "denominator",
            "'VALID' AS quality", "1000000 AS coverage_ppm", "source_unknown",
        )
        return base.withColumn("revision", F.lit(0)).unionByName(second.withColumn("revision", F.lit(1)))

    # -- scoped facts and their scope inventories ------------------------------------------------

    @cached_property
    def city_facts(self) -> DataFrame:
        return self.city5m.withColumn("scope_id", F.col("city_id"))

    @cached_property
    def link_facts(self) -> DataFrame:
        return self.link5m.withColumn("scope_id", F.concat("link_id", F.lit(":a-to-b")))

    @cached_property
    def roam_facts(self) -> DataFrame:
        return self.roam5m.withColumn("scope_id", F.concat_ws(":", "partner_id", "direction"))

    @cached_property
    def cities(self) -> DataFrame:
        return self.spark.range(10).selectExpr("concat('C', id) AS scope_id")

    @cached_property
    def links(self) -> DataFrame:
        return self.spark.range(12).selectExpr("concat('L', id, ':a-to-b') AS scope_id")

    @cached_property
    def partners(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "explode(array('in', 'out')) AS direction", "concat('N', n_nationkey, '-DEMO-01') AS partner_id",
            "concat('N', n_nationkey) AS country_id",
        ).withColumn("scope_id", F.concat_ws(":", "partner_id", "direction"))

    @cached_property
    def scopes10(self) -> DataFrame:
        return self.spark.range(10).selectExpr("concat('S', id) AS scope_id")

    # -- dimensions ----------------------------------------------------------------------------

    @cached_property
    def nodes(self) -> DataFrame:
        """Containment country → region → district → sites. Sites are suppliers and customers; some hang below other
        sites, in chains longer than a path may be, and some pairs of suppliers contain each other."""
        regions = self.raw("region").selectExpr(
            "concat('R', r_regionkey) AS node_id", "'ROOT' AS parent_id", "'REGION' AS node_type")
        nations = self.raw("nation").selectExpr(
            "concat('N', n_nationkey) AS node_id", "concat('R', n_regionkey) AS parent_id", "'DISTRICT' AS node_type")
        suppliers = self.raw("supplier").selectExpr(
            "concat('V', s_suppkey) AS node_id",
            "CASE s_suppkey % 10 WHEN 4 THEN concat('V', s_suppkey + 1) WHEN 5 THEN concat('V', s_suppkey - 1) ELSE concat('N', s_nationkey) END AS parent_id",
            "'SITE' AS node_type")
        customers = self.raw("customer").selectExpr(
            "concat('K', c_custkey) AS node_id",
            "CASE WHEN c_custkey % 50 BETWEEN 21 AND 28 THEN concat('K', c_custkey - 1) ELSE concat('N', c_nationkey) END AS parent_id",
            "'SITE' AS node_type")
        root = self.spark.range(1).selectExpr(
            "'ROOT' AS node_id", "CAST(NULL AS STRING) AS parent_id", "'COUNTRY' AS node_type")
        return root.unionByName(regions).unionByName(nations).unionByName(suppliers).unionByName(customers)

    @cached_property
    def link_inventory(self) -> DataFrame:
        """Capacity validity per link: one version per customer, each up to the next, some with a hole or an overlap."""
        starts = self.raw("customer").selectExpr(
            "c_custkey AS k", "c_custkey % 12 AS l", "c_nationkey AS n", "c_custkey * 104729 % 2592000 AS s"
        )
        rows = starts.selectExpr("*", "coalesce(lead(s) OVER (PARTITION BY l ORDER BY s, k), 2592000) AS e").selectExpr(
            "*", "CASE WHEN k % 9 = 0 THEN greatest(s, e - 600) WHEN k % 11 = 0 THEN e + 900 ELSE e END AS until"
        )
        return rows.selectExpr(
            "concat('L', l) AS link_id",
            "'a-to-b' AS direction_id",
            f"timestamp_seconds({ARCHIVE_START_EPOCH} + s) AS valid_from",
            f"timestamp_seconds({ARCHIVE_START_EPOCH} + until) AS valid_to",
            "20 + 10 * (k % 3) AS nominal_gbps",
            "concat('C', n % 10) AS a",
            "concat('C', (n + 3) % 10) AS b",
        )

    @cached_property
    def exclusions(self) -> DataFrame:
        """Declared injection intervals: one per region row."""
        return self.raw("region").selectExpr(
            f"{slot_ts('r_regionkey * 1500 + 200')} AS from_ts",
            f"{slot_ts('r_regionkey * 1500 + 260')} AS to_ts",
            "CASE WHEN r_regionkey % 2 = 0 THEN 'DECLARED_INJECTION' ELSE 'MAINTENANCE' END AS reason",
        )

    # -- model inputs ----------------------------------------------------------------------------

    @cached_property
    def vectors(self) -> DataFrame:
        """Six-component feature rows with split, label, family and profile."""
        names = ["f0", "f1", "f2", "f3", "f4", "f5"]
        return self.raw("embeddings").selectExpr(
            "vec_id",
            "CASE WHEN vec_id % 10 <= 5 THEN 'train' WHEN vec_id % 10 = 6 THEN 'calibration' "
            "WHEN vec_id % 10 <= 8 THEN 'validation' ELSE 'test' END AS split",
            "CASE WHEN label = 0 THEN 0 ELSE 1 END AS fault",
            "concat('family', label) AS family",
            "CASE vec_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity",
            "CASE vec_id % 2 WHEN 0 THEN 'weekday' ELSE 'weekend' END AS profile",
            "concat('run', vec_id % 20) AS run_id",
            f"timestamp_seconds({ARCHIVE_START_EPOCH} + vec_id * 60) AS window_start",
            *[f"CAST(embedding[{i}] AS DOUBLE) AS {name}" for i, name in enumerate(names)],
        )

    @cached_property
    def classified(self) -> DataFrame:
        """Truth and prediction per labelled document."""
        docs = self.raw("documents").selectExpr("doc_id", "lang", "source")
        return self.raw("labels").join(docs, "doc_id").selectExpr(
            "doc_id", "toxic AS truth", "quality AS prediction", "lang AS family", "source AS profile")
