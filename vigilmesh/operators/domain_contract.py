"""The whole contract of a five-minute domain window, as one column: the reason of the first rule that a window breaks.

A window has the columns of REQUIRED and of SCOPE_FIELDS, ``event_id``, ``quality``, ``coverage`` and what was measured: ``primitives``, a map from field to
number; ``snapshot_at`` and ``at``, instants that are fields too where the dictionary names them; ``histogram``, a struct of schema_version,
unit, representation, edges and counts; and ``transport``, a struct of valid_from and valid_to. Rules whose inputs are
null do not hold unless they say so; fields that a rule needs are required first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.dictionary import dictionary_df
from vigilmesh.functions.fingerprint import identity
from vigilmesh.operators.validation import first_reason

# The dimensions of a window's identity, in their order.
IDENTITY = [
    "dataset_id", "source_id", "scope_namespace", "domain", "scope_type", "scope_id", "direction_id", "direction", "partner_id", "country_id", "procedure",
    "access_technology", "metric_id", "window_start", "source_resolution_seconds", "schema_version", "catalogue_version", "topology_version", "policy_version",
]
REQUIRED = [
    "event_id", "dataset_id", "source_id", "scope_namespace", "domain", "scope_type", "scope_id", "metric_id", "window_start", "window_end", "emitted_at",
    "source_resolution_seconds", "schema_version", "catalogue_version", "topology_version", "policy_version", "unit", "aggregation_type", "quality", "coverage",
]
#: Dimensions that only some domains have.
SCOPE_FIELDS = ["contract_city_id", "link_id", "direction_id", "country_id", "partner_id", "direction", "procedure", "access_technology"]
# Which of them a domain may carry.
ALLOWED = {
    "TRANSPORT": ["link_id", "direction_id"],
    "ROAMING": ["partner_id", "country_id", "direction", "procedure"],
    "MOBILE_DATA": ["contract_city_id", "procedure", "access_technology"],
    "VOLTE": ["contract_city_id"],
    "SMS": ["contract_city_id"],
}
SCOPE_TYPES = {"TRANSPORT": "LINK_DIRECTION", "ROAMING": "ROAMING_PROCEDURE"}
# The procedure that a metric is measured on.
PROCEDURES = {
    "roaming.registration.success": "REGISTRATION", "roaming.data.success": "DATA", "roaming.voice.success": "VOICE", "roaming.sms.finalizedSuccess": "SMS",
    "roaming.partnerRtt": "RTT", "mobileData.activation.success": "EPS_BEARER_ACTIVATION", "mobileData.dns.success": "DNS",
}
OTHER_PROCEDURE = {"ROAMING": "ACTIVE_USERS", "MOBILE_DATA": "USER_THROUGHPUT"}
# Qualities a window may have.
QUALITIES = ["VALID", "PARTIAL", "INSUFFICIENT_EVIDENCE", "STALE", "MISSING"]
HISTOGRAM = {"schema_version": "fixed-edges-v1", "unit": "SECONDS", "representation": "COUNTS"}
INSTANTS = {"snapshotAt": "snapshot_at", "at": "at"}


def window_identity() -> Column:
    """Hash of the identity's dimensions; an absent one is a dash. A revision is no part of it."""
    parts = []
    for name in IDENTITY:
        if name == "window_start":
            parts.append(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        else:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("-")))
    return identity(*parts)


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _scope_rules() -> list[tuple[Column, str]]:
    c = F.col
    domain, metric = c("domain"), c("metric_id")
    transport, roaming = domain == "TRANSPORT", domain == "ROAMING"
    mobile, city = domain == "MOBILE_DATA", ~domain.isin("TRANSPORT", "ROAMING")
    procedure = F.coalesce(F.try_element_at(_lookup(PROCEDURES), metric), F.try_element_at(_lookup(OTHER_PROCEDURE), domain))
    scope_type = F.coalesce(F.try_element_at(_lookup(SCOPE_TYPES), domain), F.lit("CITY_SERVICE"))
    any_missing = c("partner_id").isNull() | c("country_id").isNull() | c("direction").isNull() | c("procedure").isNull()
    irrelevant = []
    for field in SCOPE_FIELDS:
        owners = [d for d, fields in ALLOWED.items() if field in fields]
        irrelevant.append((c(field).isNotNull() & ~domain.isin(*owners), f"IRRELEVANT_FIELD:{field}"))
    irrelevant.append((c("transport").isNotNull() & ~transport, "IRRELEVANT_FIELD:transport"))
    return [
        (c("scope_type") != scope_type, "SCOPE_TYPE"),
        (transport & (c("link_id").isNull() | (c("scope_id") != c("link_id"))), "TRANSPORT_SCOPE"),
        (transport & c("direction_id").isNull(), "TRANSPORT_DIRECTION"),
        (transport & ((c("transport")["valid_from"] > c("window_start")) | (c("transport")["valid_to"] < c("window_end"))), "CAPACITY_INTERVAL"),
        (roaming & any_missing, "ROAMING_DIMENSION"),
        (roaming & (c("scope_id") != c("partner_id")), "ROAMING_SCOPE"),
        (roaming & (c("partner_id") != F.concat(c("country_id"), F.lit("-DEMO-01"))), "ROAMING_PARTNER"),
        ((roaming | mobile) & (c("procedure").isNull() | (c("procedure") != procedure)), "PROCEDURE"),
        ((metric == "roaming.activeInbound") & (c("direction") != "in"), "SNAPSHOT_DIRECTION"),
        ((metric == "roaming.activeOutbound") & (c("direction") != "out"), "SNAPSHOT_DIRECTION"),
        (city & c("contract_city_id").isNull(), "CITY_BINDING"),
        (mobile & (c("access_technology").isNull() | (c("access_technology") != "LTE")), "ACCESS_TECHNOLOGY"),
        *irrelevant,
    ]


def _evidence_rules() -> list[tuple[Column, str]]:
    c, p = F.col, lambda name: F.try_element_at(F.col("primitives"), F.lit(name))
    quality, coverage = c("quality"), c("coverage")
    missing, unavailable = quality == "MISSING", quality == "INSUFFICIENT_EVIDENCE"
    seen = ~missing
    values = F.map_values("primitives")
    numbers = F.exists(values, lambda v: v.isNotNull())
    instants = c("snapshot_at").isNotNull() | c("at").isNotNull()
    evidence = F.coalesce(numbers, F.lit(False)) | instants | c("histogram").isNotNull() | c("transport").isNotNull()
    expects = lambda name: F.array_contains("d_fields", F.lit(name))
    a_null = F.exists(values, lambda v: v.isNull())
    for field, column in INSTANTS.items():
        a_null = a_null | (expects(field) & c(column).isNull())
    a_null = a_null | (expects("histogram") & c("histogram").isNull())
    edges = F.when(c("metric_id").startswith("sms"), F.array(*map(F.lit, policies.SMS_EDGES))).otherwise(F.array(*map(F.lit, policies.VOICE_EDGES)))
    h = c("histogram")
    weighted = c("aggregation_type").isin("WEIGHTED_MEAN", "TIME_WEIGHTED_MEAN")
    outside = F.lit(False)
    for column in INSTANTS.values():
        early = (quality != "STALE") & (c(column) < c("window_start"))
        outside = outside | F.coalesce(early | (c(column) >= c("window_end")), F.lit(False))
    total = F.aggregate(h["counts"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    return [
        (missing & (coverage != 0), "MISSING_COVERAGE"),
        (missing & evidence, "MISSING_WITH_EVIDENCE"),
        (seen & (coverage <= 0), "NO_COVERAGE"),
        ((quality == "VALID") & (coverage != 1), "VALID_NEEDS_FULL_COVERAGE"),
        ((quality == "PARTIAL") & (coverage >= 1), "PARTIAL_NEEDS_PARTIAL_COVERAGE"),
        (seen & ~unavailable & a_null, "NULL_PRIMITIVE"),
        (seen & ~unavailable & (c("domain") == "TRANSPORT") & c("transport").isNull(), "ABSENT_CAPACITY"),
        (seen & F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "NOT_FINITE"),
        (seen & F.exists(values, lambda v: v < 0), "NEGATIVE"),
        (seen & (p("numerator") > p("denominator")), "SUCCESS_EXCEEDS_ATTEMPTS"),
        (seen & ~unavailable & (p("denominator") == 0), "ZERO_DENOMINATOR"),
        (seen & ~unavailable & weighted & F.coalesce((p("count") <= 0), F.lit(False)), "ZERO_WEIGHT"),
        (seen & ~unavailable & weighted & F.coalesce((p("validSeconds") <= 0), F.lit(False)), "ZERO_WEIGHT"),
        (seen & (p("validSeconds") > c("source_resolution_seconds")), "WEIGHT_EXCEEDS_DURATION"),
        (seen & outside, "SAMPLE_OUTSIDE_WINDOW"),
        ((quality == "STALE") & (c("aggregation_type") != "SNAPSHOT_LAST"), "STALE_NEEDS_SNAPSHOT"),
        *[(seen & h.isNotNull() & ~h[k].eqNullSafe(F.lit(v)), "HISTOGRAM_SCHEMA") for k, v in HISTOGRAM.items()],
        (seen & h.isNotNull() & ~h["edges"].eqNullSafe(edges), "HISTOGRAM_EDGES"),
        (seen & h.isNotNull() & ~F.coalesce(F.size(h["counts"]) == F.size(edges), F.lit(False)), "HISTOGRAM_COUNTS"),
        (seen & h.isNotNull() & F.exists(h["counts"], lambda x: F.coalesce(x < 0, F.lit(True))), "HISTOGRAM_COUNTS"),
        (seen & ~unavailable & h.isNotNull() & (total == 0), "EMPTY_HISTOGRAM"),
    ]


def judged(windows: DataFrame, now: Column) -> DataFrame:
    """The windows with ``reason``, null if all rules hold. ``now``: no window may be emitted after it.

    The dictionary has 41 rows and is broadcast; everything else is one projection. Rows may repeat; an empty table stays empty.
    """
    c = F.col
    known = dictionary_df(windows.sparkSession).select(
        c("metric_id").alias("d_metric"), c("domain").alias("d_domain"), c("unit").alias("d_unit"), c("policy_version").alias("d_policy"),
        c("aggregation_type").alias("d_aggregation"), c("primitive_fields").alias("d_fields"))
    seconds = c("source_resolution_seconds")
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    # Instants and histograms are fields of their own here; the map holds the numbers.
    numeric = F.array_sort(F.filter("d_fields", lambda f: ~f.isin("histogram", "state", *INSTANTS)))
    dimension = F.lit(False)
    for name in IDENTITY:
        if name != "window_start":
            dimension = dimension | F.coalesce(F.contains(c(name).cast("string"), F.lit("|")), F.lit(False))
    absent = F.lit(False)
    for name in REQUIRED:
        absent = absent | c(name).isNull()
    reason = first_reason([
        (absent | c("primitives").isNull(), "SCHEMA"),
        (~c("quality").isin(*QUALITIES) | (c("coverage") < 0) | (c("coverage") > 1) | F.isnan("coverage") | (seconds <= 0), "SCHEMA"),
        ((F.pmod(start, seconds * 1_000_000) != 0) | (end - start != seconds * 1_000_000), "UNALIGNED_INTERVAL"),
        ((c("emitted_at") < c("window_end")) | (c("emitted_at") > now), "EVENT_TIME"),
        (dimension, "IDENTITY_DELIMITER"),
        (c("event_id") != window_identity(), "IDENTITY"),
        (c("d_metric").isNull(), "UNKNOWN_METRIC"),
        (c("domain") != c("d_domain"), "DICTIONARY:domain"),
        (c("unit") != c("d_unit"), "DICTIONARY:unit"),
        (c("policy_version") != c("d_policy"), "DICTIONARY:policy_version"),
        (c("aggregation_type") != c("d_aggregation"), "AGGREGATION"),
        (F.array_sort(F.map_keys("primitives")) != numeric, "PRIMITIVE_FIELDS"),
        *_scope_rules(),
        *_evidence_rules(),
    ])
    joined = windows.join(F.broadcast(known), c("metric_id") == c("d_metric"), "left")
    return joined.select(*windows.columns, reason.alias("reason"))


def partition_key() -> Column:
    """Where a window's state lives: its dataset, namespace and what the domain keys its episodes by."""
    c = F.col
    state = (
        F.when(c("scope_type") == "LINK_DIRECTION", F.concat_ws("|", "link_id", "direction_id"))
        .when(c("scope_type") == "ROAMING_PROCEDURE", F.concat_ws("|", "partner_id", "direction", "procedure"))
        .otherwise(F.concat_ws("|", "domain", "scope_id"))
    )
    return F.concat_ws("|", "dataset_id", "scope_namespace", state)
