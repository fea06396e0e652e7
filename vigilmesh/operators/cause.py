"""Cause attribution: eligible, supported, uncontradicted and unambiguous dependency evidence.

All joins are equi joins on symptom or relation keys; a candidate never meets another candidate of
its symptom before both have been reduced to verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.timebins import seconds_between
from vigilmesh.operators.validation import first_reason

EVIDENCE = [
    "evidence_id", "e_dataset", "e_scope", "e_direction", "e_topology", "e_from", "e_to", "q_state", "f_state", "coverage",
    "as_of", "observed_at", "metric_id", "total", "population", "is_ratio", "e_baseline", "e_baseline_version",
    "evidence_valid",
]


def support_policy(spark) -> DataFrame:
    """The eight support thresholds."""
    return spark.createDataFrame(
        [(m, c, float(v), n) for m, c, v, n in policies.CAUSE_SUPPORT],
        "metric_id string, comparison string, threshold double, min_samples bigint",
    )


def crosses(total: Column, population: Column, is_ratio: Column, baseline: Column, comparison: Column, threshold: Column):
    """Support test on primitives: total against threshold × population, exactly."""
    t = total.cast("decimal(20,4)") * F.when(is_ratio, 100).otherwise(1)
    n, limit = population.cast("decimal(18,0)"), threshold.cast("decimal(9,2)")
    drop = baseline.cast("decimal(9,4)") * n - t
    return (
        F.when(comparison == "GT", t > n * limit)
        .when(comparison == "LT", t < n * limit)
        .when(comparison == "DROP_PP_GT", drop > n * limit)
    )


def relation_counts(items: DataFrame, relations: DataFrame) -> DataFrame:
    """Items with: relations of their scope, target and path; of their source too; valid over the overlap.

    A (scope, target, path) has a few configured ranges; they travel as one array, so an item meets
    its topology in a single equi join and is never multiplied or grouped.
    """
    ranges = relations.groupBy(
        F.col("scope_id").alias("r_scope"), F.col("target_scope").alias("r_target"), F.col("path_id").alias("r_path")
    ).agg(F.collect_list(F.struct("relation_id", "source_id", "topology", "valid_from", "valid_to")).alias("known"))
    joined = items.join(
        ranges,
        (F.col("scope_id") == F.col("r_scope")) & (F.col("e_scope") == F.col("r_target")) & (F.col("path_id") == F.col("r_path")),
        "left",
    )
    lo, hi = F.greatest("e_from", "from_ts"), F.least("e_to", "to_ts")
    own = F.filter("known", lambda r: r["source_id"] == F.col("source_id"))
    valid = F.filter(
        own, lambda r: (r["topology"] == F.col("topology")) & (r["valid_from"] <= lo) & (r["valid_to"] >= hi))

    def size(x) -> Column:
        return F.coalesce(F.size(x), F.lit(0)).cast("bigint")

    return joined.select(
        "*", size("known").alias("scope_matches"), size(own).alias("source_matches"),
        size(F.filter(own, lambda r: r["topology"] != F.col("topology"))).alias("other_topology"),
        size(valid).alias("valid_matches"),
        F.array_min(F.transform(valid, lambda r: r["relation_id"])).alias("selected_relation"),
    ).drop("known", "r_scope", "r_target", "r_path")


def eligibility(items: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates or controls with ``reason`` (null when eligible) and ``impaired``.

    ``items`` carries its symptom's dataset, scope_id, topology, baseline_version, from_ts, to_ts and
    evaluated_at besides the evidence columns.
    """
    counted = relation_counts(items, relations)
    judged = counted.join(F.broadcast(support_policy(items.sparkSession)), "metric_id", "left")
    c = F.col
    age = seconds_between(c("observed_at"), c("evaluated_at"))
    reason = first_reason([
        (~c("evidence_valid"), "INVALID_EVIDENCE"),
        (c("e_dataset") != c("dataset"), "WRONG_DATASET_OR_NAMESPACE"),
        (c("e_topology") != c("topology"), "TOPOLOGY_MISMATCH"),
        (F.greatest("e_from", "from_ts") >= F.least("e_to", "to_ts"), "NO_TIME_OVERLAP"),
        ((c("q_state") == "STALE") | (c("f_state") == "STALE"), "STALE_EVIDENCE"),
        ((c("q_state") != "VALID") | (c("coverage") < policies.DOMAIN_MIN_COVERAGE), "INVALID_QUALITY"),
        (c("as_of") != c("evaluated_at"), "WRONG_EVALUATION_TIME"),
        ((age < 0) | (age > policies.DOMAIN_MAX_AGE_SECONDS) | (c("f_state") != "FRESH"), "STALE_EVIDENCE"),
        (c("scope_matches") == 0, "WRONG_SCOPE_OR_PATH"),
        (c("source_matches") == 0, "SOURCE_NOT_AUTHORIZED"),
        (c("other_topology") > 0, "TOPOLOGY_MISMATCH"),
        (c("valid_matches") == 0, "NO_EVENT_TIME_DEPENDENCY"),
        (c("valid_matches") > 1, "AMBIGUOUS_DEPENDENCY"),
        (c("comparison").isNull(), "UNSUPPORTED_SUPPORT_METRIC"),
        ((c("comparison") == "DROP_PP_GT") & c("e_baseline").isNull(), "BASELINE_UNAVAILABLE"),
        ((c("comparison") == "DROP_PP_GT") & ~c("e_baseline").between(0, 100), "BASELINE_OUT_OF_RANGE"),
        ((c("comparison") == "DROP_PP_GT") & ~c("e_baseline_version").eqNullSafe(c("baseline_version")),
         "BASELINE_VERSION_MISMATCH"),
        (F.coalesce(c("population") < c("min_samples"), F.lit(True)), "INSUFFICIENT_SAMPLES"),
    ])
    impaired = crosses(c("total"), c("population"), c("is_ratio"), c("e_baseline"), c("comparison"), c("threshold"))
    return judged.withColumn("reason", reason).withColumn("impaired", impaired)


def control_effects(candidates: DataFrame, controls: DataFrame, how: str = "inner") -> DataFrame:
    """Candidates beside each of their controls (``ctl``), with what the control says.

    An impaired opposite direction contradicts, as does a healthy reading of the same scope.
    """
    k = ["symptom_id", "candidate_id"]
    beside = controls.select(
        *k, F.struct("kind", "metric_id", "e_scope", "e_direction", "reason", "impaired").alias("ctl"))
    joined = candidates.join(beside, k, how)
    ctl = F.col("ctl")
    opposite = ctl["kind"] == "OPPOSITE_DIRECTION"
    turned = F.when(opposite, ctl["e_direction"] != F.col("e_direction")).otherwise(ctl["e_direction"] == F.col("e_direction"))
    compatible = (ctl["e_scope"] == F.col("e_scope")) & (ctl["metric_id"] == F.col("metric_id")) & turned
    reason = F.when(ctl["reason"].isNotNull(), ctl["reason"]).when(~compatible, "WRONG_SCOPE_OR_PATH")
    sound = ctl.isNotNull() & reason.isNull()
    return joined.withColumns({
        "control_reason": reason,
        "opposite_seen": sound & opposite,
        "contradicts": sound & F.when(opposite, ctl["impaired"]).otherwise(~ctl["impaired"]),
    })


def candidate_verdicts(candidates: DataFrame, controls: DataFrame) -> DataFrame:
    """Final reason of each candidate after support threshold and controls; null means supported.

    One join and one grouping per candidate; a candidate has a handful of configured controls.
    """
    k = ["symptom_id", "candidate_id"]
    rest = [c for c in candidates.columns if c not in k]
    grouped = control_effects(candidates, controls, "left").groupBy(*k).agg(
        F.any_value(F.struct(*rest)).alias("r"),
        F.bool_or("opposite_seen").alias("opposite_seen"),
        F.bool_or("contradicts").alias("contradicted"),
        F.collect_set("control_reason").alias("control_reasons"),
    ).select(*k, "r.*", "opposite_seen", "contradicted", "control_reasons")
    needs_opposite = (F.col("domain") == "ROAMING") | F.col("metric_id").startswith("roaming.")
    final = (
        F.when(F.col("hypothesis") != F.concat("domain", F.lit("_DEPENDENCY_HYPOTHESIS")), "UNSUPPORTED_HYPOTHESIS")
        .when(F.col("conflicting"), "CONFLICTING_DUPLICATE")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~F.col("impaired"), "BELOW_SUPPORT_THRESHOLD")
        .when(F.col("contradicted"), "CONTRADICTORY_CONTROL")
        .when(needs_opposite & ~F.col("opposite_seen"), "MISSING_REQUIRED_CONTROL")
    )
    return grouped.withColumn("final_reason", final)


def mark_conflicts(offers: DataFrame, key: list[str], content: Column) -> DataFrame:
    """One row per key: the offer with the smallest evidence id, ``conflicting`` when contents differ."""
    rest = [c for c in offers.columns if c not in key]
    grouped = offers.withColumn("_content", content).groupBy(*key).agg(
        F.min_by(F.struct(*rest), "evidence_id").alias("r"), (F.min("_content") != F.max("_content")).alias("conflicting"))
    return grouped.select(*key, "r.*", "conflicting")


def outcomes(symptoms: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One result per symptom: exactly one distinct supported hypothesis is a cause, several are ambiguous."""
    physical = F.concat_ws("|", "evidence_id", "source_id", "path_id", "hypothesis")
    supported = F.col("final_reason").isNull()
    per = verdicts.groupBy("symptom_id").agg(
        F.collect_set(F.when(supported, physical)).alias("supported"),
        F.collect_set("final_reason").alias("own_reasons"),
        F.flatten(F.collect_list("control_reasons")).alias("more_reasons"),
        F.min(F.when(supported, F.col("evidence_id"))).alias("supporting_evidence"),
        F.min(F.when(supported, F.col("selected_relation"))).alias("relation_id"),
    ).withColumn("reasons", F.array_union("own_reasons", "more_reasons"))
    joined = symptoms.join(per, "symptom_id", "left")
    n = F.coalesce(F.size("supported"), F.lit(0))
    breach = F.col("verdict") == "BREACH"
    empty = F.array().cast("array<string>")
    found = F.coalesce("reasons", empty)
    reasons = (
        F.when(~breach, F.array(F.lit("NO_SYMPTOM")))
        .when(n > 1, F.array_union(found, F.array(F.lit("AMBIGUOUS_CANDIDATES"))))
        .when((n == 0) & (F.size(found) == 0), F.array(F.lit("NO_DEPENDENCY")))
        .otherwise(found)
    )
    single = breach & (n == 1)
    return joined.select(
        *symptoms.columns,
        F.when(single, "SUPPORTED_HYPOTHESIS").otherwise("UNDETERMINED").alias("status"),
        F.when(single, "MEDIUM").alias("cause_confidence"),
        F.when(single, F.col("supporting_evidence")).alias("supporting_evidence"),
        F.when(single, F.col("relation_id")).alias("relation_id"),
        F.array_sort(reasons).alias("reason_codes"),
    )


def presentation(unknown_phase: Column, metric_usable: Column, cause: Column, confidence: Column, codes: Column) -> dict[str, Column]:
    """What may be shown: nothing when the evidence is unusable or only of non-causal kinds."""
    causal = F.exists(codes, lambda x: ~x.isin(*policies.NON_CAUSAL_CODES))
    usable = F.coalesce(
        ~unknown_phase & metric_usable & (F.trim(cause) != "") & ~F.contains(F.lower(cause), F.lit("undetermined"))
        & (F.size(codes) > 0) & causal, F.lit(False))
    return {
        "cause_status": F.when(usable, "HYPOTHESIS").otherwise("UNDETERMINED"),
        "probable_cause": F.when(usable, F.trim(cause)),
        "confidence": F.when(usable, confidence),
    }
