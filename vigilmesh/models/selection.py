"""Threshold search, model choice, gates, episode matching and ablations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmesh.functions.arithmetic import divide
from vigilmesh.operators.evaluation import rates
from vigilmesh.session import cut_lineage, stored


def threshold_counts(scored: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """tp/fp/tn/fn for every threshold, without repeating a row per threshold.

    A row counts once under the number of thresholds it reaches; running totals over the (few)
    thresholds give each one's confusion.
    """
    ordered = sorted(thresholds)
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in ordered), F.lit(0))
    counted = scored.groupBy(*keys, reached.alias("reached")).agg(
        F.count_if(F.col("fault") == 1).alias("faults"), F.count_if(F.col("fault") == 0).alias("healthy"))
    packed = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(t).alias("threshold")) for i, t in enumerate(ordered)])
    totals = counted.select("*", F.explode(packed).alias("t")).select(
        *keys, "reached", "faults", "healthy", "t.position", "t.threshold"
    ).groupBy(*keys, "position", "threshold").agg(
        F.sum(F.when(F.col("reached") >= F.col("position"), F.col("faults")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("reached") >= F.col("position"), F.col("healthy")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("reached") < F.col("position"), F.col("healthy")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("reached") < F.col("position"), F.col("faults")).otherwise(0)).alias("fn"),
    )
    return rates(totals.drop("position"))


def choose_within_budget(candidates: DataFrame, budget: float, names: tuple[str, ...] = ()) -> DataFrame:
    """Best candidate whose false-positive rate fits: recall, then precision, then few alarms, then threshold, then the last by name."""
    rate = divide(F.col("fp"), F.col("fp") + F.col("tn"))
    fit = candidates.withColumn("fp_rate", rate).where(F.col("fp_rate") <= budget)
    order = F.struct(
        F.col("recall"), F.coalesce("precision", F.lit(0.0)), -F.col("fp_rate"), F.col("threshold"), *names)
    columns = fit.columns
    return fit.agg(F.max_by(F.struct(*columns), order).alias("best")).where(F.col("best").isNotNull()).select("best.*")


def best_f1(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold with the best F1, then the fewest false positives, then the highest."""
    order = F.struct(F.coalesce("f1", F.lit(-1.0)), -F.col("fp"), F.col("threshold"))
    return candidates.groupBy(*keys).agg(F.max_by(F.struct("threshold", "f1", "fp"), order).alias("b")).select(*keys, "b.*")


def gates(slices: DataFrame, min_recall: float, max_fp_rate: float) -> DataFrame:
    """Does every family reach the recall and every healthy profile stay under the false-positive rate?"""
    fp_rate = divide(F.col("fp"), F.col("fp") + F.col("tn"))
    return slices.agg(
        F.bool_and(F.when(F.col("slice").isin("ALL", "family"), F.coalesce(F.col("recall") >= min_recall, F.lit(False))))
        .alias("recall_ok"),
        F.bool_and(F.when(F.col("slice").isin("ALL", "profile"), F.coalesce(fp_rate <= max_fp_rate, F.lit(True))))
        .alias("alarms_ok"),
    ).withColumn("passes", F.col("recall_ok") & F.col("alarms_ok"))


def acceptance(overall: DataFrame, families: DataFrame, profiles: DataFrame, missing: DataFrame,
               min_faults: int = 100, min_healthy: int = 1000) -> DataFrame:
    """INSUFFICIENT_COVERAGE, FAILED_METRICS or PASSED. Every input is an aggregate of a few rows."""
    fp_rate = divide(F.col("fp"), F.col("fp") + F.col("tn"))
    f = families.agg(
        F.min(F.col("tp") + F.col("fn")).alias("fewest_faults"), F.min("recall").alias("worst_recall"))
    p = profiles.agg(F.min(F.col("fp") + F.col("tn")).alias("fewest_healthy"), F.max(fp_rate).alias("worst_rate"))
    o = overall.agg(F.max("recall").alias("recall"), F.max(fp_rate).alias("fp_rate"))
    m = missing.agg(F.sum("missing").alias("missing"))
    one = [x.withColumn("k", F.lit(1)) for x in (f, p, o, m)]
    j = one[0].join(one[1], "k").join(one[2], "k").join(one[3], "k").drop("k")
    thin = (F.col("missing") > 0) | (F.col("fewest_faults") < min_faults) | (F.col("fewest_healthy") < min_healthy)
    failed = (F.col("recall") < 0.7) | (F.col("fp_rate") > 0.01) | (F.col("worst_recall") < 0.7) | (F.col("worst_rate") > 0.01)
    return j.withColumn(
        "status", F.when(thin, "INSUFFICIENT_COVERAGE").when(failed, "FAILED_METRICS").otherwise("PASSED"))


# -- episode matching -------------------------------------------------------------------------------

def overlap_pairs(truth: DataFrame, detected: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Compatible pairs that overlap (or nearly do), found through shared time cells.

    ``truth`` and ``detected`` have id, start_s, end_s (and detected_s). Both are episodes, cut into
    cells of an hour; a pair is kept in the first cell they share.
    """
    cell = 3600

    def cut(df: DataFrame, pad: float) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(
            F.floor((F.col("start_s") - pad) / cell), F.floor((F.col("end_s") + pad) / cell))))

    t = cut(truth.select(key, F.col("id").alias("truth_id"), "start_s", "end_s"), tolerance).withColumnsRenamed(
        {"start_s": "t_start", "end_s": "t_end"})
    d = cut(detected.select(key, F.col("id").alias("detected_id"), "start_s", "end_s", "detected_s"), 0.0)
    overlap = F.least("t_end", "end_s") - F.greatest("t_start", "start_s")
    first = F.greatest(F.floor((F.col("t_start") - tolerance) / cell), F.floor(F.col("start_s") / cell))
    return t.join(d, [key, "cell"]).where((F.col("cell") == first) & (overlap > -tolerance)).select(
        F.col(key).alias("match_key"), "truth_id", "detected_id", F.greatest(overlap, F.lit(0.0)).alias("overlap"),
        "detected_s", (F.col("detected_s") - F.col("t_start")).alias("delay"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """Largest overlap first, each episode at most once.

    A pair wins when it is first for both its episodes; winners remove their rivals, and rounds go on
    until no pair is left. Each round is two aggregates and two anti joins, so no key's pairs ever meet
    in one task.
    """
    order = F.struct((-F.col("overlap")).alias("o"), F.col("detected_s"), F.col("detected_id"), F.col("truth_id"))
    left = cut_lineage(pairs.withColumn("o", order))
    won = None
    while not left.isEmpty():
        by_truth = left.groupBy("match_key", "truth_id").agg(F.min("o").alias("bt"))
        by_detected = left.groupBy("match_key", "detected_id").agg(F.min("o").alias("bd"))
        marked = left.join(by_truth, ["match_key", "truth_id"]).join(by_detected, ["match_key", "detected_id"])
        winners = cut_lineage(marked.where((F.col("o") == F.col("bt")) & (F.col("o") == F.col("bd"))).select(*left.columns))
        won = winners if won is None else won.unionByName(winners)
        left = cut_lineage(
            left.join(winners.select("match_key", "truth_id"), ["match_key", "truth_id"], "left_anti")
            .join(winners.select("match_key", "detected_id"), ["match_key", "detected_id"], "left_anti"))
    result = left if won is None else won
    return result.drop("o")


def match_summary(truth: DataFrame, detected: DataFrame, pairs: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """tp/fp/fn, duplicates (unmatched detections that overlap some truth) and mean delay per key."""
    n_t = truth.groupBy(F.col(key).alias("match_key")).agg(F.count("*").alias("truth_episodes"))
    n_d = detected.groupBy(F.col(key).alias("match_key")).agg(F.count("*").alias("detected_episodes"))
    n_m = matched.groupBy("match_key").agg(F.count("*").alias("tp"), F.sum("delay").alias("delay_total"))
    extra = pairs.select("match_key", "detected_id").distinct().join(
        matched.select("match_key", "detected_id"), ["match_key", "detected_id"], "left_anti"
    ).groupBy("match_key").agg(F.count("*").alias("duplicates"))
    j = n_t.join(n_d, "match_key", "full").join(n_m, "match_key", "left").join(extra, "match_key", "left").na.fill(0)
    return j.withColumn("fp", F.col("detected_episodes") - F.col("tp")).withColumn("fn", F.col("truth_episodes") - F.col("tp"))


#: What two episodes must agree on, seconds of a cell of time, and the pairs of a cluster that are found or settled in one pass.
COMPATIBLE = ["group", "domain", "scope", "family"]
CELL, SETTLED = 3600, 5000


def candidate_pairs(truth: DataFrame, detected: DataFrame, tolerance: float, keys: list[str] = COMPATIBLE, at_once: int = SETTLED) -> DataFrame:
    """Pairs of compatible episodes that overlap, or miss each other by less than the tolerance, with the ``cluster`` they are in.

    Episodes: id, start_s, end_s and the keys; truth also first_finalized_s and recovered_s, detections detected_s and recovered_s, which
    may be null. An episode spans cells of time. Neighbouring cells that episodes span are one cluster: pairs of different clusters share no
    episode. Clusters come from one row per key and first cell, as many as the calendar has. The episodes of a cluster meet at once if they are few;
    those of a cluster with more than ``at_once`` combinations are cut into cells and a pair is found in the first cell both are in. A null key is compatible with nothing.
    The pairs are stored, as matching and its report read them several times.
    """

    def placed(df: DataFrame, pad: float, side: str) -> DataFrame:
        low, high = F.floor((F.col("start_s") - pad) / CELL), F.floor((F.col("end_s") + pad) / CELL)
        known = [F.col(c).isNotNull() for c in ("low", "high", *keys)]
        spanned = df.withColumns({"low": low, "high": high, "side": F.lit(side)}).where(reduce(and_, known))
        return spanned.withColumn("high", F.greatest("low", "high"))

    t = placed(truth.select(*keys, F.col("id").alias("truth_id"), "start_s", "end_s", "first_finalized_s", F.col("recovered_s").alias("t_recovered")), tolerance, "t")
    d = placed(detected.select(*keys, F.col("id").alias("detected_id"), "start_s", "end_s", "detected_s", F.col("recovered_s").alias("d_recovered")), 0.0, "d")
    spans = t.select(*keys, "low", "high", "side").unionByName(d.select(*keys, "low", "high", "side")).groupBy(*keys, "low").agg(
        F.max("high").alias("high"), F.count_if(F.col("side") == "t").alias("n_t"), F.count_if(F.col("side") == "d").alias("n_d"))
    order = Window.partitionBy(*keys).orderBy("low")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("first", F.when(reached.isNull() | (reached < F.col("low")), F.col("low")))
    runs = runs.withColumn("cluster", F.last("first", ignorenulls=True).over(order))
    whole = Window.partitionBy(*keys, "cluster")
    runs = runs.withColumns({"n_t": F.sum("n_t").over(whole), "n_d": F.sum("n_d").over(whole)}).where("n_t > 0 AND n_d > 0").select(
        *keys, "low", "cluster", (F.col("n_t").cast("double") * F.col("n_d") > at_once).alias("cut"))

    def met(df: DataFrame) -> DataFrame:
        cells = F.when(F.col("cut"), F.sequence("low", "high")).otherwise(F.array("cluster"))
        return df.drop("side").join(runs, [*keys, "low"]).withColumn("cell", F.explode(cells))

    left = met(t).withColumnsRenamed({"start_s": "t_start", "end_s": "t_end", "low": "t_low", "high": "t_high"})
    right = met(d).drop("cut")
    overlap = F.least("t_end", "end_s") - F.greatest("t_start", "start_s")
    first = F.greatest("t_low", "low")
    found = left.join(right, [*keys, "cluster", "cell"]).where(F.when(F.col("cut"), F.col("cell") == first).otherwise(first <= F.least("t_high", "high")) & (overlap > -tolerance))
    return stored(found.select(
        *keys, "cluster", "truth_id", "detected_id", F.greatest(overlap, F.lit(0.0)).alias("overlap"), "detected_s",
        (F.col("detected_s") - F.col("t_start")).alias("detection_delay"), (F.col("detected_s") - F.col("first_finalized_s")).alias("finalized_delay"),
        (F.col("d_recovered") - F.col("t_recovered")).alias("recovery_delay"), F.col("d_recovered").isNull().alias("recovery_unobserved")))


def match_episodes(pairs: DataFrame, keys: list[str] = COMPATIBLE, at_once: int = SETTLED) -> DataFrame:
    """The pairs that greedy matching takes: largest overlap first, then earliest detection, then by ids, each episode at most once.

    A cluster of up to ``at_once`` pairs is settled in one pass over its sorted pairs, as no other cluster shares an episode with it.
    Larger ones, such as a key with a third of all episodes without a pause, go through rounds in which no cluster meets in
    one task.
    """
    cluster = [*keys, "cluster"]
    crowded = cut_lineage(pairs.groupBy(*cluster).agg(F.count("*").alias("pairs")).where(F.col("pairs") > at_once).drop("pairs"))
    has_crowded = not crowded.isEmpty()
    small = pairs.join(crowded, cluster, "left_anti") if has_crowded else pairs

    def settle(frames):
        here, taken = None, set()
        for frame in frames:
            won = []
            for cluster, t, d in zip(zip(*[frame[k] for k in (*keys, "cluster")]), frame["truth_id"], frame["detected_id"]):
                if cluster != here:
                    here, taken = cluster, set()
                won.append(("t", t) not in taken and ("d", d) not in taken)
                if won[-1]:
                    taken |= {("t", t), ("d", d)}
            yield frame[won]

    order = [*cluster, F.desc("overlap"), "detected_s", "detected_id", "truth_id"]
    matched = small.repartition(*cluster).sortWithinPartitions(*order).mapInPandas(settle, small.schema)
    if not has_crowded:
        return matched
    rounds = greedy_match(pairs.join(crowded, cluster, "left_semi").withColumn("match_key", F.struct(*keys)))
    return matched.unionByName(rounds.select(*small.columns))


def matching_report(truth: DataFrame, detected: DataFrame, pairs: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, duplicates, unobserved recoveries and mean delays per ``by``, some of the keys.

    Precision is null without detections and recall without truth. A duplicate is an unmatched detection that some compatible true episode
    overlaps. The delays themselves are the columns of ``matched``, a row per pair. Null keys are a group of their own.
    """
    n_t = truth.groupBy(*by).agg(F.count("*").alias("truth_episodes"))
    n_d = detected.groupBy(*by).agg(F.count("*").alias("detected_episodes"))
    n_m = matched.groupBy(*by).agg(
        F.count("*").alias("tp"), F.count_if("recovery_unobserved").alias("recovery_unobserved"), F.avg("detection_delay").alias("mean_detection_delay"),
        F.avg("finalized_delay").alias("mean_finalized_delay"), F.avg("recovery_delay").alias("mean_recovery_delay"))
    key = [*dict.fromkeys([*by, "detected_id"])]
    extra = pairs.select(*key).distinct().join(matched.select(*key), key, "left_anti").groupBy(*by).agg(F.count("*").alias("duplicates"))
    counts = ["truth_episodes", "detected_episodes", "tp", "recovery_unobserved", "duplicates"]
    empty = F.lit(0).cast("bigint")
    frames = [n_t, n_d, n_m, extra]
    long = None
    for frame in frames:  # one grouping in place of null-unsafe outer joins
        full = frame.select(*by, *[(F.col(c) if c in frame.columns else empty).alias(c) for c in counts],
                            *[(F.col(c) if c in frame.columns else F.lit(None).cast("double")).alias(c) for c in n_m.columns if c.startswith("mean_")])
        long = full if long is None else long.unionByName(full)
    whole = long.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], *[F.max(c).alias(c) for c in long.columns if c.startswith("mean_")])
    return whole.withColumns({
        "fp": F.col("detected_episodes") - F.col("tp"), "fn": F.col("truth_episodes") - F.col("tp"),
        "precision": divide(F.col("tp"), F.col("detected_episodes")), "recall": divide(F.col("tp"), F.col("truth_episodes"))})


def ablation(rows: DataFrame, modes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Windows metrics of several prediction modes in one pass: (prediction, eligible) per mode."""
    from vigilmesh.operators.evaluation import confusion

    packed = F.array(*[
        F.struct(F.lit(name).alias("mode"), pred.alias("pred"), ok.alias("ok")) for name, (pred, ok) in modes.items()])
    long = rows.select("fault", F.explode(packed).alias("m")).select("fault", "m.*")
    counted = long.groupBy("mode").agg(
        *confusion(F.col("fault") == 1, F.coalesce("pred", F.lit(False))), F.count_if("ok").alias("eligible_windows"))
    return rates(counted)


def agreement(model: Column, rule: Column) -> Column:
    return F.when(model.isNull(), "unavailable").when(model == rule, "agree").otherwise("disagree")


def representatives(rows: DataFrame, strata: list[str], row_id: str) -> DataFrame:
    """One row per stratum: the smallest id."""
    from vigilmesh.operators.latest import oldest

    return oldest(rows, strata, [row_id])


def shadow_rows(windows: DataFrame, scored: DataFrame, key: str, model_version: str, threshold: float) -> DataFrame:
    """One result per eligible window and model version; UNAVAILABLE where no score exists."""
    from vigilmesh.functions.fingerprint import identity

    j = windows.join(scored.select(key, "score"), key, "left")
    ok = F.col("score").isNotNull()
    return j.select(
        *windows.columns,
        identity(F.col(key), model_version).alias("evidence_id"),
        F.lit(model_version).alias("requested_model_version"),
        F.when(ok, "OK").otherwise("UNAVAILABLE").alias("ml_status"),
        F.col("score").alias("classifier_score"),
        F.when(ok, F.col("score") >= threshold).alias("detection"),
        F.when(ok, F.lit(model_version)).alias("model_version"),
    )

