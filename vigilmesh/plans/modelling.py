"""Model queries: ML-1…15."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmesh.adapters import Tables
from vigilmesh.models import classifier, forest, scaling, selection
from vigilmesh.operators import evaluation
from vigilmesh.operators.latest import empirical_rank
from vigilmesh.oracle_views import sql
from vigilmesh.plans.aggregates import _COUNTS, _RATES, RATE_COLUMNS
from vigilmesh.plans.common import num, num_sql, when, when_sql
from vigilmesh.plans.detection import kpi_sql, measured, _VECTOR_SQL
from vigilmesh.registry import query
from vigilmesh.session import stored

FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5"]
TREES, SAMPLE = 40, 128


def normal_train(t: Tables):
    return t.vectors.where("split = 'train' AND fault = 0").select("vec_id", *FEATURES)


def forest_model(t: Tables, trees: int = TREES, sample: int = SAMPLE):
    return forest.fit(normal_train(t), "vec_id", FEATURES, trees, sample)


def strengths(t: Tables, trees: int = TREES, sample: int = SAMPLE):
    rows = t.vectors.select("vec_id", "split", "fault", "family", "severity", "profile", *FEATURES)
    return forest.score(rows, forest_model(t, trees, sample), FEATURES, sample)


def ranked(t: Tables, trees: int = TREES, sample: int = SAMPLE):
    scored = strengths(t, trees, sample)
    known = scored.where("split = 'calibration' AND fault = 0").select("strength")
    return empirical_rank(scored.where("split <> 'calibration'"), known, "strength")


def _draw_sql(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE"


def forest_views(trees: int = TREES, sample: int = SAMPLE, seed: int = 7, p: str = "") -> dict[str, str]:
    """The forest grown by a recursion over levels, and its ranks; ``p`` begins the names of the views."""
    numbers = range(1, len(FEATURES) + 1)
    average = f"CASE WHEN n <= 1 THEN 0.0::DOUBLE WHEN n = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln(n - 1.0::DOUBLE) + {forest.EULER}::DOUBLE) - 2.0::DOUBLE * (n - 1.0::DOUBLE) / n END"
    split = f"""
SELECT *, lo[f] + {_draw_sql(str(seed + 2), "tree", "node", "'place'")} * (hi[f] - lo[f]) AS threshold FROM (
  SELECT *, CASE WHEN depth < {forest.depth_limit(sample)} AND len(open) > 0 THEN open[CAST(floor({_draw_sql(str(seed + 2), "tree", "node", "'feature'")} * len(open)) AS INT) + 1] END AS f FROM (
    SELECT *, [i FOR i IN [{", ".join(map(str, numbers))}] IF hi[i] > lo[i]] AS open FROM (
      SELECT *, count(*) OVER w AS c, [{", ".join(f"min(x[{i}]) OVER w" for i in numbers)}] AS lo, [{", ".join(f"max(x[{i}]) OVER w" for i in numbers)}] AS hi FROM {p}grow WINDOW w AS (PARTITION BY tree, node))))"""
    return {
        f"{p}pool": f"SELECT vec_id, [{', '.join(FEATURES)}] AS x, count(*) OVER () AS total FROM vectors WHERE split = 'train' AND fault = 0",
        f"{p}rated": f"SELECT *, least(1.0::DOUBLE, rate * {trees} * 2) AS keep FROM (SELECT *, least(1.0::DOUBLE, {float(sample)}::DOUBLE / total) AS rate FROM {p}pool)",
        f"{p}grow": f"""
SELECT tree, x, CAST(0 AS BIGINT) AS node, 0 AS depth FROM {p}rated, range({trees}) r(tree) WHERE {_draw_sql(str(seed), "vec_id")} < keep AND {_draw_sql(str(seed + 1), "vec_id", "tree")} < rate / keep
UNION ALL SELECT tree, x, 2 * node + CASE WHEN x[f] <= threshold THEN 1 ELSE 2 END, depth + 1 FROM ({split}) WHERE f IS NOT NULL""",
        f"{p}nodes": f"""
SELECT tree, node, coalesce(f - 1, -1) AS feature, coalesce(threshold, 0) AS threshold, CASE WHEN f IS NULL THEN CAST(floor((depth + {average}) * {float(forest.PARTS)}::DOUBLE + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS path
FROM (SELECT DISTINCT tree, node, depth, f, threshold, CAST(c AS DOUBLE) AS n FROM ({split}))""",
        f"{p}walk": f"""
SELECT vec_id, [{', '.join(FEATURES)}] AS x, tree, CAST(0 AS BIGINT) AS node FROM vectors, (SELECT DISTINCT tree FROM {p}nodes)
UNION ALL SELECT w.vec_id, w.x, w.tree, 2 * w.node + CASE WHEN w.x[n.feature + 1] <= n.threshold THEN 1 ELSE 2 END FROM {p}walk w JOIN {p}nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0""",
        f"{p}scored": f"""
SELECT v.*, s.strength FROM vectors v JOIN (SELECT vec_id, pow(2.0::DOUBLE, -((sum(path)::DOUBLE / {forest.PARTS} / count(*)) / {forest.average_path(sample)!r}::DOUBLE)) AS strength
  FROM {p}walk w JOIN {p}nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature < 0 GROUP BY 1) s ON s.vec_id = v.vec_id""",
        f"{p}known": f"SELECT strength, count(*) AS c FROM {p}scored WHERE split = 'calibration' AND fault = 0 GROUP BY 1",
        f"{p}ranked": f"SELECT s.*, coalesce((SELECT sum(c) FROM {p}known k WHERE k.strength <= s.strength), 0)::DOUBLE / (SELECT sum(c) FROM {p}known) AS rank FROM {p}scored s WHERE split <> 'calibration'",
    }


def forest_sql(body: str, *views: dict[str, str], **more: str) -> str:
    return sql(body, "vectors", recursive=True, **{k: v for view in views for k, v in view.items()}, **more)


@query("ml_01_isolation_forest_fit", forest_sql(f"SELECT tree, node, feature, {num_sql('threshold')} AS threshold, path FROM nodes", forest_views()))
def fit(t: Tables):
    return forest_model(t).select("tree", F.col("node").cast("bigint").alias("node"), F.col("feature").cast("bigint").alias("feature"), num("threshold"), "path").withColumn("tree", F.col("tree").cast("bigint"))


@query("ml_02_isolation_forest_scores", forest_sql(f"SELECT vec_id, split, fault, {num_sql('strength')} AS strength FROM scored", forest_views()))
def scores(t: Tables):
    return strengths(t).select("vec_id", "split", "fault", num("strength"))


@query("ml_03_calibrated_anomaly_flags", forest_sql(f"SELECT vec_id, split, fault, {num_sql('rank')} AS rank, rank >= 0.975::DOUBLE AS anomaly FROM ranked", forest_views()))
def flags(t: Tables):
    return ranked(t).select("vec_id", "split", "fault", num("rank"), (F.col("rank") >= 0.975).alias("anomaly"))


_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN vec_id % 11 <> {i} THEN {f} END AS v FROM vectors" for i, f in enumerate(FEATURES))


@query(
    "ml_04_median_mad_scaling",
    sql(
        f"""
SELECT m.feature, {num_sql("m.c")} AS center, {num_sql("mad")} AS mad, {num_sql("CASE WHEN mad > 0 THEN mad ELSE 1 END")} AS scale FROM meds m JOIN (SELECT l.feature, median(abs(coalesce(l.v, m.c) - m.c)) AS mad FROM long l JOIN meds m ON m.feature = l.feature GROUP BY 1) d ON d.feature = m.feature""",
        "vectors", long=_LONG, meds="SELECT feature, median(v) AS c FROM long GROUP BY 1",
    ),
)
def median_mad(t: Tables):
    rows = t.vectors.select(*[F.when(F.col("vec_id") % 11 != i, F.col(f)).alias(f) for i, f in enumerate(FEATURES)])
    return scaling.fit_scaling(rows, FEATURES).select("feature", num("center"), num("mad"), num("scale"))


def supervised(t: Tables, view: str = "full", kind: str = "forest"):
    train = t.vectors.where("split IN ('train', 'calibration')")
    settings = {"numTrees": 20, "maxDepth": 5} if kind == "forest" else {"maxIter": 8, "maxDepth": 3}
    return classifier.score(classifier.train(train, view, kind, **settings), t.vectors.where("split IN ('validation', 'test')"))


@query("ml_05_supervised_classifier_scores")
def supervised_scores(t: Tables):
    a = supervised(t, "full", "forest").select(F.lit("forest-full").alias("config"), "vec_id", "split", "fault", "score")
    b = supervised(t, "reduced", "boosted").select(F.lit("boosted-reduced").alias("config"), "vec_id", "split", "fault", "score")
    return a.unionByName(b)


# Thresholds of the search.
GRID = [i / 20.0 for i in range(1, 20)] + [0.99]


@query(
    "ml_06_threshold_grid_counts",
    sql(
        f"""
SELECT family, CAST(position AS INT) AS position, {_RATES} FROM (SELECT family, position, count(*) FILTER (WHERE fault = 1 AND score >= position / 20.0::DOUBLE) AS tp, count(*) FILTER (WHERE fault = 0 AND score >= position / 20.0::DOUBLE) AS fp,
  count(*) FILTER (WHERE fault = 0 AND score < position / 20.0::DOUBLE) AS tn, count(*) FILTER (WHERE fault = 1 AND score < position / 20.0::DOUBLE) AS fn FROM (SELECT family, fault, (f0 + 1) / 2 AS score FROM vectors), range(1, 20) r(position) GROUP BY 1, 2)""",
        "vectors",
    ),
)
def threshold_grid(t: Tables):
    scored = t.vectors.select("family", "fault", ((F.col("f0") + 1) / 2).alias("score"))
    out = selection.threshold_counts(scored, ["family"], [i / 20.0 for i in range(1, 20)])
    position = F.round(F.col("threshold") * 20).cast("int").alias("position")
    return out.select("family", position, "tp", "fp", "tn", "fn", *[num(c) for c in RATE_COLUMNS])


_GRID_SQL = f"SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in GRID)}]) AS threshold"
_CONFIGS_SQL = "SELECT 'n20-s64' AS config, rank, fault FROM a_ranked WHERE split = 'validation' UNION ALL SELECT 'n40-s128', rank, fault FROM ranked WHERE split = 'validation'"


@query(
    "ml_06_choice_within_budget",
    forest_sql(
        f"""
SELECT config, threshold, {_RATES}, {num_sql("fp_rate")} AS fp_rate FROM (SELECT *, fp::DOUBLE / nullif(fp + tn, 0) AS fp_rate, tp::DOUBLE / nullif(tp + fn, 0) AS r, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS q FROM (
  SELECT config, threshold, {_COUNTS.replace("truth", "fault").replace("prediction = 1", "rank >= threshold").replace("prediction = 0", "rank < threshold")} FROM configs, grid GROUP BY 1, 2))
WHERE fp_rate <= 0.9 ORDER BY r DESC NULLS LAST, q DESC, fp_rate, threshold DESC, config DESC LIMIT 1""",
        forest_views(20, 64, p="a_"), forest_views(), grid=_GRID_SQL, configs=_CONFIGS_SQL,
    ),
)
def budget_choice(t: Tables):
    configs = None
    for trees, sample in ((20, 64), (40, 128)):
        s = ranked(t, trees, sample).where("split = 'validation'").select(
            F.lit(f"n{trees}-s{sample}").alias("config"), F.col("rank").alias("score"), "fault")
        configs = s if configs is None else configs.unionByName(s)
    counted = selection.threshold_counts(configs, ["config"], GRID)
    best = selection.choose_within_budget(counted, 0.9, ("config",))
    return best.select("config", "threshold", "tp", "fp", "tn", "fn", *[num(c) for c in [*RATE_COLUMNS, "fp_rate"]])


@query(
    "ml_06_gates_per_slice",
    sql(
        """
SELECT bool_and(recall_ok) AS recall_ok, bool_and(alarms_ok) AS alarms_ok, bool_and(recall_ok) AND bool_and(alarms_ok) AS passes FROM (
SELECT coalesce(avg(CASE WHEN truth = 1 THEN prediction END) >= 0.7, FALSE) AS recall_ok, coalesce(avg(CASE WHEN truth = 0 THEN prediction END) <= 0.9, TRUE) AS alarms_ok FROM classified
UNION ALL SELECT coalesce(avg(CASE WHEN truth = 1 THEN prediction END) >= 0.7, FALSE), TRUE FROM classified GROUP BY family
UNION ALL SELECT TRUE, coalesce(avg(CASE WHEN truth = 0 THEN prediction END) <= 0.9, TRUE) FROM classified GROUP BY profile)""",
        "classified",
    ),
)
def slice_gates(t: Tables):
    slices = evaluation.sliced(t.classified, F.col("truth") == 1, F.col("prediction") == 1, ["family", "profile"])
    return selection.gates(slices, 0.7, 0.9)


@query(
    "ml_07_healthy_quantile_thresholds",
    sql(
        f"SELECT profile, {num_sql('quantile_cont(f0, 0.99)')} AS q99, {num_sql('quantile_cont(f0, 0.995)')} AS q995 FROM vectors WHERE fault = 0 GROUP BY 1",
        "vectors",
    ),
)
def healthy_thresholds(t: Tables):
    healthy = t.vectors.where("fault = 0").select("profile", F.col("f0").alias("value"))
    a = scaling.exact_quantiles(healthy, ["profile"], 0.99).withColumnRenamed("quantile", "q99")
    b = scaling.exact_quantiles(healthy, ["profile"], 0.995).withColumnRenamed("quantile", "q995")
    return a.join(b, "profile").select("profile", num("q99"), num("q995"))


@query(
    "ml_08_best_f1_threshold",
    sql(
        """
SELECT profile, CAST(position AS INT) AS position, fp FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), -1) DESC, fp, position DESC) AS rn FROM (
  SELECT profile, position, count(*) FILTER (WHERE fault = 1 AND score >= position / 20.0::DOUBLE) AS tp, count(*) FILTER (WHERE fault = 0 AND score >= position / 20.0::DOUBLE) AS fp, count(*) FILTER (WHERE fault = 1 AND score < position / 20.0::DOUBLE) AS fn
  FROM (SELECT profile, fault, (f0 + 1) / 2 AS score FROM vectors WHERE split <> 'train'), range(1, 20) r(position) GROUP BY 1, 2)) WHERE rn = 1""",
        "vectors",
    ),
)
def f1_threshold(t: Tables):
    scored = t.vectors.where("split <> 'train'").select("profile", "fault", ((F.col("f0") + 1) / 2).alias("score"))
    best = selection.best_f1(selection.threshold_counts(scored, ["profile"], [i / 20.0 for i in range(1, 20)]), ["profile"])
    return best.select("profile", F.round(F.col("threshold") * 20).cast("int").alias("position"), "fp")


EPISODES_SQL = {
    "truth": "SELECT 'G' || (o_orderkey % 50) AS g, 't' || o_orderkey AS id, (o_orderkey * 977) % 2592000 AS s, (o_orderkey * 977) % 2592000 + 600 + o_custkey % 3000 AS e FROM orders WHERE o_orderstatus = 'O'",
    "detected": "SELECT 'G' || (o_orderkey % 50) AS g, 'd' || o_orderkey AS id, (o_orderkey * 991) % 2592000 AS s, (o_orderkey * 991) % 2592000 + 600 + o_custkey % 2000 AS e, (o_orderkey * 991) % 2592000 + 300 AS at FROM orders WHERE o_orderstatus = 'F'",
}
TOLERANCE = 300


def episode_sets(t: Tables):
    o = t.raw("orders")

    def shape(status: str, letter: str, factor: int, spread: int):
        start = f"CAST((o_orderkey * {factor}) % 2592000 AS DOUBLE)"
        return o.where(f"o_orderstatus = '{status}'").selectExpr(
            "concat('G', o_orderkey % 50) AS g", f"concat('{letter}', o_orderkey) AS id", f"{start} AS start_s",
            f"{start} + 600 + o_custkey % {spread} AS end_s", f"{start} + 300 AS detected_s")

    return shape("O", "t", 977, 3000), shape("F", "d", 991, 2000)


@query(
    "ml_09_episode_overlap_pairs",
    sql(
        f"""
SELECT t.g AS match_key, t.id AS truth_id, d.id AS detected_id, greatest(least(t.e, d.e) - greatest(t.s, d.s), 0)::DOUBLE AS overlap, (d.at - t.s)::DOUBLE AS delay
FROM truth t JOIN detected d ON d.g = t.g AND least(t.e, d.e) - greatest(t.s, d.s) > -{TOLERANCE}""",
        **EPISODES_SQL,
    ),
)
def episode_pairs(t: Tables):
    truth, found = episode_sets(t)
    return selection.overlap_pairs(truth, found, "g", TOLERANCE).drop("detected_s")


# One true episode per order; detections follow it by a while, some twice, some never, and some recoveries are not seen. A customer is a group, so
# groups grow with the orders.
_START = "(o_orderkey * 977) % 2592000"
_TRUE = {"group": "concat('G', o_custkey)", "domain": "CASE WHEN o_custkey % 2 = 0 THEN 'VOLTE' ELSE 'SMS' END", "scope": "concat('S', o_custkey % 10)",
         "family": "CASE WHEN o_orderkey % 3 = 0 THEN 'loss' ELSE 'delay' END"}
MATCHING_SQL = {
    "truth": f"""
SELECT {", ".join(f'{v} AS "{k}"' for k, v in _TRUE.items())}, 't' || o_orderkey AS id, {_START}::DOUBLE AS start_s, {_START} + 600::DOUBLE + o_orderkey % 40000 AS end_s, {_START} + 300::DOUBLE AS first_finalized_s,
  {_START} + 900::DOUBLE + o_orderkey % 40000 AS recovered_s FROM orders""",
    "detected": f"""
SELECT {", ".join(f'{v} AS "{k}"' for k, v in _TRUE.items())}, 'd' || n || '-' || o_orderkey AS id, s AS start_s, s + 900 + o_orderkey % 30000 AS end_s, s + 300 AS detected_s, CASE WHEN o_orderkey % 7 <> 0 THEN s + 1500 + o_orderkey % 30000 END AS recovered_s
FROM (SELECT *, {_START}::DOUBLE + (o_orderkey * 7919) % 1800 + n * 1200 AS s FROM orders, (SELECT unnest([0, 1]) AS n) WHERE o_orderstatus <> 'P' AND (n = 0 OR o_orderkey % 4 = 0))""",
    "pairs": f"""
SELECT t."group", t.domain, t.scope, t.family, t.id AS truth_id, d.id AS detected_id, greatest(least(t.end_s, d.end_s) - greatest(t.start_s, d.start_s), 0) AS overlap, d.detected_s, d.detected_s - t.start_s AS detection_delay,
  d.detected_s - t.first_finalized_s AS finalized_delay, d.recovered_s - t.recovered_s AS recovery_delay
FROM truth t JOIN detected d ON d."group" = t."group" AND d.domain = t.domain AND d.scope = t.scope AND d.family = t.family AND least(t.end_s, d.end_s) - greatest(t.start_s, d.start_s) > -{TOLERANCE}""",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY "group", domain, scope, family ORDER BY overlap DESC, detected_s, detected_id, truth_id) AS rn FROM pairs""",
    "greedy": """
SELECT "group", domain, scope, family, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS taken, FALSE AS won, CAST(NULL AS VARCHAR) AS truth_id, CAST(NULL AS VARCHAR) AS detected_id FROM ordered WHERE rn = 1
UNION ALL SELECT g."group", g.domain, g.scope, g.family, p.rn, CASE WHEN list_contains(g.taken, p.truth_id) OR list_contains(g.taken, p.detected_id) THEN g.taken ELSE list_concat(g.taken, [p.truth_id, p.detected_id]) END,
  NOT (list_contains(g.taken, p.truth_id) OR list_contains(g.taken, p.detected_id)), p.truth_id, p.detected_id
FROM greedy g JOIN ordered p ON p."group" = g."group" AND p.domain = g.domain AND p.scope = g.scope AND p.family = g.family AND p.rn = g.rn + 1""",
    "matched": "SELECT p.* FROM greedy g JOIN pairs p ON g.won AND p.truth_id = g.truth_id AND p.detected_id = g.detected_id",
}


def matching_sets(t: Tables):
    orders = t.raw("orders").withColumn("o_start", F.expr(f"CAST({_START} AS DOUBLE)"))
    keys = [F.expr(v).alias(k) for k, v in _TRUE.items()]
    truth = orders.select(
        *keys, F.expr("concat('t', o_orderkey)").alias("id"), F.col("o_start").alias("start_s"), F.expr("o_start + 600 + o_orderkey % 40000").alias("end_s"),
        F.expr("o_start + 300").alias("first_finalized_s"), F.expr("o_start + 900 + o_orderkey % 40000").alias("recovered_s"))
    found = orders.where("o_orderstatus <> 'P'").withColumn("n", F.explode(F.expr("IF(o_orderkey % 4 = 0, array(0, 1), array(0))")))
    found = found.withColumn("s", F.expr("o_start + (o_orderkey * 7919) % 1800 + n * 1200"))
    detected = found.select(
        *keys, F.expr("concat('d', n, '-', o_orderkey)").alias("id"), F.col("s").alias("start_s"), F.expr("s + 900 + o_orderkey % 30000").alias("end_s"),
        F.expr("s + 300").alias("detected_s"), F.expr("IF(o_orderkey % 7 <> 0, s + 1500 + o_orderkey % 30000, NULL)").alias("recovered_s"))
    return truth, detected


@query(
    "ml_09_greedy_episode_matching",
    sql(
        """SELECT truth_id, detected_id, overlap, detection_delay, finalized_delay, recovery_delay FROM matched""",
        recursive=True, **MATCHING_SQL,
    ),
)
def greedy(t: Tables):
    matched = selection.match_episodes(selection.candidate_pairs(*matching_sets(t), TOLERANCE))
    return matched.select("truth_id", "detected_id", "overlap", "detection_delay", "finalized_delay", "recovery_delay")


@query(
    "ml_09_matching_report",
    sql(
        f"""
SELECT t.domain, t.truth_episodes, d.detected_episodes, m.tp, d.detected_episodes - m.tp AS fp, t.truth_episodes - m.tp AS fn, {num_sql("m.tp::DOUBLE / d.detected_episodes")} AS precision, {num_sql("m.tp::DOUBLE / t.truth_episodes")} AS recall,
  coalesce(x.duplicates, 0) AS duplicates, m.unseen AS recovery_unobserved, {num_sql("m.a")} AS mean_detection_delay, {num_sql("m.b")} AS mean_finalized_delay, {num_sql("m.c")} AS mean_recovery_delay
FROM (SELECT domain, count(*) AS truth_episodes FROM truth GROUP BY 1) t JOIN (SELECT domain, count(*) AS detected_episodes FROM detected GROUP BY 1) d ON d.domain = t.domain
JOIN (SELECT domain, count(*) AS tp, count(*) FILTER (WHERE recovery_delay IS NULL) AS unseen, avg(detection_delay) AS a, avg(finalized_delay) AS b, avg(recovery_delay) AS c FROM matched GROUP BY 1) m ON m.domain = t.domain
LEFT JOIN (SELECT domain, count(DISTINCT detected_id) AS duplicates FROM pairs WHERE detected_id NOT IN (SELECT detected_id FROM matched) GROUP BY 1) x ON x.domain = t.domain""",
        recursive=True, **MATCHING_SQL,
    ),
)
def matching_report(t: Tables):
    truth, detected = matching_sets(t)
    pairs = selection.candidate_pairs(truth, detected, TOLERANCE)
    matched = stored(selection.match_episodes(pairs))  # the report reads it twice
    report = selection.matching_report(truth, detected, pairs, matched, ["domain"])
    return report.select("domain", "truth_episodes", "detected_episodes", "tp", "fp", "fn", num("precision"), num("recall"), "duplicates", "recovery_unobserved",
                         *[num(c) for c in ("mean_detection_delay", "mean_finalized_delay", "mean_recovery_delay")])


_MODES_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS mode, {_COUNTS.replace('truth', 'fault').replace('prediction = 1', p).replace('prediction = 0', 'NOT (' + p + ')')}, count(*) FILTER (WHERE {ok}) AS eligible_windows FROM vectors WHERE split = 'test'"
    for m, p, ok in (
        ("deterministic", "f0 > 0.05", "TRUE"),
        ("shadow", "coalesce(CASE WHEN vec_id % 4 <> 0 THEN f1 > 0.02 END, FALSE)", "vec_id % 4 <> 0"),
        ("combined", "f0 > 0.05", "TRUE"),
        ("no_topology", "f0 > 0.1", "TRUE"),
        ("no_baseline", "f0 > 0.2", "TRUE"),
    )
)


@query("ml_10_ablation_modes", sql(f"SELECT mode, eligible_windows, {_RATES} FROM ({_MODES_SQL})", "vectors"))
def ablation(t: Tables):
    yes = F.lit(True)
    shadow = F.when(F.col("vec_id") % 4 != 0, F.col("f1") > 0.02)
    out = selection.ablation(t.vectors.where("split = 'test'"), {
        "deterministic": (F.col("f0") > 0.05, yes), "shadow": (shadow, shadow.isNotNull()), "combined": (F.col("f0") > 0.05, yes),
        "no_topology": (F.col("f0") > 0.1, yes), "no_baseline": (F.col("f0") > 0.2, yes)})
    return out.select("mode", "eligible_windows", "tp", "fp", "tn", "fn", *[num(c) for c in RATE_COLUMNS])


@query(
    "ml_10_model_rule_agreement",
    sql("SELECT CASE WHEN vec_id % 4 = 0 THEN 'unavailable' WHEN (f1 > 0.02) = (f0 > 0.05) THEN 'agree' ELSE 'disagree' END AS agreement, count(*) AS windows FROM vectors GROUP BY 1", "vectors"),
)
def agreement(t: Tables):
    model = F.when(F.col("vec_id") % 4 != 0, F.col("f1") > 0.02)
    return t.vectors.groupBy(selection.agreement(model, F.col("f0") > 0.05).alias("agreement")).agg(F.count("*").alias("windows"))


@query(
    "ml_11_acceptance_status",
    sql(
        f"""
SELECT CASE WHEN missing > 0 OR ff < 5 OR fh < 5 THEN 'INSUFFICIENT_COVERAGE' WHEN recall < 0.7 OR fpr > 0.01 OR wr < 0.7 OR wf > 0.01 THEN 'FAILED_METRICS' ELSE 'PASSED' END AS status, {num_sql("recall")} AS recall, {num_sql("fpr")} AS fp_rate, CAST(missing AS BIGINT) AS missing
FROM (SELECT avg(CASE WHEN truth = 1 THEN prediction END) AS recall, avg(CASE WHEN truth = 0 THEN prediction END) AS fpr FROM classified) o,
  (SELECT min(n) AS ff, min(r) AS wr FROM (SELECT count(*) FILTER (WHERE truth = 1) AS n, avg(CASE WHEN truth = 1 THEN prediction END) AS r FROM classified GROUP BY family)) f,
  (SELECT min(n) AS fh, max(r) AS wf FROM (SELECT count(*) FILTER (WHERE truth = 0) AS n, avg(CASE WHEN truth = 0 THEN prediction END) AS r FROM classified GROUP BY profile)) p,
  (SELECT count(*) AS missing FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) m""",
        "classified",
    ),
)
def acceptance(t: Tables):
    s = evaluation.sliced(t.classified, F.col("truth") == 1, F.col("prediction") == 1, ["family", "profile"])
    missing = t.raw("labels").join(t.raw("documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))
    out = selection.acceptance(s.where("slice = 'ALL'"), s.where("slice = 'family'"), s.where("slice = 'profile'"), missing, 5, 5)
    return out.select("status", num("recall"), num("fp_rate"), "missing")


_COMPARED = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, {_COUNTS.replace('truth', 'fault').replace('prediction = 1', 'rank >= 0.975::DOUBLE').replace('prediction = 0', 'rank < 0.975::DOUBLE')}, count(*) AS eligible_windows FROM {view} WHERE split = 'test'"
    for mode, view in (("reference", "a_ranked"), ("candidate", "ranked")))


@query("ml_12_model_comparison", forest_sql(f"SELECT mode, eligible_windows, {_RATES} FROM ({_COMPARED})", forest_views(20, 64, p="a_"), forest_views()))
def comparison(t: Tables):
    a = ranked(t, 20, 64).where("split = 'test'").select("vec_id", "fault", F.col("rank").alias("reference_rank"))
    b = ranked(t, 40, 128).where("split = 'test'").select("vec_id", F.col("rank").alias("candidate_rank"))
    both = a.join(b, "vec_id")
    out = selection.ablation(both, {
        "reference": (F.col("reference_rank") >= 0.975, F.lit(True)), "candidate": (F.col("candidate_rank") >= 0.975, F.lit(True))})
    return out.select("mode", "eligible_windows", "tp", "fp", "tn", "fn", *[num(c) for c in RATE_COLUMNS])


@query(
    "ml_13_batch_feature_build",
    kpi_sql(
        f"""
SELECT scope_id, {when_sql("window_start")} AS window_start, {num_sql("p95_delivery_ms")} AS p95, {num_sql("delivery_sr_pct - b_delivery")} AS delivery_delta, quality FROM (SELECT *, {_VECTOR_SQL} AS v FROM kpis) WHERE service = 'SMS'"""),
)
def batch_features(t: Tables):
    rows = measured(t).where("service = 'SMS'")
    return rows.select("scope_id", when("window_start"), num("p95_delivery_ms", "p95"), num(F.col("delivery_sr_pct") - F.col("b_delivery"), "delivery_delta"), "quality")


@query(
    "ml_14_batch_and_single_row_parity",
    forest_sql(
        f"SELECT vec_id, family, severity, profile, {num_sql('strength')} AS strength, TRUE AS same FROM scored WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY family, severity, profile ORDER BY vec_id) = 1",
        forest_views(),
    ),
)
def parity(t: Tables):
    """Scores of one representative per stratum, computed in the whole batch and on their own."""
    model = forest.collected(forest_model(t))
    rows = t.vectors.where("split = 'test'").select("vec_id", "family", "severity", "profile", *FEATURES)
    batch = forest.score(rows, model, FEATURES, SAMPLE).select("vec_id", F.col("strength").alias("batch_score"))
    chosen = selection.representatives(rows, ["family", "severity", "profile"], "vec_id")
    single = forest.score(chosen, model, FEATURES, SAMPLE)
    return single.join(batch, "vec_id").select(
        "vec_id", "family", "severity", "profile", num("strength"), (F.abs(F.col("strength") - F.col("batch_score")) <= 1e-12).alias("same"))


@query(
    "ml_15_shadow_evidence_rows",
    sql(
        f"""
SELECT w.vec_id, sha256(concat_ws('|', w.vec_id, 'sms-supervised-v1')) AS evidence_id, CASE WHEN vec_id % 6 <> 0 THEN 'OK' ELSE 'UNAVAILABLE' END AS ml_status,
  {num_sql("CASE WHEN vec_id % 6 <> 0 THEN (f0 + 1) / 2 END")} AS classifier_score, CASE WHEN vec_id % 6 <> 0 THEN (f0 + 1) / 2 >= 0.55::DOUBLE END AS detection FROM vectors w""",
        "vectors",
    ),
)
def shadow(t: Tables):
    scored = t.vectors.where("vec_id % 6 <> 0").select("vec_id", ((F.col("f0") + 1) / 2).alias("score"))
    out = selection.shadow_rows(t.vectors.select("vec_id"), scored, "vec_id", "sms-supervised-v1", 0.55)
    return out.select("vec_id", "evidence_id", "ml_status", num("classifier_score"), "detection")
