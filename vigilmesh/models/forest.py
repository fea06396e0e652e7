"""Isolation forest: all trees grown together, a level per pass, from draws that are hashes.

A draw depends on the seed and on what it is for (a row, a tree, a node) and on nothing else, so that a forest is the same on any
cluster and in any engine. Each tree needs only a few hundred rows: they are dealt by tree once, and each level is a
few window aggregates over them. A forest is a table of at most trees × 2 × sample size nodes. That bound, not the
data, decides what is collected and shipped to the scoring tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "tree int, node int, feature int, threshold double, path bigint"
#: Paths are whole millionths of a step, so that their sums are exact in any order.
PARTS = 1_000_000
EULER = 0.5772156649015329


def average_path(n) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _average_path(n: Column) -> Column:
    some = 2.0 * (F.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(some)


def draw(*parts) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def tree_samples(rows: DataFrame, row_id: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows assigned to trees, about ``sample`` per tree, decided by hashing (row, tree).

    Most rows of a large table join no tree: one hash drops them before any is tested tree by tree.
    """
    total = rows.agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("total"))  # one row
    rate = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("total"))
    keep = F.least(F.lit(1.0), F.col("rate") * trees * 2)
    rated = rows.crossJoin(F.broadcast(total.select(rate.alias("rate")))).withColumn("keep", keep)
    kept = rated.where(draw(seed, F.col(row_id)) < F.col("keep"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    chosen = kept.select("*", tree).where(draw(seed + 1, F.col(row_id), F.col("tree")) < F.col("rate") / F.col("keep"))
    return chosen.drop("rate", "keep")


def depth_limit(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))))


def fit(rows: DataFrame, row_id: str, features: list[str], trees: int = 200, sample: int = 256, seed: int = 7) -> DataFrame:
    """The forest as a node table; node n has the children 2n + 1 (at most the threshold) and 2n + 2.

    A node with one row, with equal rows only, or at the depth limit is a leaf (feature -1), whose path is its depth and what is left
    of the search on average. Any other is split at a drawn place within the range of a drawn feature that varies. Ids are
    unique and features finite; a tree that drew no row is no part of the forest.
    """
    drawn = tree_samples(rows.select(row_id, *features), row_id, trees, sample, seed)
    points = drawn.select("tree", F.array(*features).alias("x"), F.lit(0).alias("node"), F.lit(False).alias("done"), F.array().cast(
        "array<struct<node:int,feature:int,threshold:double,path:bigint>>").alias("trail")).repartition("tree")
    numbers = range(len(features))
    for depth in range(depth_limit(sample) + 1):
        node = Window.partitionBy("tree", "node")
        low, high = (F.array(*[f(F.col("x")[i]).over(node) for i in numbers]) for f in (F.min, F.max))
        points = points.withColumns({"low": low, "high": high, "rows": F.count("*").over(node)})
        varying = F.filter(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.get("high", i) > F.get("low", i))
        points = points.withColumn("open", varying if depth < depth_limit(sample) else F.array().cast("array<int>"))
        # A varying feature implies two rows at least.
        at = F.floor(draw(seed + 2, F.col("tree"), F.col("node"), "feature") * F.size("open")).cast("int")
        points = points.withColumn("feature", F.get("open", at))
        here = F.get("low", F.col("feature")) + draw(seed + 2, F.col("tree"), F.col("node"), "place") * (F.get("high", F.col("feature")) - F.get("low", F.col("feature")))
        points = points.withColumn("threshold", here)
        leaf = F.col("feature").isNull()
        path = F.floor((F.lit(float(depth)) + _average_path(F.col("rows").cast("double"))) * float(PARTS) + 0.5).cast("bigint")
        step = F.struct(
            F.col("node").alias("node"), F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
            F.when(leaf, path).otherwise(F.lit(0).cast("bigint")).alias("path"))
        child = 2 * F.col("node") + F.when(F.get("x", F.col("feature")) <= F.col("threshold"), 1).otherwise(2)
        points = points.select(
            "tree", "x", F.when(F.col("done") | leaf, F.col("node")).otherwise(child).cast("int").alias("node"), (F.col("done") | leaf).alias("done"),
            F.when(F.col("done"), F.col("trail")).otherwise(F.array_append("trail", step)).alias("trail"))
    return points.select("tree", F.explode("trail").alias("n")).select("tree", "n.*").dropDuplicates(["tree", "node"])


def collected(model: DataFrame) -> pd.DataFrame:
    """The node table on the driver: at most trees × 2 × sample rows."""
    return model.toPandas()


def scorer(nodes: pd.DataFrame, sample: int):
    """A vectorised UDF for ``strength`` = 2^(-mean path / expected path): near 1 is anomalous."""
    forest = []
    for _, tree in nodes.groupby("tree"):
        size = 2 * int(tree["node"].max()) + 3
        at = tree["node"].to_numpy()
        # A side of a split that no row of the sample took ends the search there.
        feature, threshold = np.full(size, -1), np.zeros(size)
        path = np.floor(np.log2(np.arange(1, size + 1))).astype(np.int64) * PARTS
        feature[at], threshold[at], path[at] = tree["feature"], tree["threshold"], tree["path"]
        forest.append((feature, threshold, path))
    expected = max(average_path(sample), 1e-12)

    @F.pandas_udf(T.DoubleType())
    def strength(*columns: pd.Series) -> pd.Series:
        data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(data), np.int64)
        for feature, threshold, path in forest:
            at = np.zeros(len(data), dtype=int)
            rows = np.flatnonzero(feature[at] >= 0)
            while len(rows):
                node = at[rows]
                at[rows] = 2 * node + np.where(data[rows, feature[node]] <= threshold[node], 1, 2)
                rows = rows[feature[at[rows]] >= 0]
            total += path[at]
        return pd.Series(np.power(2.0, -(total / PARTS / max(len(forest), 1)) / expected))

    return strength


def score(rows: DataFrame, model: DataFrame | pd.DataFrame, features: list[str], sample: int = 256) -> DataFrame:
    """Rows with ``strength``, by a forest or one already collected."""
    udf = scorer(collected(model) if isinstance(model, DataFrame) else model, sample)
    return rows.withColumn("strength", udf(*[F.col(f) for f in features]))
