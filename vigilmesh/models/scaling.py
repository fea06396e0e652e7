"""Median imputation and median/MAD scaling with exact medians of arbitrarily many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmesh.operators.ranks import equi_depth_cells


def long_form(rows: DataFrame, features: list[str]) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(F.explode(packed).alias("p")).select("p.feature", "p.value")


def exact_quantiles(values: DataFrame, keys: list[str], quantile: float = 0.5, value: str = "value") -> DataFrame:
    """Interpolated quantile per key without sorting a key anywhere.

    Equal values count as one row. Distinct values are dealt into cells of about equal depth; only the one or
    two cells that hold the wanted order statistics are ordered, whatever the distribution.
    """
    v = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    counted = v.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    totals = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    placed = equi_depth_cells(counted, keys, "v").join(totals, keys)
    cells = placed.groupBy(*keys, "cell").agg(F.sum("c").alias("m"))
    run = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("before", F.sum("m").over(run) - F.col("m"))
    position = (F.col("n") - 1) * F.lit(quantile)
    first, second = F.floor(position), F.ceil(position)
    need = placed.join(cells, [*keys, "cell"]).where(
        ((first >= F.col("before")) & (first < F.col("before") + F.col("m")))
        | ((second >= F.col("before")) & (second < F.col("before") + F.col("m")))
    )
    inner = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = need.withColumn("upto", F.col("before") + F.sum("c").over(inner))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("v")))
    found = ranked.groupBy(*keys).agg(
        at(first).alias("a"), at(second).alias("b"), F.max(position - first).alias("part"))
    return found.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def fit_scaling(rows: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: imputed value (median), center, and scale (MAD, 1 where it is 0).

    Filling gaps with the median does not move the median, so one median serves as both.
    """
    values = long_form(rows, features)
    center = exact_quantiles(values, ["feature"]).withColumnRenamed("quantile", "center")
    filled = values.join(F.broadcast(center), "feature").withColumn(
        "away", F.abs(F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.col("center")) - F.col("center")))
    mad = exact_quantiles(filled, ["feature"], value="away").withColumnRenamed("quantile", "mad")
    return center.join(mad, "feature").withColumn("scale", F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0))


def apply_scaling(rows: DataFrame, scaling: DataFrame, features: list[str]) -> DataFrame:
    """Scaled columns. The scaling table has one row per feature and becomes literals."""
    known = {r["feature"]: r for r in scaling.collect()}

    def scaled(name: str) -> Column:
        r = known[name]
        filled = F.coalesce(F.when(~F.isnan(name), F.col(name)), F.lit(r["center"]))
        return (filled - F.lit(r["center"])) / F.lit(r["scale"])

    return rows.withColumns({f: scaled(f) for f in features})
