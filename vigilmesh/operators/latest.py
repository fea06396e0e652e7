"""Newest-row and uniqueness selections as aggregates: partial results merge before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmesh.operators.ranks import equi_depth_cells


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("r")).select(*keys, "r.*")


def oldest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("r")).select(*keys, "r.*")


def unambiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of candidate rows, and the row itself only when it is the single one."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count("*").alias("matches"), F.any_value(F.struct(*rest)).alias("r"))
    single = F.col("matches") == 1
    return counted.select(*keys, "matches", *[F.when(single, F.col(f"r.{c}")).alias(c) for c in rest])


def empirical_rank(
    scored: DataFrame, calibration: DataFrame, value: str, keys: list[str] | None = None
) -> DataFrame:
    """``rank`` = share of calibration values not above each scored value, per key.

    Equal values collapse first. Distinct values fall into cells of about equal depth; whole cells below
    contribute their totals, and only one cell's distinct values are ever ordered together.
    """
    if not keys:
        one = F.lit(1)
        ranked = empirical_rank(scored.withColumn("_all", one), calibration.withColumn("_all", one), value, ["_all"])
        return ranked.drop("_all")
    distinct = (
        calibration.groupBy(*keys, value).agg(F.count("*").alias("c"))
        .unionByName(scored.select(*keys, value).distinct().withColumn("c", F.lit(0)))
        .groupBy(*keys, value).agg(F.sum("c").alias("c"))
    )
    distinct = equi_depth_cells(distinct, keys, value)
    group = Window.partitionBy(*keys)
    totals = distinct.groupBy(*keys, "cell").agg(F.sum("c").alias("n"))
    below = totals.select(
        *keys, "cell",
        (F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("below"),
        F.sum("n").over(group).alias("total"),
    )
    within = Window.partitionBy(*keys, "cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.select(*keys, "cell", value, F.sum("c").over(within).alias("upto")).join(below, [*keys, "cell"])
    rank = F.try_divide((F.col("below") + F.col("upto")).cast("double"), F.col("total").cast("double"))
    return scored.join(ranked.select(*keys, value, rank.alias("rank")), [*keys, value], "left")


def rank_of(column: Column, order: list[str]) -> Column:
    """Position of an enumerated text in ``order``; null when it is not listed."""
    expr = F.lit(None).cast("int")
    for i, name in enumerate(order):
        expr = F.when(column == name, F.lit(i)).otherwise(expr)
    return expr
