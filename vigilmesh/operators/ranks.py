"""Exact nearest-rank percentiles without gathering a group's samples anywhere.

Samples collapse to (value, count) on the map side. A log-linear grid of at most about 3,700 cells
per group locates each rank; only the values of the located cell are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_of(value: Column) -> Column:
    """Monotone cell of a non-negative integer: 64 cells per power of two."""
    power = F.length(F.bin(value)) - 1
    fine = F.call_function("shiftright", value, F.greatest(power - 6, F.lit(0)))
    return F.when(value < 64, value).otherwise(power.cast("bigint") * 64 + (fine - 64)).cast("bigint")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """One row per group: sample count, minimum, maximum and ``p<percent>`` by nearest rank."""
    counts = df.groupBy(*keys, F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("cell", cell_of(F.col("v")))
    cells = counts.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    group = Window.partitionBy(*keys)
    run = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.select(
        *keys, "cell", "n",
        (F.sum("n").over(run) - F.col("n")).alias("before"),
        F.sum("n").over(group).alias("samples"),
        F.min("lo").over(group).alias("min"),
        F.max("hi").over(group).alias("max"),
    )
    wanted = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    rank = F.expr("(percent * samples + 99) DIV 100")
    located = (
        placed.select("*", wanted)
        .withColumn("rank", rank)
        .where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
        .select(*keys, "cell", "percent", "samples", "min", "max", (F.col("rank") - F.col("before")).alias("local"))
    )
    inner = Window.partitionBy(*keys, "cell", "percent").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = counts.select(*keys, "cell", "v", "n").join(located, [*keys, "cell"]).withColumn(
        "through", F.sum("n").over(inner)
    )
    hits = ordered.where(F.col("through") >= F.col("local"))
    picks = [F.min(F.when(F.col("percent") == p, F.col("v"))).alias(f"p{p}") for p in percents]
    return hits.groupBy(*keys).agg(
        F.max("samples").alias("samples"), F.min("min").alias("min"), F.max("max").alias("max"), *picks
    )


CELLS = 512


def equi_depth_cells(distinct: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct values with ``cell``, rising with the value and holding about as many of them each per key.

    Bounds come from an approximate percentile sketch, so neither an outlier nor values that nearly agree
    crowd one cell; a value's cell is exact, as it is found by comparing with the bounds.
    """
    shares = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    bounds = distinct.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, F.lit(10 * CELLS))).alias("_bounds"))
    placed = distinct.join(bounds, keys)
    return placed.withColumn("cell", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
