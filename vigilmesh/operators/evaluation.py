"""Detection quality: confusion counts and rates, overall and per slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh.functions.arithmetic import divide


def confusion(truth: Column, prediction: Column) -> list[Column]:
    return [
        F.count_if(truth & prediction).alias("tp"),
        F.count_if(~truth & prediction).alias("fp"),
        F.count_if(~truth & ~prediction).alias("tn"),
        F.count_if(truth & ~prediction).alias("fn"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    c = F.col
    precision = divide(c("tp"), c("tp") + c("fp"))
    recall = divide(c("tp"), c("tp") + c("fn"))
    return (
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", divide(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn")))
        .withColumn("fp_per_1000", divide(c("fp") * 1000, c("fp") + c("tn")))
    )


def sliced(rows: DataFrame, truth: Column, prediction: Column, slices: list[str]) -> DataFrame:
    """Overall and per-slice counts in one pass of grouping sets: one shuffle for all slices."""
    sets = [[]] + [[F.col(s)] for s in slices]
    counted = rows.groupingSets(sets, *[F.col(s) for s in slices]).agg(
        *confusion(truth, prediction), F.grouping_id(*[F.col(s) for s in slices]).alias("gid")
    )
    width = len(slices)
    name = F.lit("ALL")
    value = F.lit("ALL")
    for i, s in enumerate(slices):
        hit = F.col("gid") == (2**width - 1 - 2 ** (width - 1 - i))
        name = F.when(hit, F.lit(s)).otherwise(name)
        value = F.when(hit, F.col(s)).otherwise(value)
    return rates(counted.select(name.alias("slice"), value.alias("slice_value"), "tp", "fp", "tn", "fn"))
