"""Labelled experiment rows and the integrity of their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "service string, runId string, split string, windowStart timestamp, featureNames array<string>, "
    "featureValues array<double>, label string, scenario string, severity int, operatingProfile string"
)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(f"{folder}/{split}.jsonl")


def finite_vector(values, width: int = 6):
    """True when the array has ``width`` finite numbers."""
    return (F.size(values) == width) & F.forall(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )


def split_report(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per split: rows, distinct starts, bad vectors and label presence, against the manifest."""
    bad = ~finite_vector(F.col("values"))
    starts = rows.groupBy("split", "run_id", "window_start").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col("fault") == 1).alias("faults"))
    seen = starts.groupBy("split").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.col("n") - 1).alias("repeated_starts"),
        F.sum("bad").alias("bad_vectors"),
        F.sum("faults").alias("fault_rows"),
        F.min("window_start").alias("first_start"),
        F.max("window_start").alias("last_start"),
    )
    return seen.join(manifest, "split", "full").withColumn(
        "rows_match", F.col("row_count").eqNullSafe(F.col("manifest_rows"))
    )


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """Runs that start before the previous run of their service ended. One row per run."""
    order = Window.partitionBy("service").orderBy("run_from", "run_to")
    reach = F.max("run_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("previous_end", reach).where(F.col("run_from") < F.col("previous_end"))


def missing_combinations(rows: DataFrame, dimensions: dict[str, list[str]]) -> DataFrame:
    """Expected combinations of the listed values that no row has. The lists are configuration."""
    spark = rows.sparkSession
    grid = spark.range(1).select(
        *[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in dimensions.items()]
    )
    for name in dimensions:
        grid = grid.withColumn(name, F.explode(name))
    return grid.join(rows.select(*dimensions).distinct(), list(dimensions), "left_anti")
