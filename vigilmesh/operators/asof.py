"""As-of lookups that split a hot key over time.

A plain "union, sort per key, carry the last value" puts every row of a key into one task. Here the
sort unit is (key, period): what a period inherits is aggregated first (one row per key and period),
carried over the periods, and re-enters each period as its first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    period_seconds: int = 86_400,
    inclusive: bool = True,
) -> DataFrame:
    """Each left row with ``found``: the newest right row of its keys at (or strictly before) its time."""
    columns = left.columns

    def period(name: str) -> Column:
        return F.floor(F.unix_seconds(F.col(name)) / period_seconds)

    packed = F.struct(F.col(right_ts), *[F.col(v) for v in values])
    facts = right.select(*keys, F.col(right_ts).alias("_at"), period(right_ts).alias("_p"), packed.alias("_r"))
    probes = left.select("*", F.col(left_ts).alias("_at"), period(left_ts).alias("_p"))

    newest = facts.groupBy(*keys, "_p").agg(F.max_by("_r", "_at").alias("_r"))
    spans = (
        newest.unionByName(probes.groupBy(*keys, "_p").agg(F.lit(None).alias("_none")), allowMissingColumns=True)
        .groupBy(*keys, "_p").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), 1)).alias("_r"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_p", F.last("_r", ignorenulls=True).over(earlier).alias("_r")).where(
        F.col("_r").isNotNull()
    )

    # Side 0 sorts before probes of the same instant, side 2 after them (strict lookup).
    side = 0 if inclusive else 2
    probe = F.struct(*[F.col(c) for c in columns]).alias("_l")
    rows = (
        facts.select(*keys, "_p", "_at", F.lit(side).alias("_side"), "_r")
        .unionByName(carried.select(*keys, "_p", F.lit(None).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), "_r"))
        .unionByName(probes.select(*keys, "_p", "_at", F.lit(1).alias("_side"), probe), allowMissingColumns=True)
    )
    order = Window.partitionBy(*keys, "_p").orderBy(F.col("_at").asc_nulls_first(), "_side")
    return (
        rows.withColumn("found", F.last("_r", ignorenulls=True).over(order))
        .where("_side = 1")
        .select("_l.*", "found")
    )


def latest_at(facts: DataFrame, keys: list[str], ts: str, at: Column, values: list[str]) -> DataFrame:
    """Newest row per key at one instant: an aggregate, so nothing is sorted and partials merge early."""
    return facts.where(F.col(ts) <= at).groupBy(*keys).agg(F.max_by(F.struct(ts, *values), ts).alias("found"))
