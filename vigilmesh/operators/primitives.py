"""Native primitives of single slots, and their replay-safe rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmesh.functions.arithmetic import percent


def replay_safe_ratio(offers: DataFrame, keys: list[str], slot: str, expected_slots: int) -> DataFrame:
    """Ratio per scope from slots that may arrive several times.

    Exact copies count once; a slot offered with different content is a conflict and contributes
    nothing. Copies collapse by content first, so a slot copied millions of times shuffles as one row.
    """
    contents = offers.groupBy(*keys, slot, "numerator", "denominator").agg(F.count("*").alias("copies"))
    slots = contents.groupBy(*keys, slot).agg(
        F.sum("copies").alias("copies"),
        F.count("*").alias("kinds"),
        F.max("numerator").alias("numerator"),
        F.max("denominator").alias("denominator"),
    )
    single = F.col("kinds") == 1
    rolled = slots.groupBy(*keys).agg(
        F.count_if(single).alias("present_slots"),
        F.sum(F.col("copies") - F.col("kinds")).alias("duplicate_inputs"),
        F.count_if(~single).alias("conflicting_slots"),
        F.sum(F.when(single, F.col("numerator"))).alias("numerator"),
        F.sum(F.when(single, F.col("denominator"))).alias("denominator"),
    )
    return rolled.withColumn("value", percent(F.col("numerator"), F.col("denominator"))).withColumn(
        "slot_coverage", F.col("present_slots") / F.lit(expected_slots)
    )
