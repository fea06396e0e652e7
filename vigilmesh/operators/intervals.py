"""Valid-time joins against interval dimensions.

There is one algorithm at every size. Time is cut into pieces of equal length; a range stands once for each piece
it touches and a fact for the pieces that it touches (the first one is enough where a range has to contain it),
so the join is a plain equality on keys and piece, which shuffles, spills and splits like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
_PIECE, _PIECES, _FROM, _TO = "_piece", "_pieces", "_fact_from", "_fact_to"


def interval_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    fact_from: Column,
    fact_to: Column,
    dim_from: str,
    dim_to: str,
    how: str = "inner",
    contain: bool = True,
    piece: int = DAY,
    open_end: bool = False,
) -> DataFrame:
    """Facts with the dimension rows of their keys whose range contains (or overlaps) the fact's interval.

    ``how`` is inner, left, left_semi or left_anti; inner and left add the dimension's columns other than the
    keys. Intervals are half open and of any length. A null bound matches nothing, but with ``open_end`` a
    range without an end lasts as long as the facts do. ``piece`` is the length of a piece in seconds: near the
    length of the facts it makes many short keys, near that of the ranges few copies.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no such join: {how}")

    def piece_of(instant: Column) -> Column:
        return F.floor(F.unix_seconds(instant) / piece)

    if open_end:  # one row, the latest end of a fact
        latest = facts.agg(F.max(fact_to).alias("_latest"))
        dim = dim.crossJoin(F.broadcast(latest)).withColumn(dim_to, F.coalesce(dim_to, F.greatest("_latest", dim_from))).drop("_latest")
    lo, hi = F.col(f"d.{dim_from}"), F.col(f"d.{dim_to}")
    ranges = dim.where(F.col(dim_from) <= F.col(dim_to)).withColumn(
        _PIECE, F.explode(F.sequence(piece_of(F.col(dim_from)), piece_of(F.col(dim_to))))
    ).alias("d")
    first = piece_of(F.col(_FROM))
    last = first if contain else F.greatest(first, piece_of(F.col(_TO) - F.expr("INTERVAL 1 MICROSECOND")))
    cut = (
        facts.withColumns({_FROM: fact_from, _TO: fact_to})
        .withColumn(_PIECES, last - first + 1)
        .withColumn(_PIECE, first if contain else F.explode_outer(F.sequence(first, last)))
    )
    meets = (F.col(f"d.{_PIECE}") == cut[_PIECE]) & (
        ((lo <= F.col(_FROM)) & (hi >= F.col(_TO))) if contain else ((lo < F.col(_TO)) & (F.col(_FROM) < hi))
    )
    for key in keys:
        meets = meets & (F.col(f"d.{key}") == cut[key])
    columns = [cut[c] for c in facts.columns]
    added = [F.col(f"d.{c}") for c in dim.columns if c not in keys]
    if contain:
        joined = cut.join(ranges, meets, how)
        return joined.select(*columns, *(added if how in ("inner", "left") else []))
    # A pair that shares several pieces counts on the first.
    once = cut[_PIECE] == F.greatest(first, piece_of(lo))
    if how == "inner":
        return cut.join(ranges, meets & once).select(*columns, *added)
    if how == "left":
        apart = interval_join(facts, dim, keys, fact_from, fact_to, dim_from, dim_to, "left_anti", False, piece)
        both = cut.join(ranges, meets & once).select(*columns, *added)
        return both.unionByName(apart, allowMissingColumns=True)
    # The pieces of a fact that met a range, or those that did not, folded back to facts. Equal facts fold
    # into one row: each has every piece in question, so pieces over distinct pieces is their number.
    kept = cut.join(ranges, meets, how).withColumn(_PIECE, F.coalesce(cut[_PIECE], F.lit(0)))
    folded = kept.groupBy(*facts.columns, F.coalesce(_PIECES, F.lit(1)).alias(_PIECES)).agg(
        F.count("*").alias("_rows"), F.size(F.collect_set(_PIECE)).alias("_distinct")
    )
    if how == "left_anti":
        folded = folded.where(F.col("_distinct") == F.col(_PIECES))
    times = F.sequence(F.lit(1).cast("long"), F.expr("_rows DIV _distinct"))
    return folded.select(*facts.columns, F.explode(times).alias("_time")).drop("_time")


def coverage_of_ranges(ranges: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Per key: does the union of ranges contain [start, end), and do any two ranges overlap?

    A key's ranges are its configured validity periods, so the ordered window stays small.
    """
    order = Window.partitionBy(*keys).orderBy("valid_from", "valid_to")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("valid_to").over(before)
    marked = ranges.withColumn("reach", reach).withColumn(
        "starts_island", F.when(F.col("reach").isNull() | (F.col("valid_from") > F.col("reach")), 1).otherwise(0)
    )
    islands = marked.withColumn("island", F.sum("starts_island").over(order)).groupBy(*keys, "island").agg(
        F.min("valid_from").alias("lo"),
        F.max("valid_to").alias("hi"),
        F.count_if(F.col("valid_from") < F.col("reach")).alias("overlap_rows"),
    )
    return islands.groupBy(*keys).agg(
        F.bool_or((F.col("lo") <= start) & (F.col("hi") >= end)).alias("covered"),
        F.sum("overlap_rows").alias("overlap_rows"),
        F.count("*").alias("islands"),
    )
