"""Population arithmetic: aggregate primitives first, divide once, null instead of zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilmesh import policies


def divide(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    """100·n/d, null on an empty population."""
    return F.try_divide(numerator.cast("double") * 100.0, denominator.cast("double"))


def exact(column: Column) -> Column:
    """A counter or rate as a decimal wide enough for cross products."""
    return column.cast("decimal(20,6)")


def safe_counter(column: Column) -> Column:
    """True when the value is a counter JSON can carry without loss."""
    return column.between(0, policies.MAX_SAFE_COUNTER)


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def bin_quantile(bins: Sequence[Column], edges: Sequence[float], twentieths: int = 19) -> Column:
    """Quantile of finite bins held in separate columns."""
    return histogram_quantile(F.array(*[b.cast("bigint") for b in bins]), edges, twentieths)


def histogram_quantile(counts: Column, edges: Sequence[float], twentieths: int = 19) -> Column:
    """Interpolated quantile of an array of finite bins; ``twentieths``/20 is the rank (19: 95th percentile).

    The crossing test multiplies integers, so a rank that falls on a bin edge never flips. Null for
    an empty histogram.
    """
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    start = F.struct(
        F.lit(0).cast("bigint").alias("before"), F.lit(0.0).alias("low"), F.lit(None).cast("double").alias("value")
    )
    cells = F.arrays_zip(counts.alias("n"), F.array(*[F.lit(float(e)) for e in edges]).alias("edge"))

    def step(acc: Column, cell: Column) -> Column:
        n, edge = cell["n"], cell["edge"]
        through = acc["before"] + n
        crossed = acc["value"].isNull() & (n > 0) & (through * 20 >= total * twentieths)
        inside = acc["low"] + divide(total * twentieths - acc["before"] * 20, n * 20) * (edge - acc["low"])
        return F.struct(
            through.alias("before"), edge.alias("low"), F.when(crossed, inside).otherwise(acc["value"]).alias("value")
        )

    return F.aggregate(cells, start, step, lambda acc: acc["value"])


def nearest_rank(values: Column, percent_rank: int = 95) -> Column:
    """Nearest-rank percentile of a row's own array of samples."""
    size = F.size(values)
    position = ((size * percent_rank + 99) / 100).cast("int")
    return F.when(size > 0, F.element_at(F.array_sort(values), F.greatest(position, F.lit(1))))
