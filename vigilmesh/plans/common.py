"""How registered queries print doubles and timestamps, so that both engines print the same text.

A plain ``round`` is ambiguous for values that lie exactly between two decimals, which rates of small
integers often do; the offset below is no such midpoint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilmesh.functions.timebins import iso

OFFSET = 0.500012347


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c, name: str | None = None) -> Column:
    """A double with six decimals (none from 1e9 on)."""
    x = col(c).cast("double")
    out = F.when(F.abs(x) >= 1e9, F.floor(x + OFFSET).cast("double")).otherwise(
        F.floor(x * 1e6 + OFFSET).cast("double") / 1e6
    )
    return out.alias(name or c)


def num_sql(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN abs({x}) >= 1e9 THEN floor({x} + {OFFSET}::DOUBLE) "
        f"ELSE floor({x} * 1e6::DOUBLE + {OFFSET}::DOUBLE) / 1e6::DOUBLE END"
    )


def when(c, name: str | None = None) -> Column:
    return iso(col(c)).alias(name or c)


def when_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def bucket_sql(ts: str, seconds: int) -> str:
    return f"(TIMESTAMP '1970-01-01' + to_seconds((CAST(epoch({ts}) AS BIGINT) // {seconds}) * {seconds}))"
