"""Pages of ordered results: TakeOrdered, never a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """Rows of one page with ``position``, and ``has_next`` from one extra row."""
    rows = df.orderBy(*order).limit(offset + size + 1)
    from pyspark.sql import Window

    # The window sees at most offset + size + 1 rows.
    numbered = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    window = numbered.where((F.col("position") > offset) & (F.col("position") <= offset + size + 1))
    more = F.max("position").over(Window.partitionBy()) > offset + size
    return window.withColumn("has_next", more).where(F.col("position") <= offset + size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))
