"""Metric series as CSV in the fixed layout of 39 columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# The columns of a series export, in their order.
COLUMNS = [
    "datasetId", "domain", "metric", "scopeType", "scopeId", "resolution", "requestedFrom", "requestedTo", "effectiveFrom", "effectiveTo",
    "partialStart", "partialEnd", "from", "to", "value", "unit", "coverage", "quality", "numerator", "denominator", "sumValue", "sampleCount",
    "sourceResolutionSeconds", "aggregation", "policyVersion", "topologyVersion", "synthetic", "nullReason", "qualityReason", "expectedSlots",
    "receivedSlots", "sourceQuality", "sourceCoverage", "projectionIds", "provenance", "snapshotAt", "sourceAgeSeconds", "histogramCounts",
    "histogramEdges",
]
#: Cells that hold JSON text; a null one is the text null.
NESTED = {"projectionIds", "provenance", "histogramCounts", "histogramEdges"}
#: What identifies a series; its points follow each other by time.
SERIES = ["datasetId", "metric", "scopeType", "scopeId", "resolution"]


def instant(ts: Column) -> Column:
    """An ISO instant in UTC; fractions of a second only where there are any."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.0+$|(?<=[1-9])0+$", ""), F.lit("Z"))


def _text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return instant(column)
    if isinstance(kind, T.DecimalType):
        return column.cast("string")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def points(df: DataFrame, **constants) -> DataFrame:
    """``df`` in the fixed layout. What it lacks comes from ``constants`` or is null; other columns are left out."""
    out = []
    for name in COLUMNS:
        if name in df.columns:
            out.append(F.col(f"`{name}`"))
        else:
            value = constants.get(name)
            out.append((F.lit(value) if not isinstance(value, datetime) else F.lit(value).cast("timestamp")).alias(name))
    return df.select(*out)


def lines(series: DataFrame) -> Column:
    """One line per point: present cells quoted with inner quotes doubled, absent ones empty, JSON text in nested cells."""
    cells = []
    for field in series.select(*[f"`{c}`" for c in COLUMNS]).schema.fields:
        text = _text(F.col(f"`{field.name}`"), field.dataType)
        if field.name in NESTED:
            text = F.coalesce(text, F.lit("null"))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.coalesce(quoted, F.lit("")))
    return F.concat_ws(",", *cells)


HEADER = ",".join(f'"{c}"' for c in COLUMNS)


def _with_header(series: DataFrame) -> DataFrame:
    """Lines in the order of series and time over all files, the header first in each file.

    Rows are dealt by ranges of series and time, so that a series with a third of all points is several files. The header of a file is
    joined to its first line.
    """
    order = [F.col(f"`{c}`").asc_nulls_first() for c in [*SERIES, "from"]]
    placed = series.repartitionByRange(*order).sortWithinPartitions(*order).select(lines(series).alias("line"), F.monotonically_increasing_id().alias("place"))
    first = F.col("place").bitwiseAND((1 << 33) - 1) == 0
    return placed.select(F.when(first, F.concat(F.lit(HEADER + "\r\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))


def write(series: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files of CRLF lines; names sort in the order of series and time. Without points no line is written, the header neither."""
    _with_header(series).write.mode(mode).option("lineSep", "\r\n").text(path)


def append(batch: DataFrame, batch_id: int, path: str) -> None:
    """``foreachBatch`` sink: each batch is a folder of its own, committed as a whole, and a replayed one replaces itself."""
    write(points(batch), f"{path}/batch_id={batch_id}", "overwrite")


def stream(series: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of points to ``append``."""
    return (
        series.writeStream.foreachBatch(lambda batch, batch_id: append(batch, batch_id, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
