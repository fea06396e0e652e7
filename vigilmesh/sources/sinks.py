"""Exports: quoted CSV series, JSON-line artifacts, dead letters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_cells(df: DataFrame) -> list[Column]:
    """Every column as export text, nested fields as JSON; a null stays null."""
    cells = []
    for field in df.schema.fields:
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        text = F.to_json(field.name) if nested else F.col(field.name).cast("string")
        cells.append(text.alias(field.name))
    return cells


def csv_lines(df: DataFrame) -> Column:
    """One RFC 4180 line: cells quoted, inner quotes doubled. Null is nothing at all, an empty text is ``""``."""
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in csv_cells(df)]
    return F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in quoted])


def write_csv(df: DataFrame, path: str) -> None:
    """Lines of ``csv_lines`` with CRLF ends; every file, that is every task's rows, begins with the quoted names."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def with_header(batches):
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    lines = df.select(csv_lines(df).alias("line"))
    lines.mapInArrow(with_header, "line string").write.mode("errorifexists").option("lineSep", "\r\n").text(path)


def json_lines(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def append_dead_letters(batch: DataFrame, batch_id: int, path: str) -> None:
    """``foreachBatch`` sink. A replayed batch overwrites its own folder, so restarts write nothing twice."""
    (
        batch.write.mode("overwrite")
        .partitionBy("reason_code")
        .parquet(f"{path}/batch_id={batch_id}")
    )
