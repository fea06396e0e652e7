"""Row identities and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identity(*parts) -> Column:
    """sha256 of the parts joined by ``|``; a null part is an empty string, so positions never shift."""
    columns = [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *columns), 256)


def _sorted_field(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        packed = F.struct(*[_sorted_field(column[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(column.isNotNull(), packed)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(column, lambda item: _sorted_field(item, kind.elementType))
    return column


def canonical_json(df: DataFrame, *names: str) -> Column:
    """JSON text of the named columns with every struct's fields in name order, nulls kept."""
    wanted = sorted(names or df.columns)
    ordered = [_sorted_field(F.col(n), df.schema[n].dataType).alias(n) for n in wanted]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def content_fingerprint(df: DataFrame, *names: str) -> Column:
    return F.sha2(canonical_json(df, *names), 256)
