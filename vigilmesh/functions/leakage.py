"""Guard against evaluation truth reaching a detector's inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilmesh import policies


def is_truth_name(name: str) -> bool:
    if name in policies.TRUTH_ALLOWED:
        return False
    letters = re.sub("[^a-z]", "", name.lower())
    return any(fragment in letters for fragment in policies.TRUTH_FRAGMENTS)


def truth_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of truth-like fields anywhere in a schema."""
    found: list[str] = []
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            path = f"{prefix}.{field.name}" if prefix else field.name
            if is_truth_name(field.name):
                found.append(path)
            found += truth_paths(field.dataType, path)
    elif isinstance(kind, T.ArrayType):
        found += truth_paths(kind.elementType, prefix + "[]")
    elif isinstance(kind, T.MapType):
        found += truth_paths(kind.valueType, prefix + "{}")
    return found


def reject_truth(df: DataFrame) -> DataFrame:
    paths = truth_paths(df.schema)
    if paths:
        raise ValueError(f"detector input carries evaluation truth: {', '.join(paths)}")
    return df


def json_has_truth(text: Column) -> Column:
    """True when the document has a truth-like key at any depth: every ``"name":`` token is checked."""
    allowed = "|".join(policies.TRUTH_ALLOWED)
    keys = F.regexp_extract_all(text, F.lit(r'"([^"\\]+)"\s*:'), 1)
    pattern = "|".join(policies.TRUTH_FRAGMENTS)

    def bad(key: Column) -> Column:
        letters = F.regexp_replace(F.lower(key), "[^a-z]", "")
        return ~key.rlike(f"^({allowed})$") & letters.rlike(pattern)

    return F.exists(keys, bad)
