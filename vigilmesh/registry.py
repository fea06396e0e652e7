"""Named queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from vigilmesh.adapters import Tables


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Registered] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name`` with an optional equivalent SQL text."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Registered(name, build, oracle)
        return build

    return add
