"""Connected components of a link table, distributed: no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmesh.llm.common import cut_lineage


def _minimum(pairs: DataFrame) -> DataFrame:
    """Smallest partner per u; partial minima meet, so a hub is one row per task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Partners above u move from u to u's smallest partner."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """u and its partners below it move to the smallest of them. Expects v < u."""
    least = _minimum(links)
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link (u, v), component being the smallest node reachable.

    Alternating stars: large ones halve the distance to the smallest node, small ones fold equals; the
    number of rounds grows with the logarithm of the nodes. A null end or a link to oneself is no link. An
    empty table gives an empty one. Each round is cut through the shared checkpoint folder; only a count
    and a checksum reach the driver.
    """
    links = (
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = cut_lineage(links)
    before = None
    for _ in range(rounds):
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("sum")).first()
        if row.n == 0 or (row.n, row["sum"]) == before:
            break
        before = (row.n, row["sum"])
        links = cut_lineage(_small_star(_large_star(links)))
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
