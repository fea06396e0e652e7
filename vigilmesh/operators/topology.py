"""Containment, valid-time inventory and temporal version resolution of configured topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 5


def _followed(chains: DataFrame, above: DataFrame, complete: int, depth: int) -> DataFrame:
    """Each chain of ``complete`` nodes followed by the chain above it, up to the first node that it holds already, cut at ``depth``."""
    ids = lambda up: F.transform(up, lambda x: x["id"])
    further = above.select(F.col("node_id").alias("above_id"), F.col("up").alias("further"))
    joined = chains.withColumn("next", F.element_at("up", -1)["parent"]).join(further, F.col("next") == F.col("above_id"), "left")
    met = F.array_compact(F.transform("further", lambda x, i: F.when(F.array_contains(ids("up"), x["id"]), i)))
    taken = F.slice("further", F.lit(1), F.coalesce(F.get(met, F.lit(0)), F.size("further")))
    # A chain that is shorter has ended before.
    ended = F.col("further").isNull() | (F.size("up") < complete)
    grown = F.when(ended, F.col("up")).otherwise(F.slice(F.concat("up", taken), 1, depth))
    return joined.select("node_id", grown.alias("up"))


def ancestry(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Path root → node of every node, at most ``depth`` levels and never through a cycle.

    Pointer doubling over the nodes that contain others: each round a chain is followed by the chain of the node above it, so
    that rounds grow with the logarithm of the depth; every node is then put below its parent's chain, in one join.
    ``complete`` means that the path ends in a parentless country. A node whose parent is unknown keeps the path it has. Node ids
    are unique; a null id has a path of itself only. A parent with a third of all nodes is one row of its side, and adaptive
    execution splits the long partition.
    """
    link = F.struct(F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), F.col("node_type").alias("type"))
    chains = nodes.select("node_id", F.array(link).alias("up"))
    holders = nodes.select(F.col("parent_id").alias("holder")).where("holder IS NOT NULL").distinct()
    # One exchange, which all rounds share.
    inner = chains.join(holders, F.col("node_id") == F.col("holder"), "left_semi").repartition("node_id")
    reach = 1
    while reach < depth - 1:
        inner = _followed(inner, inner, reach, depth)
        reach *= 2
    chains = _followed(chains, inner, 1, depth) if depth > 1 else chains
    top = F.element_at("up", -1)
    return chains.select(
        "node_id", F.reverse(F.transform("up", lambda x: x["id"])).alias("path"),
        (top["parent"].isNull() & F.coalesce(top["type"] == "COUNTRY", F.lit(False))).alias("complete"))


def resolve_location(incidents: DataFrame, coverage: DataFrame, versions: DataFrame, bindings: DataFrame) -> DataFrame:
    """City of each incident through the catalogue version its opening window was captured under.

    Where the window's coverage names exactly one catalogue version, only that one counts; without
    coverage all versions of the topology compete. More than one match is ambiguity, not a choice.
    """
    named = coverage.groupBy("scope_id", "window_start", "topology_version").agg(
        F.min("catalogue_version").alias("cov_lo"), F.max("catalogue_version").alias("cov_hi"))
    keyed = incidents.join(
        named.withColumnsRenamed({"window_start": "opening_start"}), ["scope_id", "opening_start", "topology_version"], "left")
    coverage_matches = (
        F.when(F.col("cov_lo").isNull(), 0).when(F.col("cov_lo") == F.col("cov_hi"), 1).otherwise(2)
    )
    keyed = keyed.withColumn("coverage_matches", coverage_matches)
    # Bindings per (topology, scope, service): configuration rows.
    options = versions.join(bindings, "catalogue_version").select(
        "topology_version", F.col("catalogue_version").alias("b_version"), "scope_id", "service", "node_id", "legacy")
    # No row from the left join carries a version when nothing matched, so the count stays zero.
    j = keyed.join(options, ["topology_version", "scope_id", "service"], "left")
    allowed = F.col("b_version").isNotNull() & (
        (F.col("coverage_matches") == 0) | ((F.col("coverage_matches") == 1) & (F.col("b_version") == F.col("cov_lo"))))
    rest = [c for c in incidents.columns if c != "episode_id"]
    resolved = j.groupBy("episode_id").agg(
        *[F.any_value(c).alias(c) for c in (*rest, "coverage_matches")],
        F.count_if(allowed).alias("matches"),
        F.min_by(F.struct("b_version", "node_id", "legacy"), F.when(allowed, F.col("b_version"))).alias("b"),
    )
    single = F.col("matches") == 1
    return resolved.select(
        "episode_id", *rest, "coverage_matches", "matches",
        F.when(single, F.col("b.b_version")).alias("catalogue_version"),
        F.when(single, F.col("b.node_id")).alias("node_id"),
        F.when(single, F.col("b.legacy")).alias("legacy"),
    )


def location_reason(complete: Column) -> Column:
    return (
        F.when(F.coalesce("legacy", F.lit(False)), "UNALLOCATED")
        .when(F.col("topology_version").isNull() | (F.col("topology_version") == ""), "CAPTURED_VERSION_MISSING")
        .when(F.col("coverage_matches") > 1, "AMBIGUOUS_CATALOGUE_VERSION")
        .when(F.col("matches") == 0, "BINDING_NOT_FOUND")
        .when(F.col("matches") > 1, "AMBIGUOUS_CATALOGUE_VERSION")
        .when(~F.coalesce(complete, F.lit(False)), "INVALID_CONTAINMENT")
    )


def inventory_at(inventory: DataFrame, at: Column, endpoint: Column | None = None) -> DataFrame:
    """Inventory rows valid at an instant, optionally only links that end in one city."""
    rows = inventory.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return rows if endpoint is None else rows.where((F.col("a") == endpoint) | (F.col("b") == endpoint))
