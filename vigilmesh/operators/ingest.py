"""De-duplication of deliveries: which one is accepted, and why each other is not.

In arrival order a delivery is a duplicate or an id conflict if its event id was accepted before, a
natural-key conflict if its natural key was, late if its window has closed, and accepted otherwise.
Since only accepted deliveries block others, this is the first-come independent set over two keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.timebins import shift
from vigilmesh.session import cut_lineage

NATURAL = ["scope_id", "source_id", "kind", "window_start"]


def is_late(received: str = "received_at", end: str = "window_end", finalized: Column | None = None) -> Column:
    """Closed by receipt time: at or after the window's end plus the allowed lateness, or already final."""
    late = F.col(received) >= shift(F.col(end), policies.ALLOWED_LATENESS_SECONDS)
    return late if finalized is None else late | finalized


def _groups(deliveries: DataFrame) -> DataFrame:
    """Copies collapse before anything is compared: one row per (id, natural key, content, late)."""
    return deliveries.groupBy("event_id", *NATURAL, "content_hash", "late").agg(F.min("arrival").alias("arrival"))


def _one_key_per_id(groups: DataFrame) -> bool:
    key = F.struct(*NATURAL)
    spread = groups.groupBy("event_id").agg((F.min(key) != F.max(key)).alias("spread"))
    return spread.where("spread").isEmpty()


def accepted(deliveries: DataFrame, single_key: bool | None = None) -> DataFrame:
    """Accepted deliveries, unique by event id and by natural key.

    Where every event id keeps one natural key, the first timely delivery of each key is the answer.
    Otherwise rounds decide it: in each, a row that is first for both its keys wins and removes the
    rows that share a key with it. A round settles every row that has no earlier undecided rival, so
    the number of rounds is the longest chain of rivals.
    """
    groups = _groups(deliveries)
    timely = groups.where(~F.col("late")).drop("late")
    if single_key is None:
        single_key = _one_key_per_id(groups)
    columns = ["event_id", *NATURAL, "content_hash", "arrival"]
    if single_key:
        winner = timely.groupBy(*NATURAL).agg(F.min_by(F.struct("event_id", "content_hash", "arrival"), "arrival").alias("w"))
        return winner.select(*NATURAL, "w.*").select(*columns)
    undecided, won = cut_lineage(timely), None
    while not undecided.isEmpty():
        by_id = undecided.groupBy("event_id").agg(F.min("arrival").alias("first_id"))
        by_key = undecided.groupBy(*NATURAL).agg(F.min("arrival").alias("first_key"))
        marked = undecided.join(by_id, "event_id").join(by_key, NATURAL)
        winners = cut_lineage(
            marked.where((F.col("arrival") == F.col("first_id")) & (F.col("arrival") == F.col("first_key"))).select(*columns)
        )
        won = winners if won is None else won.unionByName(winners)
        undecided = cut_lineage(
            undecided.join(winners.select("event_id"), "event_id", "left_anti")
            .join(winners.select(*NATURAL), NATURAL, "left_anti")
            .select(*columns)
        )
    return timely.select(*columns).limit(0) if won is None else won


def classify(deliveries: DataFrame, single_key: bool | None = None) -> DataFrame:
    """Every delivery with ``outcome``. Expects ``late`` and ``content_hash``.

    The accepted side has one row per key, so a key with a third of all deliveries only makes one
    join partition long, which adaptive execution splits.
    """
    won = accepted(deliveries, single_key)
    by_id = won.select(
        "event_id", F.col("arrival").alias("id_arrival"), F.col("content_hash").alias("id_hash"),
        F.struct(*NATURAL).alias("id_key"),
    )
    by_key = won.select(*NATURAL, F.col("arrival").alias("key_arrival"))
    joined = deliveries.join(by_id, "event_id", "left").join(by_key, NATURAL, "left")
    same = (F.col("id_hash") == F.col("content_hash")) & (F.col("id_key") == F.struct(*NATURAL))
    outcome = (
        F.when(F.col("id_arrival") == F.col("arrival"), "ACCEPTED")
        .when(F.col("id_arrival") < F.col("arrival"), F.when(same, "DUPLICATE").otherwise("EVENT_ID_CONFLICT"))
        .when(F.col("key_arrival") < F.col("arrival"), "NATURAL_KEY_CONFLICT")
        .otherwise("LATE_OBSERVATION")
    )
    return joined.withColumn("outcome", outcome).select(*deliveries.columns, "outcome")


def reconcile_append(new: DataFrame, existing: DataFrame, keys: list[str], content: str) -> DataFrame:
    """INSERT for new keys, REPLAY for identical content, CONFLICT for different content of a known key.

    Among new rows of one unseen key the first content in hash order is inserted and others conflict;
    copies collapse to one row each.
    """
    offers = new.groupBy(*keys, content).agg(F.count("*").alias("copies"))
    first = offers.groupBy(*keys).agg(F.min(content).alias("_first"))
    known = existing.select(*keys, F.col(content).alias("_known"))
    joined = offers.join(first, keys).join(known, keys, "left")
    action = (
        F.when(F.col("_known").isNull() & (F.col(content) == F.col("_first")), "INSERT")
        .when(F.col("_known") == F.col(content), "REPLAY")
        .otherwise("CONFLICT")
    )
    return joined.withColumn("action", action).drop("_first", "_known")
