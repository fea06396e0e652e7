"""Retention: which receipts may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh.operators.intervals import interval_join


def expired_receipts(tables: dict[str, DataFrame], cutoff: Column) -> DataFrame:
    """Receipts past the horizon whose window is final, evaluated, delivered, and used by nothing else.

    A chain of semi and anti joins; each right side is reduced to its keys.
    """
    t = tables
    window = ["scope_id", "window_start"]
    final = t["buckets"].where(F.col("finalized") & (F.col("finalized_at") < cutoff)).select(*window)
    delivered = (
        t["features"]
        .join(t["evaluated"].select("window_id"), "window_id", "left_semi")
        .join(t["delivered"].where("published").select("window_id"), "window_id", "left_semi")
        .join(t["open_jobs"].select("window_id"), "window_id", "left_anti")
        .select(*window)
    )
    kept = t["receipts"].where(F.col("received_at") < cutoff)
    kept = kept.join(final, window, "left_semi").join(delivered, window, "left_semi")
    kept = kept.join(t["source_state"].select(F.col("last_event_id").alias("event_id")), "event_id", "left_anti")
    for name in ("unpublished_scopes", "active_episodes"):
        kept = kept.join(t[name].select("scope_id"), "scope_id", "left_anti")
    instant = F.col("window_start")
    after = instant + F.expr("INTERVAL 1 MICROSECOND")
    return interval_join(
        kept, t["protected_ranges"], [], instant, after, "range_from", "range_to", "left_anti", contain=False
    )
