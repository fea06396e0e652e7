"""Streaming queries, one per materialised table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilmesh.operators import windows
from vigilmesh.operators.ingest import is_late
from vigilmesh.sources import observations, sinks
from vigilmesh.streaming.stateful import LATENESS


def timely_receipts(envelopes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Valid receipts that arrived in time, without exact replays. Stateless but for the replay filter."""
    checked = observations.validate(envelopes, catalogue)
    receipts = observations.receipts(checked.where(F.col("reason").isNull())).where(~is_late())
    return receipts.withWatermark("window_end", LATENESS).dropDuplicatesWithinWatermark(["event_id", "content_hash"])


def closed_windows(receipts: DataFrame, catalogue: DataFrame, nodes: list[str], service_fields: list[str],
                   node_fields: list[str]) -> DataFrame:
    """Finalized windows, each emitted once when the watermark passes its closure.

    The newest window stays open until later event time arrives; a batch run over the receipts table
    flushes it.
    """
    flat = receipts.select("*", *[F.col(f"metrics.{f}").alias(f) for f in [*service_fields, *node_fields]])
    return windows.finalize(windows.approve_nodes(flat, catalogue), nodes, service_fields, node_fields)


def bucket_counts(receipts: DataFrame) -> DataFrame:
    """Accepted receipts per window; for update mode."""
    return windows.bucket_counts(receipts)


def source_state(receipts: DataFrame) -> DataFrame:
    """Newest activity per source; for update mode."""
    return windows.source_state(receipts)


def write_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_dead_letters(envelopes: DataFrame, catalogue: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rejected envelopes to a table partitioned by batch and reason; a replayed batch replaces itself."""
    rejected = observations.dead_letters(observations.validate(envelopes, catalogue).where(F.col("reason").isNotNull()))
    return (
        rejected.writeStream.foreachBatch(lambda batch, batch_id: sinks.append_dead_letters(batch, batch_id, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def observed(df: DataFrame, name: str = "ingest") -> DataFrame:
    """Counters of a checked stream, readable from its progress reports."""
    return df.observe(
        name, F.count("*").alias("deliveries"), F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid"))
