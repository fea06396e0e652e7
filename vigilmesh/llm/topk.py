"""Exact top-k inner products by the threshold algorithm.

Candidates are dealt into blocks. A block keeps one list per dimension, sorted by that coordinate. A query
walks all lists at once, each from the end that its own coordinate favours, scores every row it meets in
full, and stops once the sum of the coordinates at its depth, the most an unseen row can reach, is below
its k-th score. The k best of each block then meet per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192
QUERY_BLOCK = 1024


def finite(vector):
    """True if the vector is there and so is each component, as a finite number."""
    return F.coalesce(
        F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)
    )


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, row id, score) of the k best rows of a block for each query, ties to the smaller id."""
    by_id = np.argsort(ids, kind="stable")
    ids, rows = ids[by_id], rows[by_id]
    n, dims = rows.shape
    order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
    lists = np.take_along_axis(rows, order, 0)
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    # Products in doubles are exact, and fast, while every partial sum is below 2^53.
    scored = rows.astype(np.float64) if largest < 2.0**53 else rows
    out = ([], [], [])
    for query_id, query in zip(query_ids, queries):
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weights = query.astype(scored.dtype)
        seen = np.zeros(n, bool)
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, 8
        while depth < n:
            reach = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[order[n - reach : n - depth, up].ravel()] = True
            fresh[order[depth:reach, down].ravel()] = True
            if depth == 0 and not len(up) and not len(down):
                fresh[:] = True  # a zero query: every row scores 0
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            best = np.concatenate([best, new])
            scores = np.concatenate([scores, (scored[new] @ weights).astype(np.int64)])
            own = ids[best] != query_id
            best, scores = best[own], scores[own]
            top = np.lexsort((ids[best], -scores))[:k]
            best, scores = best[top], scores[top]
            depth, step = reach, step * 2
            bound = int((query[up] * lists[n - depth, up]).sum() + (query[down] * lists[depth - 1, down]).sum())
            if len(best) == k and bound < scores[-1] or not len(up) and not len(down):
                break
        out[0].append(np.full(len(best), query_id))
        out[1].append(ids[best])
        out[2].append(scores)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other rows, over all rows.

    A component x counts as floor(scale * x). Vectors that are null or hold null or non-finite components
    and rows without an id take no part; only vectors of equal length meet. Of rows that share an id one
    counts, that with the smallest vector. Scores are 64-bit integers; ties go to the smaller id. A query
    with fewer partners returns them all; an empty table returns no row. Other columns are not read.
    """
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
        .where(F.col("id").isNotNull() & finite("vector"))
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
        .withColumn("dims", F.size("vector"))
    )
    is_query = F.coalesce(is_query(F.col("id")), F.lit(False))
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    deal = F.xxhash64("id")

    def every(count: int):
        return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))

    # Every candidate block meets every block of queries: the stated query set against all rows.
    candidates = rows.select(
        "dims", F.pmod(deal, F.lit(blocks)).alias("block"),
        F.explode(every(query_blocks)).alias("query_block"),
        F.lit(False).alias("asks"), "id", "vector",
    )
    queries = rows.where(is_query).select(
        "dims", F.explode(every(blocks)).alias("block"),
        F.pmod(deal, F.lit(query_blocks)).alias("query_block"), F.lit(True).alias("asks"), "id", "vector",
    )

    def cell(group: pa.Table) -> pa.Table:
        values = np.floor(matrix(group.column("vector")) * scale).astype(np.int64)
        ids, asks = group.column("id").to_numpy(), group.column("asks").to_numpy()
        found = search_block(ids[~asks], values[~asks], ids[asks], values[asks], k)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), found)})

    found = (
        candidates.unionAll(queries)
        .groupBy("dims", "block", "query_block")
        .applyInArrow(cell, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
