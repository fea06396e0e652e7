"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is how often its documents are taken: the whole part for each of them, the
fraction as an inclusion probability. The cube method turns probabilities into decisions while it keeps sums: as
long as three documents are undecided, some direction changes their probabilities without changing the number of
documents nor the number of tokens expected from them; the vector moves along it, up or down at random with the
chances that keep expectations, until one of them is decided. Blocks of a source do this side by side and hand their few
undecided documents on, with the probabilities they have now; the next level meets them in fewer blocks, until
one block per source is left, whose last two documents land by a draw.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilmesh.llm.common import WORD, stored

#: Documents of a block. A block hands on two of them at most, so each level is 2 / BLOCK of the one before.
BLOCK = 4096
EPSILON = 1e-9


def flight(probability: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: 0 or 1 but for as many as balance has columns, all sums of balance kept."""
    p = probability.astype(float).copy()
    width = balance.shape[1] + 1
    draws = iter(rng.random(2 * len(p) + 8))
    held: list[int] = []
    for at in range(len(p)):
        if EPSILON < p[at] < 1 - EPSILON:
            held.append(at)
        if len(held) < width:
            continue
        _move(p, balance, held, next(draws))
        held = [i for i in held if EPSILON < p[i] < 1 - EPSILON]
    # Fewer than width are left; they may still be dependent, as with equal sizes.
    while len(held) > 1 and _move(p, balance, held, next(draws)):
        held = [i for i in held if EPSILON < p[i] < 1 - EPSILON]
    decided = (p <= EPSILON) | (p >= 1 - EPSILON)
    p[decided] = np.round(p[decided])
    return p


def _move(p: np.ndarray, balance: np.ndarray, held: list[int], draw: float) -> bool:
    """One step along the null space of the held rows, or False if there is none."""
    if len(held) == 3 and balance.shape[1] == 2:
        (a, x), (b, y), (c, z) = balance[held]
        u = np.array([b * z - c * y, c * x - a * z, a * y - b * x])
        if not np.abs(u).max() > 0:  # all three dependent: any two of them have a direction
            u = np.array([b, -a, 0.0])
            if not np.abs(b * x - a * y) == 0:
                return False
    else:
        matrix = balance[held].T
        scale = np.abs(matrix).max(1)
        _, values, rows = np.linalg.svd(matrix / np.where(scale > 0, scale, 1)[:, None])
        if len(held) <= len(values) and values[-1] > 1e-9:
            return False
        u = rows[-1]
    u = u / np.abs(u).max()
    now = p[held]
    with np.errstate(divide="ignore"):
        up = np.where(u > 1e-12, (1 - now) / u, np.where(u < -1e-12, -now / u, np.inf)).min()
        down = np.where(u > 1e-12, now / u, np.where(u < -1e-12, (now - 1) / u, np.inf)).min()
    step = up if draw < down / (up + down) else -down
    now = now + step * u
    limit = np.argmin(np.minimum(np.abs(now), np.abs(1 - now)))
    now[limit] = np.round(now[limit])
    p[held] = np.clip(now, 0, 1)
    return True


def sizes(documents: DataFrame, id_column="doc_id", source_column="source", text_column="text") -> DataFrame:
    """doc_id, source and size, the words of the text (0 if null)."""
    return documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """source, source_size and target: share of all sizes by weight, none above most times its source.

    Sources weigh by their rank in code points, null last, the weights repeating. What a source cannot take is
    reshared among the others by weight until all fit: each source gets the lesser of its limit and its weight
    times one common level, which lies between the limits-to-weight ratios of two sources in that order.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * most
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    below = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        totals.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(whole) * share)
        .withColumn("level", level)
        # The level rises up to the first source that it does not fill and falls behind it: that one sets it for all.
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "target")
    )


def mix(documents: DataFrame, seed: int = 11, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, **columns) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (of its source), copies and taken (words taken).

    Each source's taken words meet its target within the size of a few documents, and so does its number of
    documents that of the target's share. A document is taken floor or ceil of target over source size times.
    Null texts have size 0 and are taken like others; a null source is a source; repeated rows count each; an
    empty table gives an empty result. The draw depends on ids, sources and sizes only, so reruns agree.
    """
    sized = stored(sizes(documents, **columns))
    aims = targets(sized, share, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = stored(
        sized.join(aims, sized["source"].eqNullSafe(aims["source"]), "left").drop(aims["source"])
        .withColumn("whole", F.floor(rate + EPSILON)).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
        # Repeated rows are told apart by their number: they are alike, so which is which does not matter.
        .groupBy("doc_id", "source", "size", "source_size", "target", "whole", "p").agg(F.count("*").alias("times"))
        .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
    )
    kind = rows.schema["source"].dataType.simpleString()
    schema = f"source {kind}, doc_id long, time long, size long, p double"

    def blocks_of(last: bool, level: int):
        def block(group: pa.Table) -> pa.Table:
            group = group.drop(["block"]).sort_by([("size", "ascending"), ("doc_id", "ascending"), ("time", "ascending")])
            ids = group.column("doc_id").fill_null(-1).to_numpy()
            key = f"{seed}/{level}/{group.column('source')[0].as_py()}/{ids.min()}/{len(ids)}"
            rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little"))
            # In random order the few that remain are of any size.
            order = rng.permutation(len(ids))
            p = group.column("p").to_numpy()[order]
            size = group.column("size").to_numpy()[order].astype(float)
            p = flight(p, np.stack([np.ones(len(p)), size], 1), rng)
            if last:
                held = np.flatnonzero((p > 0) & (p < 1))
                # Landing: drop the token constraint first, then the number's fraction; the largest document is drawn last.
                for i in held[np.argsort(size[held])]:
                    draw = rng.random() < p[i]
                    p[i] = float(draw)
            back = np.empty(len(p))
            back[order] = p
            return group.set_column(group.schema.get_field_index("p"), "p", pa.array(back))

        return block

    open_rows = rows.where("p > 0").select("source", "doc_id", "time", "size", "p")
    done, level = [], 0
    while True:
        per_source = open_rows.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        last = (per_source.agg(F.max("blocks")).first()[0] or 0) <= 1
        blocks = F.col("blocks")
        dealt = open_rows.join(F.broadcast(per_source.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "time", F.lit(level)), blocks)).select("source", "doc_id", "time", "size", "p", "block")
        moved = stored(dealt.groupBy("source", "block").applyInArrow(blocks_of(last, level), schema))
        done.append(moved.where("p = 0 OR p = 1"))
        if last:
            break
        open_rows = moved.where("p > 0 AND p < 1")
        level += 1
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionAll(more)
    decided = decided.where("p = 1").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("time").alias("t"), F.col("size").alias("z"), F.lit(1).alias("extra"))
    joined = rows.join(
        decided,
        F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("time") == F.col("t")) & (F.col("size") == F.col("z")),
        "left",
    )
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
