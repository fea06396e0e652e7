"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a fast Walsh-Hadamard transform; its hash is the
axis, with sign, that the rotation brings it closest to. A table's code joins several such hashes. Multiprobe:
besides its own bucket a vector enters those in which the least certain hash takes its next best axis.
Vectors that share a bucket are candidates, and every candidate pair is verified by its cosine in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmesh.llm.common import cut_lineage, meet_in_cells, runs
from vigilmesh.llm.components import components
from vigilmesh.llm.topk import finite, matrix

BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    n, width = x.shape[-1], 1
    while width < n:
        y = x.reshape(*x.shape[:-1], n // (2 * width), 2, width)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        width *= 2
    return x / np.sqrt(n)


def codes(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) bucket codes, the vector's own bucket first."""
    n, dims = unit.shape
    width = 1 << max(1, int(np.ceil(np.log2(max(dims, 2)))))
    padded = np.zeros((n, width))
    padded[:, :dims] = unit
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, probes), np.int64)
    every = np.arange(n)
    for t in range(tables):
        own, other, gap = [], [], []
        for _ in range(hashes):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (3, width)):
                y = hadamard(y * signs)
            size = np.abs(y)
            first = size.argmax(1)
            top = size[every, first]
            size[every, first] = -1
            second = size.argmax(1)
            own.append(2 * first + (y[every, first] < 0))
            other.append(2 * second + (y[every, second] < 0))
            gap.append(top - size[every, second])
        base = 2 * width
        code = np.zeros(n, np.int64)
        for value in own:
            code = code * base + value
        out[:, t, 0] = code
        rank = np.argsort(np.stack(gap, 1), axis=1, kind="stable")
        for p in range(1, probes):
            which = rank[:, p - 1]
            place = base ** (hashes - 1 - which)
            change = np.stack(other, 1)[every, which] - np.stack(own, 1)[every, which]
            out[:, t, p] = code + change * place
    return out


def _pairs(cell, dims, tables, probes, threshold):
    """Verified pairs of one cell as indices (a, b), each pair only in the first bucket it shares."""
    vectors, all_codes = cell["vector"], cell["codes"]
    norms = np.sqrt((vectors * vectors).sum(1))
    cosine = (vectors @ vectors.T) / np.outer(norms, norms)
    near = np.triu(cosine >= threshold, 1)
    if cell["lo"] != cell["hi"]:
        near &= cell["sub"][:, None] != cell["sub"][None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return a, b
    table, code = cell["table"], cell["code"]
    first = np.ones(len(a), bool)
    for t in range(table + 1):
        same = all_codes[a, t, :, None] == all_codes[b, t, None, :]
        if t < table:
            first &= ~same.any((1, 2))
        else:
            shared = np.where(same, all_codes[a, t, :, None], np.iinfo(np.int64).max).min((1, 2))
            first &= shared == code
    return a[first], b[first]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, tables: int = 10, hashes: int = 2, probes: int = 2, seed: int = 7,
    id_column="vec_id", vector_column="embedding", label_column="label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept (vec_id = component_id).

    Vectors of one label link when their cosine reaches the threshold. Vectors that are null, zero, or hold null
    or non-finite components, vectors without a label and rows without an id link with nothing and keep their
    own id as component. Vectors of unlike length never link. Equal vectors are one class: it is hashed
    once, and its links count each member. Rows that share an id are one node of the components. An empty table
    gives an empty result; other columns are not read.

    A bucket is cut into blocks of BLOCK rows and each two blocks meet in a cell of their own, so no task
    holds a whole hot bucket; a cell returns one row per vector, not one per pair. Two hashes of 64 dimensions
    make 16,384 buckets per label and table, three 2 million: with more vectors take more hashes, and more tables for
    the same recall.
    """
    if probes > hashes + 1:
        raise ValueError("a probe changes one hash: probes may not exceed hashes + 1")
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector")
    )
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0)
    )
    classes = rows.where(usable).groupBy("label", "vector").agg(F.count("*").alias("members"), F.min("vec_id").alias("rep"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                values = matrix(part.column("vector"))
                unit = values / np.abs(values).max(1)[:, None]
                unit = unit / np.sqrt((unit * unit).sum(1))[:, None]
                found = codes(unit, tables, hashes, probes, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("rep"), part.column("members"),
                     pa.array([v.tobytes() for v in values], pa.binary()),
                     pa.array([c.tobytes() for c in found], pa.binary()),
                     pa.array(found.reshape(len(values), -1).tolist(), pa.list_(pa.int64()))],
                    names=["label", "rep", "members", "vector", "codes", "buckets"],
                )

    label_type = rows.schema["label"].dataType.simpleString()
    head = f"label {label_type}, rep long, members long, vector binary, codes binary"
    keyed = classes.mapInArrow(hashed, head + ", buckets array<bigint>").select(
        "label", F.length("vector").alias("dims"), "rep", "members", "vector", "codes", F.posexplode("buckets").alias("pos", "code")
    ).withColumn("table", F.floor(F.col("pos") / probes).cast("int")).drop("pos")
    key = ["label", "dims", "table", "code"]
    cells = meet_in_cells(keyed, key, "rep", BLOCK)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(run: pa.Table):
            first = {c: run.column(c)[0].as_py() for c in ("table", "code", "lo", "hi", "dims")}
            joined = [b"".join(run.column(c).to_pylist()) for c in ("vector", "codes")]
            cell = first | {
                "vector": np.frombuffer(joined[0]).reshape(len(run), -1),
                "codes": np.frombuffer(joined[1], np.int64).reshape(len(run), tables, probes),
                "sub": run.column("sub").to_numpy(),
            }
            a, b = _pairs(cell, first["dims"], tables, probes, threshold)
            if not len(a):
                return None
            members, reps = run.column("members").to_numpy(), run.column("rep").to_numpy()
            links = np.zeros(len(run), np.int64)
            np.add.at(links, a, members[b])
            np.add.at(links, b, members[a])
            rank = np.argsort(reps, kind="stable")
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            root = reps[rank[_roots(len(run), place[a], place[b])]][place]
            hit = links > 0
            return run.column("label").combine_chunks().filter(pa.array(hit)), reps[hit], links[hit], root[hit]

        for run in runs(batches, [*key, "lo", "hi"]):
            if found := finish(run):
                yield _batch(found)

    def _batch(found):
        label, reps, links, root = found
        label = label.chunk(0) if isinstance(label, pa.ChunkedArray) else label
        return pa.RecordBatch.from_arrays(
            [label, pa.array(reps), pa.array(links), pa.array(root)], names=["label", "rep", "links", "root"]
        )

    found = cells.mapInArrow(settle, f"label {label_type}, rep long, links long, root long")
    found = cut_lineage(found)
    links = found.groupBy("label", "rep").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    settled = (
        classes.join(links, ["label", "rep"], "left")
        .join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector", F.lit(True).alias("usable"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component"))
    )
    linked = rows.withColumn("usable", usable).join(settled, ["label", "vector", "usable"], "left")
    component = F.coalesce("component", "vec_id")
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
