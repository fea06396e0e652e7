"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilmesh.session import cut_lineage, stored

#: White space that separates words, as listed by the contracts.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: Letters, digits and everything outside ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["cut_lineage", "stored"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_letters(column):
    """A-Z to a-z and nothing else: lower() would change letters outside ASCII, some into ASCII."""
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id):
    """True for the rows whose label no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slices(lengths: np.ndarray, budget: int):
    """Runs of rows whose lengths stay near the budget, so that work arrays stay small whatever the batch."""
    start, total = 0, 0
    for row, length in enumerate(lengths):
        if row > start and total + length > budget:
            yield start, row
            start, total = row, 0
        total += int(length)
    if start < len(lengths):
        yield start, len(lengths)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the offsets of each. A null text is an empty one."""
    column = column.fill_null("")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def concat(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def meet_in_cells(rows: DataFrame, key: list[str], id_column: str, block: int, payload: DataFrame | None = None) -> DataFrame:
    """Rows of keys with two or more of them, dealt so that each two rows of a key share exactly one or, within a block, one cell.

    A key with n rows is cut into ceil(n / block) blocks by a hash of the id; a row goes to the cell (lo, hi) of its
    own block, `sub`, with every block of the key. Pairs within a block belong to the cell lo = hi. payload: wide
    columns by id, joined once the cells are known, so that they are shuffled to their cells only.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    blocks = F.ceil(F.col("n_rows") / block).cast("int")
    cells = (
        rows.join(sizes, key)
        .withColumn("sub", F.pmod(F.xxhash64(id_column), blocks).cast("int"))
        .withColumn("with_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"lo": F.least("sub", "with_block"), "hi": F.greatest("sub", "with_block")})
        .drop("with_block", "n_rows")
    )
    if payload is not None:
        cells = cells.join(payload, id_column)
    return cells.repartition(*key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi")


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The stretches of equal keys in sorted batches, each as one table of two rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks()
        changes = np.zeros(len(whole), bool)
        for name in key:
            values = whole.column(name).to_numpy()
            changes[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(changes).tolist()]
        for start, end in zip(starts[:-1], starts[1:]):
            if end - start > 1:
                yield whole.slice(start, end - start).combine_chunks()
        held = whole.slice(starts[-1]).to_batches()
    if held and (last := pa.Table.from_batches(held)).num_rows > 1:
        yield last.combine_chunks()
