"""Codes of vectors by one codebook per part, entries found by Orchard's search.

Vectors become integers and are cut into equal parts. Every entry of a codebook keeps the other entries in a list, nearest
first. A search walks the list of the nearest entry so far: a closer one is jumped to, entries met before are marked and not
measured again, and the walk ends where the list is beyond twice the current distance, as no later entry can be
closer. All distances are exact, so a code is that of a search through all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmesh.llm.common import stored
from vigilmesh.llm.topk import finite

SCALE, PARTS, ENTRIES, ROUNDS = 4096.0, 8, 16, 6
#: Integers beyond this are cut to it: sums of so many squares would leave 64 bits anyway.
LARGEST = 1 << 62
#: Rows of a part that are searched side by side.
ROWS = 4096
_END = np.iinfo(np.int64).max


class Codebooks(NamedTuple):
    entries: np.ndarray  # parts x entries x width, integers
    dims: int  # of the vectors; their last part is padded with zeros

    @property
    def sha256(self) -> str:
        """Of all entries' integers in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _fits(largest: float, dims: int) -> bool:
    """True if four times every squared distance of vectors with such components fits into 64 bits."""
    return 16 * dims * float(largest) ** 2 < 2.0**62


def integers(column: pa.Array, parts: int, scale: float) -> np.ndarray:
    """rows x parts x width. Plain 64-bit integers where every distance fits into them, Python's otherwise."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(column), -1)
    width = -(-values.shape[1] // parts)
    values = np.pad(values, ((0, 0), (0, parts * width - values.shape[1]))).reshape(len(column), parts, width)
    if _fits(np.abs(values).max(initial=0), parts * width):
        return values.astype(np.int64)
    exact = [max(-LARGEST, min(LARGEST, int(x))) if np.isfinite(x) else int(np.sign(x)) * LARGEST for x in values.ravel()]
    return np.array(exact, object).reshape(values.shape)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return (difference * difference).sum(-1)


class Lists(NamedTuple):
    """For each entry of one part's codebook the entries by rising distance, itself left out, and these distances."""

    entries: np.ndarray
    order: np.ndarray
    distance: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Lists:
        distance = _distances(entries[:, None, :], entries[None, :, :])
        order = np.stack([sorted((j for j in range(len(entries)) if j != i), key=lambda j, i=i: (distance[i, j], j)) for i in range(len(entries))]).astype(np.int64)
        return Lists(entries, order, np.take_along_axis(distance, order, 1))


def search(lists: Lists, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) nearest to each query, ties to the lower index. Every query walks on its own; all step together."""
    n, k = len(queries), len(lists.entries)
    # Start at the entry whose first component is nearest: any start gives the same answer.
    by_first = np.argsort(lists.entries[:, 0], kind="stable")
    best = by_first[np.minimum(np.searchsorted(lists.entries[by_first, 0], queries[:, 0]), k - 1)]
    nearest = _distances(queries, lists.entries[best])
    marked = np.zeros((n, k), bool)
    marked[np.arange(n), best] = True
    depth = np.zeros(n, np.int64)
    active = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(active):
        at, step = best[active], depth[active]
        # Squared distances: beyond four times the current one the entries are beyond twice the current distance.
        on = lists.distance[at, step] <= 4 * nearest[active]
        active, at, step = active[on], at[on], step[on]
        met = lists.order[at, step]
        depth[active] += 1
        fresh = ~marked[active, met]
        rows, met = active[fresh], met[fresh]
        marked[rows, met] = True
        found = _distances(queries[rows], lists.entries[met])
        closer = (found < nearest[rows]) | (found == nearest[rows]) & (met < best[rows])
        rows, met, found = rows[closer], met[closer], found[closer]
        best[rows], nearest[rows], depth[rows] = met, found, 0  # jump to the list of the closer entry
        active = active[depth[active] < k - 1]
    return best, nearest


def _assigned(column: pa.Array, lists: list[Lists], scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, vectors, codes, distances), the last two rows x parts, a stretch of rows at a time."""
    for start in range(0, len(column), ROWS):
        vectors = integers(column.slice(start, ROWS), len(lists), scale)
        found = [search(part, vectors[:, p]) for p, part in enumerate(lists)]
        yield start, vectors, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def kept(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, vector and the other columns of the rows that take part: vectors without null or non-finite components, not empty."""
    return vectors.withColumns({"_id": F.col(id_column).cast("long"), "_vector": F.col(vector_column).cast("array<double>")}).where(
        finite("_vector") & (F.size("_vector") > 0)
    )


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codebooks | None:
    """Codebooks of the rows of kept(): they start as the parts of the smallest ids, and each round moves every entry to the mean of its parts.

    Of vectors of several lengths those as long as that of the smallest id take part. A round reads all rows once; a
    task hands on one sum per entry, and the driver gets parts * entries of them. None without a row.
    """
    # By id, then by vector where ids repeat; a null id comes last. At most `entries` rows.
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), F.size("_vector"), "_vector").select("_vector").limit(1).collect()
    if not first:
        return None
    dims = len(first[0][0])
    rows = vectors.where(F.size("_vector") == dims).select("_id", "_vector")
    chosen = rows.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).collect()
    book = integers(pa.array([r["_vector"] for r in chosen], pa.list_(pa.float64())), parts, scale).astype(object).transpose(1, 0, 2)
    for _ in range(rounds):
        book = _moved(rows, book, scale)
    return Codebooks(_plain(book), dims)


def _plain(book: np.ndarray) -> np.ndarray:
    """As 64-bit integers where distances fit into them."""
    return book.astype(np.int64) if _fits(max(map(abs, book.ravel().tolist())), book[:, 0].size) else book


def _moved(rows: DataFrame, book: np.ndarray, scale: float) -> np.ndarray:
    plain = _plain(book)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Lists.of(part) for part in plain]
        parts, k, width = plain.shape
        total, count = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            for _, vectors, codes, _ in _assigned(batch.column("_vector"), lists, scale):
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=k)
                    sums = np.zeros((k, width), vectors.dtype)
                    np.add.at(sums, codes[:, p], vectors[:, p])
                    total[p] += sums.astype(object)
        part, entry = np.nonzero(count)
        for p, e in zip(part.tolist(), entry.tolist()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * width), pa.array([e] * width), pa.array(range(width)), pa.array([int(count[p, e])] * width), pa.array([str(x) for x in total[p, e]])],
                names=["part", "entry", "place", "n", "total"],
            )

    sums = (
        rows.select("_vector").mapInArrow(summed, "part long, entry long, place long, n long, total string")
        .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    out = book.copy()
    for r in sums.collect():  # parts * entries * width numbers
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def encode(vectors: DataFrame, books: Codebooks | None, scale: float = SCALE) -> DataFrame:
    """The rows of kept() that have the codebooks' length, with code (two hex digits per part) and error (squared distances over all parts).

    An error beyond 64 bits is the largest number of 64 bits.
    """
    if books is None:
        return vectors.limit(0).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")})
    entries = books.entries

    def encoded(column: pa.Array) -> pa.Array:
        lists = [Lists.of(part) for part in entries]
        codes, errors = [], []
        for _, _, code, distance in _assigned(column, lists, scale):
            codes += [bytes(c).hex() for c in code.astype(np.uint8)]
            errors += [min(int(e), _END) for e in distance.sum(1)]
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["code", "error"])

    found = F.arrow_udf(encoded, "code string, error long")("_vector")
    return vectors.where(F.size("_vector") == books.dims).withColumn("_found", found).withColumns({"code": F.col("_found.code"), "error": F.col("_found.error")}).drop("_found")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error (errors over equal labels, nulls together) and codebooks_sha256 per vector.

    A component x counts as floor(scale * x), cut to +-2^62. Vectors that are null, empty or hold null or non-finite components are left out, as
    are those of another length than that of the smallest vec_id. A length that is no multiple of `parts` is padded with
    zeros. Rows that share an id are rows of their own; where they start a codebook the smaller vector comes first, and null ids come
    last. With fewer rows than entries a codebook has as many entries as rows. An empty table gives no row.
    Other columns are not read.
    """
    rows = kept(vectors, id_column, vector_column).select("_id", "_vector", F.col(label_column).alias("_label"))
    books = train(rows, parts, entries, rounds, scale)
    coded = stored(encode(rows, books, scale).select("_id", "_label", "code", "error"))
    # A label may hold a third of all rows: its errors are summed before they are dealt out, and come back as one row.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_END).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("_label").alias("_of")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256 if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256")
    )
