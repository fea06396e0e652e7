"""Importance resampling towards a target distribution.

Runs of one to three words are hashed into buckets. How much likelier a bucket is in the target than in the source is an array
with one gain per bucket, and a document's weight is the sum of its features' gains. The highest of weight plus
Gumbel noise are a draw without replacement. The cutoff of the draw comes from a quantile sketch: two quantiles
bracket it, exact counts outside the bracket prove or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmesh.llm.common import slices, stored, text_bytes
from vigilmesh.llm.shingles import SLICE, word_places

#: Slots of features, and the longest run of words that is one.
BUCKETS, LONGEST = 10_000, 3
SEED = "42"
#: Words a document needs to be drawn, and the share drawn of those that have them, in hundredths.
LEAST_WORDS, PERCENT = 20, 5
#: Factor of the logarithms before they are cut to integers.
UNIT = 1000.0
#: Relative rank error of the sketch is one in so many; rows that are sorted at once at the cutoff.
ACCURACY, SORTED = 4_000, 20_000
#: Words up to so many bytes are hashed side by side.
SHORT = 64


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """Change of a CRC-32 by one byte."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & 1, np.uint32(0xEDB88320), np.uint32(0))
    return value


@lru_cache(maxsize=40)
def _shift_table(power: int) -> np.ndarray:
    """4 x 256: what 2^power zero bytes make of each byte of a CRC-32. The change is linear, so the four results are XORed."""
    if power:
        half = _shift_table(power - 1)
        return _apply(half, half)
    value = np.arange(256, dtype=np.uint32)
    step = _byte_table()
    return np.stack([step[value], *(value << np.uint32(8 * (k - 1)) for k in range(1, 4))])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255] ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)]


def _shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs as after so many more zero bytes: the CRC of A then B is that of A, shifted by B's length, XOR that of B."""
    crc = crc.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> power) & 1)
        crc[at] = _apply(_shift_table(power), crc[at])
    return crc


def _word_crcs(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    step = _byte_table()
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(length <= SHORT)
    for k in range(int(length[at].max(initial=0))):
        at = at[length[at] > k]
        crc[at] = step[(crc[at] ^ flat[start[at] + k]) & 255] ^ (crc[at] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT):
        crc[i] = zlib.crc32(flat[start[i] : start[i] + length[i]].tobytes())
    return crc


def feature_buckets(flat: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST):
    """(words of each row, row and bucket of every feature) of a slice of texts laid end to end.

    A word is a run of letters, digits and non-ASCII, A-Z lowered. A feature is a run of up to `longest` words joined by
    single spaces, and its bucket the CRC-32 of its bytes modulo `buckets`.
    """
    places = word_places(flat, offsets, letters_only=True)
    small = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    length = places.end - places.start
    crc = _word_crcs(small, places.start, length)
    space = np.uint32(zlib.crc32(b" "))
    docs, found, run = [places.doc], [crc % buckets], crc
    for size in range(2, longest + 1):
        more = len(places.doc) - size + 1
        if more <= 0:
            break
        spaced = _apply(_shift_table(0), run[:more]) ^ space
        run = _shifted(spaced, length[size - 1 :]) ^ crc[size - 1 :]
        whole = places.doc[:more] == places.doc[size - 1 :]
        docs.append(places.doc[:more][whole])
        found.append(run[whole] % buckets)
    return np.bincount(places.doc, minlength=len(offsets) - 1), np.concatenate(docs), np.concatenate(found).astype(np.int64)


def _by_slice(column: pa.Array, buckets: int):
    flat, offsets = text_bytes(column)
    for start, end in slices(np.diff(offsets), SLICE):
        part = offsets[start : end + 1]
        yield start, end, feature_buckets(flat[part[0] : part[-1]], part - part[0], buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, text_column: str = "text") -> np.ndarray:
    """Features per bucket over all rows; a task hands on one row per bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, (_, _, bucket) in _by_slice(batch.column("text"), buckets):
                total += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    rows = texts.select(F.col(text_column).alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.toLocalIterator():  # one row per bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray, unit: float = UNIT) -> np.ndarray:
    """Per bucket, the whole part of `unit` times the log ratio of its smoothed shares in target and source."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(unit * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def weigh(documents: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's features, per row."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for start, end, (n_words, row, bucket) in _by_slice(batch.column("text"), len(gain)):
                total = np.zeros(end - start, np.int64)
                np.add.at(total, row, gain[bucket])
                features = np.bincount(row, minlength=end - start)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), *(pa.array(x.astype(np.int64)) for x in (n_words, features, total))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def noise(id_column: str, seed: str = SEED, unit: float = UNIT) -> Column:
    """Gumbel noise by id, cut to an integer: the same in every run and on every cluster. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-unit) * F.log(-F.log(share))).cast("long")


def cutoff(rows: DataFrame, keys: list[str], wanted: int, accuracy: int = ACCURACY, at_once: int = SORTED) -> tuple[tuple[int, ...], int]:
    """(keys of the `wanted`-th row in ascending order, rows before them). Keys are integers and never null.

    Two quantiles of a sketch around the wanted rank are the bracket. Exact counts of the rows below and within it
    prove that the rank is inside; otherwise the bracket is widened. While it holds more than can be sorted at once it is bracketed
    again; if so many rows share one value, the next key decides among them.
    """
    key, low, high, below, inside = keys[0], None, None, 0, rows
    size = rows.count()
    while low is None or size > at_once and low != high:
        share, margin = (wanted - below) / size, 4.0 / accuracy
        while True:
            if margin < 1:
                a, b = inside.agg(F.percentile_approx(key, [max(0.0, share - margin), min(1.0, share + margin)], accuracy)).first()[0]
            else:
                a, b = inside.agg(F.min(key), F.max(key)).first()
            before, within = inside.agg(F.count_if(F.col(key) < a), F.count_if(F.col(key).between(a, b))).first()
            if before < wanted - below <= before + within:
                break
            margin *= 4
        if within == size > at_once and a != b:  # the sketch cannot part these rows: halve the range of their values
            middle = a + (b - a) // 2
            first = inside.where(F.col(key) <= middle).count()
            before, within, a, b = (0, first, a, middle) if wanted - below <= first else (first, size - first, middle + 1, b)
        low, high, below, size = a, b, below + before, within
        inside = rows.where(F.col(key).between(low, high))
    if size > at_once:
        rest, before = cutoff(inside, keys[1:], wanted - below, accuracy, at_once) if keys[1:] else ((), 0)
        return (low, *rest), below + before
    # The bracket alone is sorted: at most `at_once` rows, as counts of equal ones.
    for row in inside.groupBy(*keys).agg(F.count("*").alias("_n")).orderBy(*keys).collect():
        if below + row["_n"] >= wanted:
            return tuple(row[k] for k in keys), below
        below += row["_n"]
    raise ValueError(f"fewer than {wanted} rows")


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with `rank` from 1 in the given order, without one task that sees them all.

    They are dealt by ranges and sorted within; a row's place within its range and the sizes of the ranges before it make
    its rank.
    """
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["n"]
    # One row of two numbers per partition of the ranges.
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    return placed.withColumn("_part", part).join(before, "_part").withColumn("rank", F.col("_before") + place + 1).drop("_place", "_part", "_before")


def draw(scored: DataFrame, eligible: Column, wanted: int, accuracy: int = ACCURACY, at_once: int = SORTED) -> DataFrame:
    """The rows with `rank`: 1, 2, 3... for the `wanted` eligible ones of highest score, null for all others.

    Ties go to the smaller doc_id, a null id last, then to fewer features; of rows equal in all of these any is drawn.
    scored: doc_id, n_features and score, all long, and whatever eligible reads.
    """
    none = F.lit(None).cast("long").alias("rank")
    if wanted <= 0:
        return scored.select("*", none)
    # Ascending, never null; the smallest comes first.
    keys = {"_score": -F.col("score"), "_null": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0)), "_features": F.col("n_features")}
    rows = scored.withColumns(keys | {"_in": F.coalesce(eligible, F.lit(False))})
    at, before = cutoff(rows.where("_in"), list(keys), wanted, accuracy, at_once)
    same, better = F.lit(True), F.lit(False)
    for key, value in zip(keys, at):
        better = better | (same & (F.col(key) < value))
        same = same & (F.col(key) == value)
    ties, left = rows.where(F.col("_in") & same), wanted - before
    all_drawn = ties.count() == left
    drawn = F.col("_in") & (better | same if all_drawn else better)
    out = _ranked(rows.where(drawn), [F.col(k).asc() for k in keys]).unionByName(rows.where(~drawn & ~(F.col("_in") & same)).select("*", none))
    if not all_drawn:
        place = F.col("rank") + before
        out = out.unionByName(_ranked(ties, [F.xxhash64(*scored.columns).asc()]).withColumn("rank", F.when(place <= wanted, place)))
    return out.select(*scored.columns, "rank")


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
) -> DataFrame:
    """Every row of documents: doc_id, n_features, weight, score and rank, all long; rank is null unless the row is drawn.

    Of the rows with at least `least_words` words, floor(percent * rows / 100) of highest score are drawn. Null text has
    no feature and weighs 0. Rows that share an id are rows of their own with equal noise; a null id counts as an empty
    one and comes last among ties. An empty target leaves only the smoothing; an empty table gives no row. Other columns
    are not read.
    """
    counts = bucket_counts(documents, text_column=text_column)
    gain = gains(counts, bucket_counts(target, text_column=target_column))
    weighed = weigh(documents, gain, id_column, text_column)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)))
    eligible = F.col("n_words") >= least_words
    n = scored.where(eligible).count()
    return draw(scored, eligible, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank")

