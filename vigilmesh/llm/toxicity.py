"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and the beginnings of words; all terms of all labelled examples of a bounded sample are the index,
clean examples too. The index is inverted and block-max. Like examples are groups; a term that many of a group's
examples hold is a column of the group's weights, any other term has a list of its holders there. Groups are cut into segments of one kind, and
a block of a segment's examples knows the largest weight of each column: with the lists of the other terms these bound
the cosine of each block. The best segments of a text are measured first, and of the others only the blocks that
may still hold one of its nearest examples, so that the neighbours are exact. Terms that no example holds have no weight: they would
scale all cosines of a text alike. The votes of the nearest examples and the mean cosines to
the nearest ones of either kind become a probability by a logistic fit on the examples themselves, each
without its own vote. A text without any known term has no neighbour and scores the rate of the label.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmesh.llm.common import held_out, mix, slices, stored, text_bytes
from vigilmesh.llm.shingles import SLICE, word_places

#: Bound of the labelled rows that a fit reads, those with the smallest hash.
SAMPLE = 20_000
#: First bytes of a longer word that are terms of their own.
BEGINNINGS = (6, 7)
#: Share of a group's examples from which a term is a column, and the holders a column has at least.
DENSE, LEAST = 0.12, 8
#: Groups of like examples, the commonest terms that tell them, and the most examples of a segment and of a block.
GROUPS, TELLING, SEGMENT, BLOCK = 8, 512, 512, 64
#: Shares, a power of two, in which the driver gets the terms of the examples; postings that a worker unpacks at once.
SHARES, UNPACKED = 8, 1 << 16
#: Neighbours that are the evidence of a score.
NEIGHBOURS = 15
#: Numbers of neighbours whose votes, and of nearest examples of either kind whose mean cosines, tell the score.
VOTES, MEANS = (5, 15, 30, 60, 120), (1, 5, 15, 50, 150)
#: Texts that are measured together, and how many times the examples looked for are measured before any is left out.
TEXTS, FIRST = 128, 10
#: Cosines count to so many parts of one; rounding of the bounds stays below the slack.
PARTS, SLACK = 1_000_000, 1e-5
#: Entries of lists that are read together.
LISTED = 1 << 18
#: Penalty of the logistic fit.
RIDGE = 0.3
#: A term is the upper bits of its hash; the row of a slice takes the others, so that both sort as one number.
ROW_BITS = 14
TERM_BITS = 64 - ROW_BITS
#: Bits of a term by which it is looked up.
FIRST_BITS = 20


class Segment(NamedTuple):
    """Examples of one group and one kind, start to end."""

    start: int
    end: int
    group: int
    toxic: bool
    rows: np.ndarray  # examples x columns: weights of unit vectors over all terms
    most: np.ndarray  # blocks x columns: the largest weight of a block


class Index(NamedTuple):
    terms: np.ndarray  # ascending
    places: np.ndarray
    idf: np.ndarray
    common: np.ndarray  # number of each term among those that may be columns, -1 for all others
    columns: list[np.ndarray]  # per group, of each common term, -1 if it has a list there
    segments: list[Segment]
    scale: np.ndarray  # of each example, to make it a unit vector
    start: np.ndarray  # terms + 1: the byte at which the list of each term's holders that have it once begins
    holder: np.ndarray
    start_more: np.ndarray  # and the list of those that have it more often: (holder, weight of the term there)
    more: np.ndarray
    single: np.ndarray  # terms that one example alone holds
    ids: np.ndarray  # of the examples
    before: np.ndarray  # place of each example among ties, by id
    toxic: np.ndarray
    rate: float  # toxic share among the examples


def _terms(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row and term of every occurrence of a slice of texts as one number each, ascending."""
    places = word_places(flat, offsets, letters_only=True)
    doc, start, length = places.doc, places.start, places.end - places.start
    base, down = places.total[start], places.down[start]
    rows, hashes = [doc], [mix((places.total[places.end] - base) * down)]
    for size in BEGINNINGS:
        longer = length > size
        doc, start, length, base, down = doc[longer], start[longer], length[longer], base[longer], down[longer]
        rows.append(doc)
        hashes.append(mix((places.total[start + size] - base) * down + np.uint64(size)))
    keys = [(r.astype(np.uint64) << np.uint64(TERM_BITS)) | (h >> np.uint64(ROW_BITS)) for r, h in zip(rows, hashes)]
    return np.sort(np.concatenate(keys))


def _slices(column: pa.Array):
    """(first row, last row, rows, terms, times): the distinct terms of each row, rows counted from the first."""
    flat, offsets = text_bytes(column)
    # The constant keeps the rows of a slice few enough for their bits.
    for start, end in slices(np.diff(offsets) + SLICE // (1 << (ROW_BITS - 1)), SLICE):
        part = offsets[start : end + 1]
        with np.errstate(over="ignore"):
            keys = _terms(flat[part[0] : part[-1]], part - part[0])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        yield start, end, (keys >> np.uint64(TERM_BITS)).astype(np.int64), keys & np.uint64((1 << TERM_BITS) - 1), times


def _places(terms: np.ndarray) -> np.ndarray:
    """Where the terms of each first bits begin."""
    return np.searchsorted(terms, np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(TERM_BITS - FIRST_BITS)).astype(np.int32 if len(terms) < 1 << 31 else np.int64)


def _known(terms: np.ndarray, places: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the index, whether it is there) of each term. Terms are hashes: few begin with the same bits."""
    last = len(terms) - 1
    at = np.minimum(places[found >> np.uint64(TERM_BITS - FIRST_BITS)], last)
    behind = np.flatnonzero((terms[at] < found) & (at < last))
    while len(behind):
        at[behind] += 1
        behind = behind[(terms[at[behind]] < found[behind]) & (at[behind] < last)]
    return at, terms[at] == found


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example with its distinct terms of each share and how often it has them."""
    ends = np.arange(1, SHARES + 1, dtype=np.uint64) * np.uint64((1 << TERM_BITS) // SHARES)
    for batch in batches:
        ids, places = (batch.column(c).to_numpy() for c in ("doc_id", "place"))
        for start, end, rows, terms, times in _slices(batch.column("text")):
            # Terms of a row ascend, so those of a share stand together.
            cut = np.searchsorted(rows, np.arange(end - start + 1))
            columns = ([], [], [], [], [])
            for row, (i, j) in enumerate(zip(cut, cut[1:])):
                inner = np.concatenate([[i], i + np.searchsorted(terms[i:j], ends)])
                for share, (x, y) in enumerate(zip(inner, inner[1:])):
                    if x < y:
                        values = (ids[start + row], places[start + row], share, terms[x:y].tobytes(), times[x:y].astype(np.int32).tobytes())
                        for column, value in zip(columns, values):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "place", "share", "terms", "times"])
    _give_back()


def sample(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text and label of at most SAMPLE labelled documents, those with the smallest hash that are not held out.

    Labels that contradict each other count as the larger one.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
        .where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias(label))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    # At most SAMPLE rows of two numbers.
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


class Packed(NamedTuple):
    """An index as the executors get it, three bytes a posting: unpickling gives the Index."""

    terms: np.ndarray
    length: np.ndarray  # holders of each term
    holder: np.ndarray  # examples, by term
    code: np.ndarray  # how often each holder has the term, as a place in `times`
    times: np.ndarray
    frequency: np.ndarray  # of each term, in all documents
    documents: int
    cuts: np.ndarray  # where segments begin
    groups: np.ndarray  # of the segments
    ids: np.ndarray
    toxic: np.ndarray
    rate: float

    def __reduce__(self):
        return unpacked, tuple(self)


def _idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.log((1 + documents) / (1 + frequency.astype(np.float64))).astype(np.float32)


def _postings(length: np.ndarray):
    """(first term, last term, first posting, last posting) for runs of terms, so that work arrays stay small."""
    begin = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    for a, b in slices(length, UNPACKED):
        yield a, b, begin[a], begin[b]


def _give_back() -> None:
    """Memory of freed work arrays and batches goes back to the system, where the libraries can: a worker serves many stages beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unpacked(terms, length, holder, code, times, frequency, documents, cuts, groups, ids, toxic, rate) -> Index:
    _give_back()
    n, ends, many = len(ids), np.append(cuts[1:], len(ids)), int(groups.max()) + 1
    idf, tf = _idf(frequency, documents), (1 + np.log(times)).astype(np.float32)
    square = np.zeros(n)
    for a, b, i, j in _postings(length):
        weight = tf[code[i:j]] * np.repeat(idf[a:b], length[a:b])
        square += np.bincount(holder[i:j], weight * weight, n)
    scale = (1 / np.sqrt(np.maximum(square, 1e-24))).astype(np.float32)
    common = np.full(len(terms), -1, np.int32)
    may = np.flatnonzero(length >= LEAST)
    common[may] = np.arange(len(may))
    segment = np.repeat(np.arange(len(cuts), dtype=np.int32), ends - cuts)
    group = groups[segment]
    holders = np.zeros(len(may) * many, np.int32)
    for a, b, i, j in _postings(length):
        number = np.repeat(common[a:b], length[a:b])
        at = number >= 0
        key = number[at].astype(np.int64) * many + group[holder[i:j][at]]
        holders += np.bincount(key, minlength=len(holders)).astype(np.int32)
    dense = holders.reshape(-1, many).T >= np.maximum(LEAST, DENSE * np.bincount(group, minlength=many))[:, None]
    column = np.where(dense, np.cumsum(dense, 1) - 1, -1).astype(np.int32)
    width = dense.sum(1)[groups]
    offset = np.concatenate([[0], np.cumsum((ends - cuts) * width)])
    flat = np.zeros(offset[-1], np.float32)
    left, more = np.zeros(len(terms), np.int32), np.zeros(len(terms), np.int32)
    left_holder, more_entries, n_left = np.empty(len(holder), holder.dtype), [], 0
    entry = np.dtype([("holder", holder.dtype), ("weight", np.float32)])
    often = times > 1
    for a, b, i, j in _postings(length):
        term = np.repeat(np.arange(a, b), length[a:b])
        of = holder[i:j]
        weight = tf[code[i:j]] * idf[term] * scale[of]
        place = np.full(j - i, -1, np.int32)
        may = np.flatnonzero(common[term] >= 0)
        place[may] = column[group[of[may]], common[term[may]]]
        at = place >= 0
        own = segment[of[at]]
        flat[offset[own] + (of[at] - cuts[own]) * width[own] + place[at]] = weight[at]
        many_times = often[code[i:j]]
        once, several = ~at & ~many_times, ~at & many_times
        held = of[once]
        left_holder[n_left : n_left + len(held)] = held
        n_left += len(held)
        entries = np.empty(int(several.sum()), entry)
        entries["holder"], entries["weight"] = of[several], tf[code[i:j][several]]
        more_entries.append(entries)
        for of_list, count in ((once, left), (several, more)):
            count[a:b] = np.bincount(term[of_list] - a, minlength=b - a)
    segments = []
    for s, (start, end) in enumerate(zip(cuts, ends)):
        rows = flat[offset[s] : offset[s + 1]].reshape(end - start, width[s])
        most = np.maximum.reduceat(rows, np.arange(0, end - start, BLOCK), 0)
        segments.append(Segment(int(start), int(end), int(groups[s]), bool(toxic[start]), rows, most))
    # The untouched end of a list costs no memory. Starts need 64 bits only with very many postings.
    kind = np.int32 if len(holder) * entry.itemsize < 1 << 31 else np.int64
    begin, begin_more = (np.concatenate([np.zeros(1, kind), np.cumsum(x, dtype=kind)]) * kind(size) for x, size in ((left, holder.itemsize), (more, entry.itemsize)))
    index = Index(
        terms, _places(terms), idf, common, list(column), segments, scale, begin, left_holder[:n_left],
        begin_more, np.concatenate(more_entries), length == 1, ids, np.argsort(np.argsort(ids, kind="stable"), kind="stable"), toxic, rate,
    )
    del flat, holders, left, more, more_entries, square
    _give_back()
    return index


def arranged(length: np.ndarray, holder: np.ndarray, weight_of: np.ndarray, idf: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(examples in the order of the index, where segments begin, their groups): toxic ones first, like ones together, small ones first.

    Like examples are found by a few rounds of spherical means over the commonest terms. The order decides how much is measured, never
    what is found.
    """
    n = len(toxic)
    begin = np.cumsum(length, dtype=np.int64) - length
    telling = np.argsort(-length, kind="stable")[:TELLING]
    rows = np.zeros((n, len(telling)), np.float32)
    for at, t in enumerate(telling):
        part = slice(begin[t], begin[t] + length[t])
        rows[holder[part], at] = weight_of[part] * idf[t]
    rows /= np.maximum(np.sqrt((rows * rows).sum(1)), 1e-12)[:, None]
    centers = rows[np.random.default_rng(7).permutation(n)[:GROUPS]]
    for _ in range(5):
        group = (rows @ centers.T).argmax(1)
        sums = np.stack([rows[group == g].sum(0) for g in range(len(centers))])
        centers = sums / np.maximum(np.sqrt((sums * sums).sum(1)), 1e-12)[:, None]
    size = np.bincount(holder, minlength=n)
    order = np.lexsort((size, group, -toxic))
    kind = group[order] + len(centers) * (toxic[order] > 0)
    first = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [n]])
    cuts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first, first[1:])])
    return order, cuts, np.unique(group[order], return_inverse=True)[1][cuts]


class Model(NamedTuple):
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    rate: float
    shared: Broadcast | None = None  # the index, on the executors
    fitted: np.ndarray | None = None  # coefficients of the features, and the constant


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The index of the labelled sample; document frequencies are those of all documents.

    What reaches the driver is bounded by SAMPLE and the length of its texts: their terms. Without both kinds of labels there is no
    index and every text scores the rate of the label.
    """
    context = documents.sparkSession.sparkContext
    rows = sample(documents, labels, label).withColumnRenamed(label, "toxic").withColumn("place", F.xxhash64("text")).dropDuplicates(["doc_id", "text"])
    rows = stored(rows)
    keys = rows.select("toxic", "doc_id", "place").toArrow()
    toxic, ids, place = (keys[c].to_numpy().astype(np.int64) for c in ("toxic", "doc_id", "place"))
    n, rate = len(ids), float((toxic.sum() + 0.5) / (len(ids) + 1))
    first = np.lexsort((place, ids))
    number_of = {key: i for i, key in enumerate(zip(ids[first].tolist(), place[first].tolist()))}
    ids, toxic = ids[first], toxic[first].astype(np.float64)
    if not 0 < toxic.sum() < n:
        return Model(ids, toxic, rate)
    kind = np.uint16 if n <= 1 << 16 else np.int32
    terms, length, holder, code, times = [], [], [], [], {}
    # A share of all terms at a time, so that the driver never holds the terms of all examples as they come.
    found_terms = stored(rows.mapInArrow(_examples, "doc_id long, place long, share int, terms binary, times binary"))
    for share in range(SHARES):
        part = found_terms.where(F.col("share") == share)
        held = [(number_of[r.doc_id, r.place], np.frombuffer(r.terms, np.uint64), np.frombuffer(r.times, np.int32)) for r in part.toLocalIterator()]
        if not held:
            continue
        held.sort(key=lambda x: x[0])
        hashes = np.concatenate([x[1] for x in held])
        number = np.repeat(np.array([x[0] for x in held], kind), [len(x[1]) for x in held])
        many, place = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
        del held
        codes = np.array([times.setdefault(m, len(times)) for m in many.tolist()], np.uint16)[place]
        order = np.argsort(hashes, kind="stable")
        found, size = np.unique(hashes, return_counts=True)
        terms.append(found)
        length.append(size.astype(np.int32))
        holder.append(number[order])
        code.append(codes[order])
        del hashes, number, place, codes, order
    del number_of
    if not terms:
        return Model(ids, toxic, rate)
    terms, length, holder, code = (np.concatenate(x) for x in (terms, length, holder, code))
    times = np.array(list(times))
    if len(times) <= 256:
        code = code.astype(np.uint8)
    known_terms = context.broadcast(terms)

    def frequencies(batches):
        terms = known_terms.value
        places = _places(terms)
        total, texts = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, _, found, _ in _slices(batch.column("text")):
                at, use = _known(terms, places, found)
                np.add.at(total, at[use], 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], texts))], names=["term", "documents"])
        del places, total, hit
        _give_back()

    counted = documents.select("text").mapInArrow(frequencies, "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents")).toArrow()
    known_terms.destroy()
    term, documents_with = counted["term"].to_numpy(), counted["documents"].to_numpy()
    frequency = np.zeros(len(terms), np.int64)
    frequency[term[term >= 0]] = documents_with[term >= 0]
    of_all = int(documents_with[term < 0].sum())
    del counted, term, documents_with
    if of_all < 1 << 31:
        frequency = frequency.astype(np.int32)
    order, cuts, groups = arranged(length, holder, (1 + np.log(times)).astype(np.float32)[code], _idf(frequency, of_all), toxic)
    place = np.empty(n, kind)
    place[order] = np.arange(n)
    holder, ids, toxic = place[holder], ids[order], toxic[order]
    shared = context.broadcast(Packed(terms, length, holder, code, times, frequency, of_all, cuts, groups, ids, toxic, rate))
    del terms, length, holder, code, frequency

    def alone(batches):
        for batch in batches:
            for at, values, _ in _features(shared.value, batch.column("text"), batch.column("doc_id").to_numpy()):
                yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(at)), pa.array(list(values), pa.list_(pa.float64()))], names=["toxic", "features"])
            _give_back()

    seen = rows.mapInArrow(alone, "toxic int, features array<double>").toArrow()
    if not len(seen):
        shared.destroy()
        return Model(ids, toxic, rate)
    features, of_kind = np.array(seen["features"].to_pylist()), seen["toxic"].to_numpy().astype(np.float64)
    in_order = np.lexsort((of_kind, *features.T))  # whatever order the rows came in
    return Model(ids, toxic, rate, shared, logistic(features[in_order], of_kind[in_order]))


def logistic(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Coefficients of the features, and the constant, of a ridge logistic regression."""
    mean, spread = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([(features - mean) / spread, np.ones(len(features))])
    ridge = np.diag(np.append(np.full(features.shape[1], RIDGE), 1e-6))
    at = np.zeros(x.shape[1])

    def loss(at):
        z = x @ at
        return np.logaddexp(0, z).sum() - toxic @ z + at @ ridge @ at / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(at)), x.T @ (p - toxic) + ridge @ at)
        size, now = 1.0, loss(at)
        while size > 1e-6 and loss(at - size * step) > now:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.append(at[:-1] / spread, at[-1] - (at[:-1] * mean / spread).sum())


def _measured(segment: Segment, query: np.ndarray, out: np.ndarray, texts: np.ndarray, blocks: np.ndarray | None = None) -> None:
    """Adds what the columns give to the cosines of some texts to a segment's examples, or to those of some blocks."""
    if blocks is None:
        out[texts, segment.start : segment.end] += query[texts] @ segment.rows.T
        return
    for a, b in _runs(segment, blocks):
        out[texts, segment.start + a : segment.start + b] += query[texts] @ segment.rows[a:b].T


def _runs(segment: Segment, blocks: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) rows of a segment for runs of some of its blocks: stretches are far cheaper to read and write than single places."""
    turn = np.flatnonzero(np.diff(blocks.astype(np.int8), prepend=0, append=0)) * BLOCK
    return [(int(a), min(int(b), segment.end - segment.start)) for a, b in zip(turn[::2], turn[1::2])]


def _lists(start: np.ndarray, entries: np.ndarray) -> pa.Array:
    """The lists of all terms, each as one value of bytes: Arrow copies them as stretches, and no entry is looked up by its place."""
    return pa.Array.from_buffers(pa.binary() if start.dtype == np.int32 else pa.large_binary(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(entries)])


def _listed(lists: pa.Array, terms: pa.Array, kind: np.dtype) -> np.ndarray:
    """All entries of some terms' lists, end to end."""
    entries = lists.take(terms).buffers()[2]
    return np.frombuffer(entries, kind) if entries is not None and entries.size else np.zeros(0, kind)


def cosines(index: Index, rows: np.ndarray, known: np.ndarray, weight: np.ndarray, texts: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x examples, texts x 2): cosines of unit vectors, given as (row, term, weight) by row, and what the `near` nearest toxic and clean examples have at least.

    Examples proven to be below have -1.
    """
    n = len(index.ids)
    out = np.zeros((texts, n), np.float32)
    # Lists: what the terms that are no column of a group give there, exactly.
    cut = np.searchsorted(rows, np.arange(texts + 1))
    share = weight * index.idf[known]
    lists, lists_more = _lists(index.start, index.holder), _lists(index.start_more, index.more)
    length, length_more = ((x[known + 1] - x[known]) // y.dtype.itemsize for x, y in ((index.start, index.holder), (index.start_more, index.more)))
    ends, ends_more = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[cut] for x in (length, length_more))
    scale = index.scale.astype(np.float64)
    for first, last in slices(np.diff(ends + ends_more), LISTED):
        part = slice(cut[first], cut[last])
        terms = pa.array(known[part])
        held, held_more = _listed(lists, terms, index.holder.dtype), _listed(lists_more, terms, index.more.dtype)
        given = np.repeat(share[part].astype(np.float64), length[part])
        given_more = (np.repeat(share[part], length_more[part]) * held_more["weight"]).astype(np.float64)
        held_more = held_more["holder"].astype(np.intp)
        for text in range(first, last):
            of, of_more = (slice(x[text] - x[first], x[text + 1] - x[first]) for x in (ends, ends_more))
            # Without entries np.bincount counts in integers.
            sums = np.bincount(held[of], given[of], n).astype(np.float64, copy=False)
            np.add.at(sums, held_more[of_more], given_more[of_more])
            out[text] = np.multiply(sums, scale, out=sums)
    # Bounds: what the columns give at most in a block, and the most that lists give there.
    number = index.common[known]
    use = number >= 0
    number, of, share = number[use], rows[use], weight[use]
    queries = []
    for columns in index.columns:
        column = columns[number]
        use = np.flatnonzero(column >= 0)
        query = np.zeros((texts, int(columns.max(initial=-1)) + 1), np.float32)
        query[of[use], column[use]] = share[use]
        queries.append(query)
    bounds = []
    for s in index.segments:
        bounds.append(queries[s.group] @ s.most.T + np.maximum.reduceat(out[:, s.start : s.end], np.arange(0, s.end - s.start, BLOCK), 1))
    best = np.stack([b.max(1) for b in bounds], 1)
    is_measured = np.zeros(best.shape, bool)
    least_of = np.full((texts, 2), -1, np.float32)
    for at, kind in enumerate((True, False)):
        of_kind = np.flatnonzero([s.toxic == kind for s in index.segments])
        order = of_kind[np.argsort(-best[:, of_kind], 1, kind="stable")]
        sizes = np.array([s.end - s.start for s in index.segments])[order]
        # The best segments of each text, so many that they hold more examples than are looked for.
        np.put_along_axis(is_measured, order, np.cumsum(sizes, 1) - sizes < FIRST * near, 1)
        for s in of_kind:
            if len(some := np.flatnonzero(is_measured[:, s])):
                _measured(index.segments[s], queries[index.segments[s].group], out, some)
        # What one of the nearest has at least: the measured examples hold as many that have it.
        least = least_of[:, at]
        patterns, pattern = np.unique(is_measured[:, of_kind], axis=0, return_inverse=True)
        for p, some in enumerate(patterns):
            seen = np.concatenate([np.arange(index.segments[s].start, index.segments[s].end) for s in of_kind[some]])
            if len(seen) > near:
                same = np.flatnonzero(pattern.ravel() == p)
                least[same] = np.partition(out[np.ix_(same, seen)], len(seen) - near, 1)[:, len(seen) - near] - SLACK
        for s in of_kind:
            segment, rest = index.segments[s], np.flatnonzero(~is_measured[:, s])
            wanted = bounds[s][rest] >= least[rest, None]
            if len(some := rest[wanted.any(1)]):
                blocks = wanted.any(0)
                _measured(segment, queries[index.segments[s].group], out, some, blocks)
                for a, b in _runs(segment, ~blocks):
                    out[some, segment.start + a : segment.start + b] = -1
            if len(some := rest[~wanted.any(1)]):
                out[some, segment.start : segment.end] = -1
    return out, least_of


def _nearest(cosine: np.ndarray, least: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, (columns, cosines) of the k largest cosines, from the largest down; equal ones, to a part of PARTS, by id.

    least: what those have at least. A cosine below 0 counts as 0; rows with fewer columns than k have them all.
    """
    k = min(k, cosine.shape[1])
    top, close = np.empty((len(cosine), k), np.int64), np.empty((len(cosine), k))
    for row, values in enumerate(cosine):
        some = np.flatnonzero(values >= least[row])
        if len(some) > 2 * k:
            some = some[values[some] >= np.partition(values[some], len(some) - k)[len(some) - k] - SLACK]
        elif len(some) < k:
            some = np.arange(len(values))
        parts = np.rint(np.maximum(values[some], 0) * PARTS).astype(np.int64)
        first = np.argsort(before[some] - (parts << 32))[:k]
        top[row], close[row] = some[first], parts[first] / PARTS
    return top, close


def _features(index: Index, texts: pa.Array, ids: np.ndarray | None = None, keep: int = NEIGHBOURS):
    """(rows, features, `keep` nearest examples, VOTES[-1] at most) for the texts that hold a known term. ids: examples of the same id do not count."""
    toxics = int(index.toxic.sum())
    # An example may be its own neighbour: so many more are looked for.
    by_id = np.argsort(index.ids, kind="stable")
    sorted_ids = index.ids[by_id]
    near = MEANS[-1] + (0 if ids is None else int(np.unique(index.ids, return_counts=True)[1].max()))
    for start, end, rows, terms, times in _slices(texts):
        at, use = _known(index.terms, index.places, terms)
        if ids is not None:
            # Another text would have no use of a term that only this one holds.
            use &= ~index.single[at]
        rows, known, weight = rows[use], at[use], (1 + np.log(times[use])) * index.idf[at[use]]
        norm = np.sqrt(np.bincount(rows, weight * weight, end - start))
        use = norm[rows] > 0
        rows, known, weight = rows[use], known[use], (weight[use] / norm[rows[use]]).astype(np.float32)
        for low in range(0, end - start, TEXTS):
            a, b = np.searchsorted(rows, [low, low + TEXTS])
            here, place = np.unique(rows[a:b], return_inverse=True)
            if not len(here):
                continue
            cosine, least = cosines(index, place, known[a:b], weight[a:b], len(here), near)
            if ids is not None:
                for row, own in enumerate(ids[start + here]):
                    cosine[row, by_id[np.searchsorted(sorted_ids, own) : np.searchsorted(sorted_ids, own, "right")]] = 0
            found = [_nearest(cosine[:, kind], least[:, at], index.before[kind], MEANS[-1]) for at, kind in enumerate((slice(0, toxics), slice(toxics, None)))]
            top, close = [found[0][0], found[1][0] + toxics], [c for _, c in found]
            means = [c[:, :k].mean(1) for c in close for k in MEANS]
            both, c = np.concatenate(top, 1), np.concatenate(close, 1)
            order = np.argsort(index.before[both] - np.rint(c * PARTS).astype(np.int64) * (1 << 32), 1, kind="stable")[:, : VOTES[-1]]
            both, c = np.take_along_axis(both, order, 1), np.take_along_axis(c, order, 1)
            is_toxic = index.toxic[both]
            votes = []
            for k in VOTES:
                # Shrunk to the rate by half a vote, as the neighbours' cosines are.
                half = 0.5 * c[:, :k].mean(1) + 1e-9
                p = np.clip(((c * is_toxic)[:, :k].sum(1) + index.rate * half) / (c[:, :k].sum(1) + half), 1e-4, 1 - 1e-4)
                votes.append(np.log(p / (1 - p)))
            yield here + start, np.stack(means + votes, 1), [b_[c_ > 0] for b_, c_ in zip(both[:, :keep], c[:, :keep])]


def score(documents: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """The documents with score (the probability of the label) and evidence, the ids of the k nearest examples.

    Null, empty and wordless texts, like all without a known term, score the rate of the examples and have no
    evidence. Equal neighbours come in the order of their ids. All columns and rows stay; columns named score or evidence are replaced.
    """
    shared, fitted, rate = model.shared, model.fitted, model.rate

    def scored(texts: pa.Array) -> pa.Array:
        scores, evidence = np.full(len(texts), rate), [[] for _ in range(len(texts))]
        if fitted is not None:
            for rows, features, near in _features(shared.value, texts, keep=k):
                scores[rows] = 1 / (1 + np.exp(-np.clip(features @ fitted[:-1] + fitted[-1], -500, 500)))
                for row, examples in zip(rows, near):
                    evidence[row] = shared.value.ids[examples].tolist()
            _give_back()
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], names=["score", "evidence"])

    udf = F.arrow_udf(scored, "score double, evidence array<bigint>")
    return documents.withColumn("_found", udf("text")).withColumns({"score": F.col("_found.score"), "evidence": F.col("_found.evidence")}).drop("_found")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence per document, learnt from the labels that are not held out."""
    model = fit(documents, labels)
    return score(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence"
    )
