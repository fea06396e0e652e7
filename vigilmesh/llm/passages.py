"""Substring dedup by paragraph MinHash banding.

Texts are cut into paragraphs that repeat wherever their words do: at line ends, and within lines before
each word pair whose hash is the least among its neighbours on both sides. A cut depends on a few words around it
only, so a passage that occurs in several texts is cut alike in all of them, whatever surrounds it.

A paragraph's set of five-word shingles gets a MinHash signature in bands. Paragraphs that share a band are candidates,
verified by exact Jaccard; verified links give components, and equal paragraphs are one. Each component stays in
the document with the smallest id and is repeated in all others. Neighbouring repeated paragraphs form a passage; a passage
is reported once its paragraphs hold enough words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilmesh.llm.common import cut_lineage, long_array, meet_in_cells, mix, runs, slices, stored, text_bytes
from vigilmesh.llm.components import components
from vigilmesh.llm.shingles import SLICE, WORDS, words

#: Words on either side among which a cut's hash is the least; paragraphs have more words than this.
REACH = 5
#: A paragraph has at most so many words, however alike its words are.
LONGEST = 64
#: Bands of ROWS hashes: at a similarity of 0.8 a pair shares a band with a probability of 1 - (1 - 0.8^2)^4 = 0.98.
BANDS, ROWS = 4, 2
#: Bits of a band's key. Paragraphs that share a key by chance are candidates that verification drops.
KEY_BITS = 48
PERCENT = 80
#: Words that the repeated paragraphs of a passage hold together. A passage of 50 words loses part of a paragraph at either end.
LEAST = 20
BLOCK = 512
FILTER = 1 << 20
_Q = np.uint64(0xD1342543DE82EF95)


def cuts(hashes: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Indices of words that begin a paragraph. line: number of the line that each word is in."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    following = np.zeros(n, np.uint64)
    following[:-1] = np.where(new[1:], np.uint64(0), hashes[1:])
    pair = mix(hashes * _Q + following)
    same = np.cumsum(new)
    least = ~new
    for step in range(1, REACH + 1):
        ahead = same[step:] == same[:-step]
        least[:-step] &= ~ahead | (pair[:-step] <= pair[step:])
        # A cut next to a line end would leave a short rest.
        least[step:] &= ahead & (pair[step:] < pair[:-step])
    begin = np.flatnonzero(new | least)
    lengths = np.diff(np.append(begin, n))
    long = np.flatnonzero(lengths > LONGEST)
    if len(long):
        begin = np.sort(np.concatenate([begin, *(np.arange(begin[i] + LONGEST, begin[i] + lengths[i], LONGEST) for i in long)]))
    return begin


def paragraphs(flat: np.ndarray, offsets: np.ndarray, shingles: bool = True):
    """Of a slice of texts: document row, number within it, bytes and words of each paragraph, and its fingerprint and, if wanted, shingles."""
    w = words(flat, offsets)
    begin = cuts(w.hash, w.doc, np.searchsorted(np.flatnonzero(flat == 10), w.start))
    size = np.diff(np.append(begin, len(w.hash)))
    owner = np.repeat(np.arange(len(begin)), size)
    n = len(w.hash)
    ordinal = np.arange(n) - begin[owner] if n else np.zeros(0, np.int64)
    content = np.add.reduceat(mix(w.hash + mix(ordinal.astype(np.uint64) + np.uint64(1))), begin) if n else np.zeros(0, np.uint64)
    first = np.searchsorted(w.doc[begin], np.arange(len(offsets)))
    doc = w.doc[begin]
    found = {
        "doc": doc, "index": np.arange(len(begin)) - first[doc], "word": begin - np.searchsorted(w.doc, doc), "words": size,
        "start": w.start[begin] - offsets[doc], "end": w.end[begin + size - 1] - offsets[doc],
        "print": mix(content + size.astype(np.uint64)),
    }
    if shingles:
        value, few = w.hash.copy(), size < WORDS
        of_few = np.zeros(int(few.sum()), np.uint64)
        for k in range(1, WORDS):
            ended = size[few] == k
            of_few[ended] = value[begin[few][ended]]
            if k < n:
                value[: n - k] = value[: n - k] * _Q + w.hash[k:]
        value[begin[few]] = of_few
        # Places too near the end of a paragraph hold part of a shingle: they count only in paragraphs without a whole one.
        kept = np.flatnonzero((ordinal + WORDS <= size[owner]) | ((ordinal == 0) & few[owner]))
        found |= {"owner": owner[kept], "shingle": mix(value[kept])}
    return found


def bands(p, chosen: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys of the chosen paragraphs."""
    take = chosen[p["owner"]]
    owner, shingle = p["owner"][take], p["shingle"][take]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    out = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            least = np.minimum.reduceat(mix(shingle ^ mix(np.array([band * ROWS + row + 1], np.uint64))), starts) if len(starts) else out[:, 0]
            out[:, band] = out[:, band] * _Q + least
        out[:, band] = mix(out[:, band] + np.uint64(band + 1))
    return out


def _slices(column: pa.Array, shingles: bool = True):
    flat, offsets = text_bytes(column)
    for start, end in slices(np.diff(offsets), SLICE):
        part = offsets[start : end + 1]
        with np.errstate(over="ignore"):
            yield start, paragraphs(flat[part[0] : part[-1]], part - part[0], shingles)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, key): bands of each paragraph, equal paragraphs of a slice once, or twice to tell that there are several.

    A key has KEY_BITS bits and comes last: its zeros and the head of the next row compress as one.
    """
    for batch in batches:
        for _, p in _slices(batch.column("text")):
            prints, first, times = np.unique(p["print"], return_index=True, return_counts=True)
            chosen = np.zeros(len(p["print"]), bool)
            chosen[first] = True
            by_place = np.argsort(first)
            with np.errstate(over="ignore"):
                keys = bands(p, chosen)
            several = np.minimum(times[by_place], 2)
            keys, prints = np.repeat(keys >> np.uint64(64 - KEY_BITS), several, axis=0).ravel(), np.repeat(prints[by_place], several * BANDS)
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([long_array(prints[part]), long_array(keys[part])], names=["print", "key"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, shingles) of each paragraph, equal paragraphs of a slice once. Shingles come as often as the paragraph has them."""
    for batch in batches:
        for _, p in _slices(batch.column("text")):
            chosen = np.zeros(len(p["print"]), bool)
            chosen[np.unique(p["print"], return_index=True)[1]] = True
            take = chosen[p["owner"]]
            sizes = np.bincount(p["owner"][take], minlength=len(chosen))[chosen]
            ends = np.concatenate([[0], 8 * np.cumsum(sizes)]).astype(np.int32)
            sets = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(p["shingle"][take])])
            whole = pa.RecordBatch.from_arrays([long_array(p["print"][chosen]), sets], names=["print", "shingles"])
            for i in range(0, len(sizes), 1 << 14):
                yield whole.slice(i, 1 << 14)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("index", "word", "words", "start", "end")
    for batch in batches:
        for start, p in _slices(batch.column("text"), shingles=False):
            of = pa.array(p["doc"] + start)
            ids, texts = batch.column("doc_id").take(of), batch.column("text_print").take(of)
            whole = pa.RecordBatch.from_arrays([ids, texts, *(pa.array(p[c].astype(np.int32)) for c in names), long_array(p["print"])], names=["doc_id", "text_print", *names, "print"])
            for i in range(0, len(whole), 1 << 16):
                yield whole.slice(i, 1 << 16)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell, links that connect what exact Jaccard links: at most one per row."""
    for run in runs(batches, ["key", "lo", "hi"]):
        prints = run.column("print").to_numpy()
        blocks = run.column("sub").to_numpy() if run.column("lo")[0].as_py() != run.column("hi")[0].as_py() else None
        sets = [np.frombuffer(x, np.uint64) for x in run.column("shingles").to_pylist()]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        # Shared shingles by a sparse product: rows that hold the same shingle.
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros((len(sets), int(column.max()) + 1), np.float32)
        held[owner, column] = 1
        size = held.sum(1)
        both = held @ held.T
        near = np.triu(both * (100 + PERCENT) >= PERCENT * (size[:, None] + size[None, :]), 1)
        if blocks is not None:
            near &= blocks[:, None] != blocks[None, :]
        a, b = np.nonzero(near)
        if len(a):
            label = np.arange(len(prints))
            while True:
                least = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
                label = label[label]
                if (before == label).all():
                    break
            moved = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[label[moved]])], names=["u", "v"])


def _thinned(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose print may be wanted, by a filter of FILTER slots: its broadcast is bounded, what passes by chance is joined away later."""
    slot = F.pmod(F.xxhash64("print"), F.lit(FILTER)).alias("slot")
    return rows.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")


def repeated_passages(documents: DataFrame, least_words: int = LEAST, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per repeated passage: doc_id, text_print, first_word, n_words, first_byte, last_byte, first_doc_id and n_documents.

    The words, counted from 0, and the UTF-8 bytes [first_byte, last_byte) lie in the document's text; first_doc_id is the
    document whose occurrence stays (the smallest, if the passage's paragraphs stay in several) and n_documents the
    occurrences of its most frequent paragraph. text_print, a hash of the text, tells the texts of one id apart. What an id repeats of itself alone is not reported. Null, empty and blank texts and rows without an id have no passages; rows that repeat an
    id and a text are one document. An empty table gives an empty result. Other columns are not read.
    """
    docs = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_print")
    ).where("doc_id IS NOT NULL")
    # One shuffle of the entries serves both the buckets and their members.
    entries = docs.mapInArrow(_entries, "print long, key long")
    # Said outright, else it would be inferred for one of the two uses only and part them.
    entries = entries.where("key IS NOT NULL AND print IS NOT NULL").repartition("key")
    buckets = entries.groupBy("key").agg(F.min("print").alias("a"), F.max("print").alias("b"), F.count("*").alias("times"))
    live = buckets.where("a < b OR times > 1").select("key", (F.col("a") < F.col("b")).alias("mixed"))
    members = stored(entries.join(live.hint("shuffle_hash"), "key").select("key", "print", "mixed").distinct())

    mixed = members.where("mixed").select("key", "print")
    sets = _thinned(docs.mapInArrow(_contents, "print long, shingles binary"), mixed).dropDuplicates(["print"])
    cells = meet_in_cells(mixed, ["key"], "print", BLOCK, sets)
    group = cut_lineage(components(cut_lineage(cells.mapInArrow(_verify, "u long, v long"))))

    kind = "doc_id long, text_print long, index int, word int, words int, start int, end int, print long"
    seen = _thinned(docs.mapInArrow(_occurrences, kind), members.select("print"))
    per_print = seen.groupBy("print").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "index")).alias("first"))
    # What passed the filter by chance goes here.
    per_print = per_print.join(members.select("print").distinct(), "print", "left_semi")
    per_print = stored(
        per_print.join(group.withColumnRenamed("node", "print"), "print", "left")
        .where("times > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "print"))
    )
    kept = per_print.groupBy("component").agg(F.sum("times").alias("times"), F.min("first").alias("first")).where("times > 1")
    stays = per_print.select("print", "component").join(kept, "component").select("print", "times", "first")
    marked = (
        seen.join(stays, "print")
        .where(F.col("first.doc_id") != F.col("doc_id"))
        .select(*kind.replace(" long", "").replace(" int", "").split(", "), "times", F.col("first.doc_id").alias("first_doc_id"))
        .dropDuplicates(["doc_id", "text_print", "index"])
    )
    # Neighbours form a passage: their number less their rank is the same.
    run = F.col("index") - F.row_number().over(Window.partitionBy("doc_id", "text_print").orderBy("index"))
    return (
        marked.withColumn("run", run)
        .groupBy("doc_id", "text_print", "run")
        .agg(
            F.min("word").cast("long").alias("first_word"), F.sum("words").alias("n_words"), F.min("start").cast("long").alias("first_byte"),
            F.max("end").cast("long").alias("last_byte"), F.min("first_doc_id").alias("first_doc_id"), F.max("times").alias("n_documents"),
        )
        .where(F.col("n_words") >= least_words)
        .drop("run")
    )


def without(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents, all columns, with the passages cut out of their texts; other documents as they are.

    A passage is cut from the text that it was found in: two texts of one id are two documents.
    """
    kept = documents.columns

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for value, pieces in zip(text, spans):
            if value is not None and pieces is not None and len(pieces):
                data, at, left = value.encode(), 0, []
                for piece in pieces:
                    left.append(data[at : piece["first_byte"]])
                    at = piece["last_byte"]
                value = b"".join([*left, data[at:]]).decode()
            out.append(value)
        import pandas as pd

        return pd.Series(out, dtype=object)

    spans = passages.groupBy(F.col("doc_id").alias("span_doc_id"), F.col("text_print").alias("span_text_print")).agg(F.sort_array(F.collect_list(F.struct("first_byte", "last_byte"))).alias("spans_to_cut"))
    own = (documents["doc_id"] == spans["span_doc_id"]) & (F.xxhash64(documents["text"]) == spans["span_text_print"])
    joined = documents.join(spans, own, "left")
    # Else a filter on the text left would cut a second time, in a second worker of each task: with two tasks at a time
    # four workers stay for what comes later, and each holds whatever is broadcast there.
    once = cut.asNondeterministic()
    touched = F.when(F.col("spans_to_cut").isNull(), F.col("text")).otherwise(once("text", "spans_to_cut"))
    return joined.withColumn("text", touched).select(*kept)
