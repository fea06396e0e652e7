"""N-gram Jaccard join over a forest of count-vector R-trees.

Shingles are hashed into groups. A document is the point of its group counts, and no two documents share more
shingles than their counts' coordinate minima add up to. One tree over all points would compare each pair of leaves of
like size, so the same groups also split the points into trees: if two sets differ in at most T shingles, at
most T of m > T groups differ, and the pair meets in the tree of each group whose content both share. Sizes fall
into classes with a T of their own; a set that may pair upwards enters the next class as well. Equal sets are one
point.

A tree is joined in two steps. First its smallest set is verified against all others (a star), which settles copies
and near copies in linear work. Then only sets that are still in different components meet, in cells of bounded
size, leaf against leaf and point against point by the summed minima. Pairs that survive are verified by
exact Jaccard over whole texts. Pairs already in one component are not verified again: the answer is the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmesh.llm.common import cut_lineage, long_array, meet_in_cells, mix, runs, stored
from vigilmesh.llm.components import components
from vigilmesh.llm.shingles import by_slice

#: Percent of the union that two linked sets share at least.
PERCENT = 80
#: Coordinates of a point. Sets of 500 shingles that share 70 percent of the union differ by more than the bound in 110 of them.
GROUPS = 128
#: A count from which a point is unknown: no bound is drawn from it.
UNKNOWN = 255
BLOCK = 512
#: Smallest trees that a point names, so that a pair which meets in several of them is passed on once.
NAMED = 16
LEAF = 16
#: Entries of the filter that thins out texts before they are shuffled: bounds its broadcast to 8 MB.
FILTER = 1 << 20
_SECOND = np.uint64(0xA0761D6478BD642F)


def size_classes(limit: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the classes up to the limit, and the number of groups of each.

    Sets of sizes a and b that share percent of their union differ in at most (a + b) * (100 - percent) / (100 + percent).
    Beyond one group more than the largest difference there are spare ones, for groups with fewer than two shingles:
    those are alike by chance too often to be trees.
    """
    first = [1]
    while first[-1] <= limit:
        first.append(max(first[-1] + 1, int(first[-1] * 1.6)))
    first = np.array(first)
    largest = first[1:] - 1
    groups = 2 * largest * (100 - percent) // (100 + percent) + 1
    spare = np.where(groups > 1, 1 + np.ceil(0.085 * groups + 2.5 * np.sqrt(0.085 * groups)), 0).astype(np.int64)
    return first, groups + spare


def tree_keys(doc: np.ndarray, value: np.ndarray, rows: int, percent: int = PERCENT):
    """(row, key) of every tree that the sets of a slice enter."""
    sizes = np.bincount(doc, minlength=rows)
    first, groups = size_classes(int(sizes.max(initial=1)) * 2, percent)
    own = np.searchsorted(first, sizes, "right") - 1
    out_rows, out_keys = [], []
    for step in (0, 1):
        kind = own + step
        # Upwards only where a set of the next class can share enough.
        enters = (sizes > 0) & ((step == 0) | (sizes * 100 >= percent * first[np.minimum(kind, len(first) - 1)]))
        m = np.where(enters, groups[np.minimum(kind, len(groups) - 1)], 0)
        offset = np.concatenate([[0], np.cumsum(m)])
        chosen = enters[doc]
        d, v = doc[chosen], value[chosen]
        group = ((v >> np.uint64(20)) % np.maximum(m[d], 1).astype(np.uint64)).astype(np.int64)
        cell = offset[d] + group
        order = np.argsort(cell, kind="stable")
        cell, content = cell[order], mix(v[order] ^ _SECOND)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        filled, heavy = cell[starts], np.diff(np.append(starts, len(cell))) > 1
        content = np.add.reduceat(content, starts) if len(starts) else content
        row = np.searchsorted(offset, filled, "right") - 1
        # If both sets have as many light groups as are sure to agree, the agreeing ones may all be light.
        last = np.minimum(first[np.minimum(kind + 1, len(first) - 1)] - 1, sizes * 100 // percent)
        differ = (sizes + last) * (100 - percent) // (100 + percent)
        light = m - np.bincount(row[heavy], minlength=rows)
        unsafe = enters & (light >= m - differ)
        bare = [np.setdiff1d(np.arange(offset[r], offset[r + 1]), filled) for r in np.flatnonzero(unsafe)]
        chosen = heavy | unsafe[row]
        bare = np.concatenate([*bare, np.zeros(0, np.int64)]).astype(np.int64)
        filled = np.concatenate([filled[chosen], bare])
        row = np.concatenate([row[chosen], np.searchsorted(offset, bare, "right") - 1])
        content = np.concatenate([content[chosen], np.zeros(len(bare), np.uint64)])
        place = (kind[row].astype(np.uint64) << np.uint64(40)) + (filled - offset[row]).astype(np.uint64)
        out_rows.append(row)
        out_keys.append(mix(content + mix(place + np.uint64(1))))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def fingerprints(sets, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit fingerprint of each row's set."""
    sizes = np.bincount(sets.doc, minlength=rows)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.hash))])
    ends = np.cumsum(sizes)
    return sizes, mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: size and fingerprint of its set, and its point."""
    for batch in batches:
        for start, end, sets in by_slice(batch.column("text")):
            rows = end - start
            with np.errstate(over="ignore"):
                sizes, prints = fingerprints(sets, rows)
            group = (sets.hash >> np.uint64(57)).astype(np.int64)
            counts = np.bincount(sets.doc * GROUPS + group, minlength=rows * GROUPS).reshape(rows, GROUPS)
            counts[(counts >= UNKNOWN).any(1)] = UNKNOWN
            points = [c.tobytes() for c in counts.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, rows), long_array(sizes), long_array(prints), pa.array(points, pa.binary())],
                names=["doc_id", "n", "print", "counts"],
            )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print) of every tree that each set enters; copies within a slice enter once."""
    for batch in batches:
        for start, end, sets in by_slice(batch.column("text")):
            rows = end - start
            with np.errstate(over="ignore"):
                _, prints = fingerprints(sets, rows)
                keep = np.zeros(rows, bool)
                keep[np.unique(prints, return_index=True)[1]] = True
                chosen = keep[sets.doc]
                row, keys = tree_keys(sets.doc[chosen], sets.hash[chosen], rows)
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [long_array(keys[i : i + (1 << 16)]), long_array(prints[row[i : i + (1 << 16)]])], names=["key", "print"]
                )


def _points(column) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each point, and which points are unknown."""
    counts = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)
    return counts, counts[:, 0] == UNKNOWN


def _may_link(shared, sizes):
    return shared * (100 + PERCENT) >= PERCENT * sizes


def _surviving(counts: np.ndarray, unknown: np.ndarray, sizes: np.ndarray, apart: np.ndarray):
    """Pairs of points whose summed minima reach the bound, leaf by leaf; apart[0] and others: columns in which both must differ."""
    order = np.lexsort((counts[:, 0], counts.argmax(1), sizes))
    leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    upper = np.stack([counts[x].max(0) for x in leaves])
    least = np.array([sizes[x].min() for x in leaves])
    open_leaf = np.array([unknown[x].any() for x in leaves])
    a, b = [], []
    for i, leaf in enumerate(leaves):
        shared = np.minimum(upper[i], upper[i:]).sum(1, dtype=np.int64)
        for j in i + np.flatnonzero(_may_link(shared, least[i] + least[i:]) | open_leaf[i] | open_leaf[i:]):
            other = leaves[j]
            shared = np.minimum(counts[leaf][:, None], counts[other][None]).sum(2, dtype=np.int64)
            near = _may_link(shared, sizes[leaf][:, None] + sizes[other][None]) | unknown[leaf][:, None] | unknown[other][None]
            for column in apart:
                near &= column[leaf][:, None] != column[other][None]
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            a.append(leaf[x])
            b.append(other[y])
    return np.concatenate(a), np.concatenate(b)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, ["key", "lo", "hi"]):
        counts, unknown = _points(run.column("counts"))
        apart = [run.column("component").to_numpy()]
        if run.column("lo")[0].as_py() != run.column("hi")[0].as_py():
            apart.append(run.column("sub").to_numpy())
        prints = run.column("print").to_numpy()
        a, b = _surviving(counts, unknown, run.column("n").to_numpy(), apart)
        if not len(a):
            continue
        # Of the trees that both points name, the smallest passes the pair on; without one, every tree does.
        key, named = run.column("key")[0].as_py(), [set(x) for x in run.column("named").to_pylist()]
        both = [named[x] & named[y] for x, y in zip(a, b)]
        mine = np.array([not x or min(x) == key for x in both])
        a, b = prints[a[mine]], prints[b[mine]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs that may link by the summed minima of their points."""
    for batch in batches:
        if batch.num_rows:
            (x, x_unknown), (y, y_unknown) = _points(batch.column("u_counts")), _points(batch.column("v_counts"))
            sizes = batch.column("u_n").to_numpy() + batch.column("v_n").to_numpy()
            near = _may_link(np.minimum(x, y).sum(1, dtype=np.int64), sizes) | x_unknown | y_unknown
            yield batch.select(["u", "v", "u_id", "v_id"]).filter(pa.array(near))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose texts share enough shingles, exactly."""
    for batch in batches:
        sides = []
        for name in ("u_text", "v_text"):
            found = []
            for start, end, sets in by_slice(batch.column(name)):
                cuts = np.searchsorted(sets.doc, np.arange(end - start + 1))
                found += [sets.hash[cuts[i] : cuts[i + 1]] for i in range(end - start)]
            sides.append(found)
        keep = []
        for x, y in zip(*sides):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(bool(len(x) and len(y)) and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among candidate pairs (u, v) of fingerprints. Only texts of candidates are shuffled, but for chance hits of the filter."""
    named = pairs
    for side in ("u", "v"):
        named = named.join(sets.select(F.col("print").alias(side), *(F.col(a).alias(f"{side}_{b}") for a, b in (("doc_id", "id"), ("n", "n"), ("counts", "counts")))), side)
    # Stored, as it is read three times below.
    named = stored(named.select("u", "v", "u_id", "v_id", "u_n", "v_n", "u_counts", "v_counts").mapInArrow(_bounded, "u long, v long, u_id long, v_id long"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    wanted = named.select(slot(F.col("u_id")).alias("slot")).unionAll(named.select(slot(F.col("v_id")).alias("slot"))).distinct()
    texts = docs.withColumn("slot", slot(F.col("doc_id"))).join(F.broadcast(wanted), "slot", "left_semi").drop("slot")
    with_u = named.join(texts.select(F.col("doc_id").alias("u_id"), F.col("text").alias("u_text")), "u_id")
    both = with_u.join(texts.select(F.col("doc_id").alias("v_id"), F.col("text").alias("v_text")), "v_id")
    return both.select("u", "v", "u_text", "v_text").mapInArrow(_verify, "u long, v long")


def jaccard_components(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest id reachable by links.

    Two documents link when their sets of distinct five-word shingles share 80 percent of the union. A text
    of fewer words has its whole sequence as the one shingle. Null, empty and blank texts have an empty set, link with
    nothing and are their own component. Repeated rows are returned as often as they come; a null id never
    stands for a component. Other columns are not read. Sets are told apart by 64-bit fingerprints, shingles by
    64-bit hashes.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketch = stored(docs.mapInArrow(_sketch, "doc_id long, n long, print long, counts binary"))
    sets = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("counts").alias("counts")
    )
    # One shuffle of the entries serves both the trees' sizes and their members.
    entries = docs.where("doc_id IS NOT NULL").mapInArrow(_trees, "key long, print long")
    # Said outright, else it would be inferred for one of the two uses only and part them.
    entries = entries.where("key IS NOT NULL AND print IS NOT NULL").repartition("key")
    trees = entries.groupBy("key").agg(F.min("print").alias("pivot"), F.max("print").alias("top"), F.count("*").alias("members"))
    trees = trees.where("pivot < top").drop("top")
    members = stored(entries.join(trees.hint("shuffle_hash"), "key").where("print <> pivot"))

    star = members.select(F.col("pivot").alias("u"), F.col("print").alias("v")).distinct()
    links = cut_lineage(_verified(star, sets, docs))
    group = components(links)
    # A tree of two is settled by its star; larger ones are open while they hold different components.
    labelled = (
        members.where("members > 2").select("key", "print").distinct()
        .join(group.withColumnRenamed("node", "print"), "print", "left")
        .withColumn("component", F.coalesce("component", "print"))
    )
    unsettled = labelled.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.sum(F.xxhash64("print") % 1000000007).alias("sum"), F.count("*").alias("n")
    ).where("a < b")
    # Trees with the same members are one tree.
    unsettled = unsettled.groupBy("a", "b", "sum", "n").agg(F.min("key").alias("key")).select("key")
    members = stored(labelled.join(unsettled, "key", "left_semi"))
    named = members.groupBy("print").agg(F.slice(F.sort_array(F.collect_list("key")), 1, NAMED).alias("named"))
    points = named.join(sets.select("print", "n", "counts"), "print")
    met = meet_in_cells(members, ["key"], "print", BLOCK, points).mapInArrow(_meet, "u long, v long").distinct()
    links = links.unionAll(cut_lineage(_verified(met, sets, docs)))

    group = cut_lineage(components(links))
    least = group.join(sets.select(F.col("print").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = group.join(least, "component").select(F.col("node").alias("print"), "component_id")
    own = sets.select("print", F.col("doc_id").alias("first_id"))
    return (
        sketch.withColumn("print", F.when(F.col("n") > 0, F.col("print")))
        .join(own.join(found, "print", "left"), "print", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "first_id", "doc_id").alias("component_id"))
    )
