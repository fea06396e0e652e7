import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle_check import compare, connect, table_of
from vigilmesh.llm import orchard
from vigilmesh.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """vec_id -> (code, error, label_error, sha256), in Python's integers; ids are unique and all vectors take part."""
    import math

    rows = sorted(rows, key=lambda r: r[0])
    width = -(-len(rows[0][1]) // parts)
    cut = {}
    for i, v, _ in rows:
        whole = [math.floor(scale * x) for x in v] + [0] * (parts * width - len(v))
        cut[i] = [whole[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut[i][p] for i, _, _ in rows[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, part: min((square(part, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            member = {}
            for i in cut:
                member.setdefault(nearest(p, cut[i][p])[1], []).append(cut[i][p])
            for j, of in member.items():
                books[p][j] = [sum(c) // len(of) for c in zip(*of)]
    found = {i: [nearest(p, cut[i][p]) for p in range(parts)] for i in cut}
    label = {i: lab for i, _, lab in rows}
    error = {i: sum(d for d, _ in f) for i, f in found.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{j:02x}" for _, j in f), error[i], sum(error[o] for o in error if label[o] == label[i]), digest) for i, f in found.items()}


def results(frame):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect()}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(1, 4), st.sampled_from([3, 50, 10**6, 2**61]))
def test_search_is_that_of_all_entries(seed, k, width, span):
    """Small spans make ties and equal entries, the largest leaves 64 bits."""
    rng = np.random.default_rng(seed)
    entries, queries = rng.integers(-span, span, (k, width)), rng.integers(-span, span, (60, width))
    if span > 2**30:
        entries, queries = entries.astype(object), queries.astype(object)
    found, distance = orchard.search(orchard.Lists.of(entries), queries)
    for q, j, d in zip(queries, found, distance):
        all_of_them = [sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)) for e in entries]
        assert d == min(all_of_them) and j == all_of_them.index(d)


def test_search_leaves_entries_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-(10**6), 10**6, (200, 2))
    measured = []
    original = orchard._distances

    def counting(a, b):
        measured.append(len(a))
        return original(a, b)

    lists = orchard.Lists.of(entries)
    orchard._distances = counting
    try:
        orchard.search(lists, rng.integers(-(10**6), 10**6, (500, 2)))
    finally:
        orchard._distances = original
    assert sum(measured) < 500 * 200 / 4


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op11_vector_codes"](spark, folder).toArrow()
    assert got.num_rows > 300
    assert not compare("op11", got, table_of(connect(folder), ORACLES["op11_vector_codes"]))


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(int(i), [float(x) for x in rng.normal(0, 0.2, 18)], [None, 0, 1][i % 3]) for i in range(5, 60)]
    good += [(100 + i, good[i][1], 7) for i in range(3)]  # equal vectors
    bad = [(200, None, 1), (201, [], 1), (202, [None] * 18, 1), (203, [float("nan")] * 18, 1), (204, [float("inf")] * 18, 1), (205, [1.0] * 8, 1)]
    frame = spark.createDataFrame([(*r, "c", "e") for r in good + bad], SCHEMA).withColumn("_label", F.lit(1)).repartition(4)
    assert results(orchard.compress(frame)) == plain(good)
    few = good[:3]
    assert results(orchard.compress(spark.createDataFrame([(*r, "c", "e") for r in few], SCHEMA))) == plain(few)
    empty = orchard.compress(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_null_and_repeated_ids(spark):
    one, other = [0.5] * 8, [0.25] * 8
    rows = [(None, one, 1)] * 4 + [(3, one, 1), (3, other, None), (3, one, 1)]
    got = orchard.compress(spark.createDataFrame([(*r, "c", "e") for r in rows], SCHEMA), entries=2).collect()
    # The smaller vector of id 3 starts the first entry, one of the others the second.
    assert sorted((r.vec_id is None, r.code, r.error, r.label_error) for r in got) == [(False, "00" * 8, 0, 0), *[(False, "01" * 8, 0, 0)] * 2, *[(True, "01" * 8, 0, 0)] * 4]


def test_components_beyond_64_bits_of_square(spark):
    rows = [(i, [float(x) for x in v], None) for i, v in enumerate(np.random.default_rng(4).integers(-(10**8), 10**8, (40, 8)))]
    got = results(orchard.compress(spark.createDataFrame([(*r, "c", "e") for r in rows], SCHEMA)))
    expected = plain(rows)
    assert {i: (c, s) for i, (c, _, _, s) in got.items()} == {i: (c, s) for i, (c, _, _, s) in expected.items()}
    assert all(got[i][1] == min(expected[i][1], 2**63 - 1) for i in got)
    huge = orchard.compress(spark.createDataFrame([(1, [1e306] * 8, 1, "", ""), (2, [-1e306] * 8, 1, "", "")], SCHEMA)).collect()
    assert [r.error for r in huge] == [0, 0]
