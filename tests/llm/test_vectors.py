import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle_check import compare, connect, table_of
from vigilmesh.llm import topk, vectors
from vigilmesh.llm.components import components
from vigilmesh.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(2000, 2001 + i) for i in range(50)] + links[:20]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(7, None)], "u long, v long")).collect()}
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert got == roots(nodes, links)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 5), st.integers(1, 4))
def test_threshold_algorithm(seed, n, dims, k):
    rng = np.random.default_rng(seed)
    rows, ids = rng.integers(-4, 5, (n, dims)), rng.permutation(100)[:n].astype(np.int64)
    got = list(zip(*(x.tolist() for x in topk.search_block(ids, rows, ids[:3], rows[:3], k))))
    want = []
    for q, v in zip(ids[:3], rows[:3]):
        scored = sorted((-int(v @ r), int(i)) for i, r in zip(ids, rows) if i != q)[:k]
        want += [(int(q), i, -s) for s, i in scored]
    assert got == want


def odd_rows(rng):
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.1 * rng.normal(size=8)], i % 2, 0, "x") for i in range(60)]
    rows += [(100 + i, rows[0][1], 0, 0, "x") for i in range(5)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 0, 0, ""), (201, [0.0] * 8, 0, 0, ""), (202, [nan] * 8, 0, 0, ""), (203, [inf] + [1.0] * 7, 0, 0, "")]
    rows += [(204, [None] + [1.0] * 7, 1, 0, ""), (205, rows[0][1], None, 0, ""), (206, [], 0, 0, ""), (207, [1.0, 2.0], 0, 0, ""), (208, [1.0, 2.0], 0, 0, "")]
    return rows


def brute_links(rows, threshold=0.93):
    fine = {}
    for i, v, label, *_ in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = (np.array(v, np.float32).astype(float), label)
    links = []
    for i, (v, l) in fine.items():
        for j, (w, m) in fine.items():
            if i < j and l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links.append((i, j))
    return links


def test_near_duplicates_small(spark):
    rows = odd_rows(np.random.default_rng(1))
    links = brute_links(rows)
    ids = [r[0] for r in rows]
    want = roots(ids, links)
    old, vectors.BLOCK = vectors.BLOCK, 4  # several cells per bucket
    try:
        got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), tables=24, hashes=1).collect()}
    finally:
        vectors.BLOCK = old
    assert set(got) == set(ids)
    for i in ids:
        assert got[i].n_links == sum(i in pair for pair in links), i
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_recall(spark):
    """Planted pairs from the threshold up, in as many dimensions as the table has, with the query's own parameters."""
    rng, rows, links = np.random.default_rng(9), [], []
    for number, cosine in enumerate(np.repeat([0.9301, 0.935, 0.95, 0.97, 0.99], 300)):
        one, noise = rng.normal(size=(2, 64))
        one /= np.sqrt(one @ one)
        noise -= (noise @ one) * one
        noise /= np.sqrt(noise @ noise)
        other = cosine * one + np.sqrt(1 - cosine**2) * noise
        for k, vector in enumerate((one, other)):
            rows.append((2 * number + k, [float(x) for x in vector * rng.uniform(0.5, 2)], number % 3, 0, "x"))
        links.append((2 * number, 2 * number + 1))
    assert set(links) <= set(brute_links(rows[:600])) | set(links[300:])
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    found = [got[a].n_links == got[b].n_links == 1 and got[b].component_id == a and not got[b].kept for a, b in links]
    assert sum(r.n_links for r in got.values()) == 2 * sum(found)
    assert sum(found) >= 0.98 * len(links) and sum(found[:300]) >= 0.96 * 300


def test_query_links_what_brute_force_links(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    links = brute_links([(r.vec_id, r.embedding, r.label) for r in table])
    got = {r.vec_id: r for r in QUERIES["op2_embedding_near_duplicates"](spark, folder).collect()}
    assert len(got) == len(table) and sum(r.n_links for r in got.values()) <= 2 * len(links)


def test_top_k_edges(spark):
    rows = odd_rows(np.random.default_rng(2))
    rows += rows[:3] + [(None, rows[0][1], 0, 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    old, topk.BLOCK, topk.QUERY_BLOCK = topk.BLOCK, 16, 3
    try:
        got = [tuple(r) for r in topk.top_k(frame, lambda i: i % 10 == 0, 4).collect()]
    finally:
        topk.BLOCK, topk.QUERY_BLOCK = old, 1024
    fine = {
        r[0]: np.floor(1024 * np.array(r[1], np.float32).astype(float)).astype(int)
        for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])
    }
    want = []
    for q in fine:
        if q % 10 == 0:
            scored = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:4]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(frame.limit(0), lambda i: i % 10 == 0).count() == 0


def test_top_k_oracle(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op8_exact_top_k"](spark, folder).toArrow()
    assert not compare("op8", got, table_of(connect(folder), ORACLES["op8_exact_top_k"]))
