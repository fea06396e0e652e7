import re

import numpy as np
import pytest

from tests.llm.test_vectors import roots
from vigilmesh.llm import jaccard
from vigilmesh.llm.queries import QUERIES


def shingles(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def expected(rows):
    sets, links, holders = {i: shingles(t) for i, t in rows}, [], {}
    for i, s in sets.items():
        for shingle in s:
            holders.setdefault(shingle, []).append(i)
    seen = set()
    for i, s in sets.items():
        for j in {j for shingle in s for j in holders[shingle] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links.append((i, j))
        seen.add(i)
    want = roots(sets, links)
    return {i: (len(sets[i]), want[i]) for i in sets}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def copies(rng, families=120, per=6):
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ÉE", "a", "A"]
    rows, at = [], 0
    for f in range(families):
        base = list(rng.choice(vocabulary, int(rng.choice([1, 3, 5, 6, 9, 12, 17, 30, 80, 300]))))
        for _ in range(per):
            words = list(base)
            for _ in range(int(rng.integers(0, max(2, len(words) // 25 + 2)))):
                place = int(rng.integers(0, len(words)))
                words[place : place + int(rng.integers(0, 2))] = [str(rng.choice(vocabulary))]
            rows.append((at, " ".join(words).upper() if rng.random() < 0.2 else "\t".join(words)))
            at += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_all_sizes(spark, seed):
    rows = copies(np.random.default_rng(seed))
    order = np.random.default_rng(seed + 9).permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    old, jaccard.BLOCK = jaccard.BLOCK, 4
    try:
        assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
    finally:
        jaccard.BLOCK = old


def test_chain_of_links(spark):
    """Each text links with the next only, so that a star cannot settle the tree."""
    words = [f"x{i}" for i in range(900)]
    rows = [(50 - i, " ".join(words[i * 9 : i * 9 + 100])) for i in range(40)]
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "z " * 30000), (9, "z " * 5), (10, "é"), (11, "É")]
    more = [(r[0], r[1], 7, "x", 1) for r in rows + rows[3:5]] + [(None, "one", 1, "x", 1)]
    frame = spark.createDataFrame(more, "doc_id long, text string, n long, print string, counts int")
    out = jaccard.jaccard_components(frame)
    assert out.count() == len(more)
    want = expected(rows)
    found = got(out)
    assert found.pop(None) == (1, 4)
    assert found == want
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = got(QUERIES["op9_ngram_jaccard_join"](spark, folder))
    assert found == expected(rows)
    assert sum(i != c for i, (_, c) in found.items()) > 10
