import re

import numpy as np
import pytest

from vigilmesh.llm import mixing
from vigilmesh.llm.queries import QUERIES


def fill(totals, share=1.5, weights=(5, 2, 1)):
    """Targets by resharing in rounds."""
    order = sorted(totals, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(totals.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * totals[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("seed", range(6))
def test_flight_keeps_sums(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    p = rng.random(n) if seed % 2 else np.full(n, 0.37)
    size = rng.integers(0, 900, n).astype(float) if seed != 4 else np.full(n, 5.0)
    balance = np.stack([np.ones(n), size], 1)
    after = mixing.flight(p, balance, rng)
    assert np.allclose(balance.T @ after, balance.T @ p, rtol=1e-6, atol=1e-5)
    assert ((after > 0) & (after < 1)).sum() <= 2 and (after >= 0).all() and (after <= 1).all()


def test_inclusion_probabilities():
    size = np.array([3.0, 50, 7, 90, 10, 10, 200, 1, 4, 33])
    balance = np.stack([np.ones(10), size], 1)
    p = np.linspace(0.15, 0.85, 10)
    mean = np.mean([mixing.flight(p, balance, np.random.default_rng(i)) for i in range(3000)], 0)
    assert np.abs(mean - p).max() < 0.04


def check(rows, texts):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in texts.items()}
    totals, largest = {}, {}
    for i, (_, s) in texts.items():
        totals[s] = totals.get(s, 0) + size[i]
        largest[s] = max(largest.get(s, 0), size[i])
    want = fill(totals)
    taken, copies, n = {}, {}, {}
    for r in rows:
        source = texts[r.doc_id][1]
        assert r["size"] == size[r.doc_id] and r.source_size == totals[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= 2 * largest[s], s


def test_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = {i: ("w " * int(rng.integers(0, 60)), ["a", "b", "B", "é", None, "z"][min(5, int(rng.exponential(1.2)))]) for i in range(900)}
    texts[900], texts[901], texts[902] = (None, "a"), ("w " * 3000, "b"), ("", "only empty")
    frame = spark.createDataFrame([(i, t, s, 1.0, 2) for i, (t, s) in texts.items()], "doc_id long, text string, source string, p double, size int")
    monkeypatch.setattr(mixing, "BLOCK", 16)
    first = sorted(map(tuple, mixing.mix(frame).select("doc_id", "taken").collect()))
    again = mixing.mix(frame.repartition(7)).collect()
    check(again, texts)
    assert sorted((r.doc_id, r.taken) for r in again) == first
    assert mixing.mix(frame.limit(0)).count() == 0
    repeated = mixing.mix(frame.where("doc_id < 5").unionAll(frame.where("doc_id < 5")))
    assert repeated.count() == 10


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_mixing"](spark, folder).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
