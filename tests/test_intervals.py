"""Interval joins against brute force, for all kinds of join and both conditions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilmesh.operators.intervals import interval_join

BASE = dt.datetime(2026, 9, 10)


def at(minutes):
    return None if minutes is None else BASE + dt.timedelta(minutes=int(minutes))


def tables(spark, seed, open_end):
    rng = np.random.default_rng(seed)
    facts, ranges = [], []
    for i in range(120):
        start = int(rng.integers(-2000, 12000))
        length = int(rng.choice([1, 5, 30, 700, 1440, 4000]))
        facts.append((i % 90, f"k{rng.integers(0, 4)}", start, start + length))
    facts += facts[:7] + [(500, "k1", None, 5), (501, "k9", 1438, 1443), (502, None, 10, 20), (503, "k0", 1435, 1445)]
    for i in range(40):
        start = int(rng.integers(-1000, 11000))
        end = start + int(rng.choice([0, 10, 60, 1440, 5000]))
        ranges.append((f"k{rng.integers(0, 5)}", start, None if open_end and i % 6 == 0 else end, i))
    ranges += [("k1", None, 50, 900), (None, 0, 9000, 901)]
    f = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in facts], "id long, k string, a timestamp, b timestamp")
    d = spark.createDataFrame([(k, at(a), at(b), n) for k, a, b, n in ranges], "k string, lo timestamp, hi timestamp, n long")
    return facts, ranges, f, d


def brute(facts, ranges, how, contain, keyed):
    out = []
    for i, k, a, b in facts:
        hits = []
        for rk, lo, hi, n in ranges:
            hi = 10**9 if hi is None else hi
            if lo is None or a is None or (keyed and (k is None or k != rk)):
                continue
            if (lo <= a and hi >= b) if contain else (lo < b and a < hi):
                hits.append(n)
        if how == "left_semi" and hits or how == "left_anti" and not hits:
            out.append((i, None))
        elif how in ("inner", "left"):
            out += [(i, n) for n in hits] or ([(i, None)] if how == "left" else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("contain", [True, False])
@pytest.mark.parametrize("keyed,piece,open_end", [(True, 86400, True), (False, 86400, False), (True, 300, False)])
def test_against_brute_force(spark, how, contain, keyed, piece, open_end):
    facts, ranges, f, d = tables(spark, 3 if keyed else 4, open_end)
    d = d if keyed else d.drop("k")
    joined = interval_join(f, d, ["k"] if keyed else [], F.col("a"), F.col("b"), "lo", "hi", how, contain, piece, open_end)
    got = [(r.id, r["n"] if "n" in joined.columns else None) for r in joined.collect()]
    assert sorted(got, key=str) == brute(facts, ranges, how, contain, keyed)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() or open_end
