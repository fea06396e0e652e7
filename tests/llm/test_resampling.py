import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilmesh.llm import resampling
from vigilmesh.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(SMALL))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(documents, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) by the contract, in plain Python; ids are unique."""
    found = {i: features(t) for i, t in documents}
    s, t = Counter(b for _, f in found.values() for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = {}
    for i, (_, f) in found.items():
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((i for i in rows if found[i][0] >= least), key=lambda i: (-rows[i][3], i))
    rank = {i: r + 1 for r, i in enumerate(able[: percent * len(able) // 100])}
    return sorted((*rows[i], rank.get(i)) for i in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZé9 .\n語" + "b" * 3, max_size=60), max_size=6))
def test_buckets_are_crcs_of_runs_of_words(texts):
    data = [t.encode() for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    n_words, row, bucket = resampling.feature_buckets(flat, offsets)
    for i, text in enumerate(texts):
        words, expected = features(text)
        assert n_words[i] == words and sorted(bucket[row == i].tolist()) == sorted(expected)


def test_long_words_and_many_lengths():
    text = " ".join("x" * n for n in (1, 63, 64, 65, 200, 70_000, 3)) + " " + "é" * 500
    data = text.encode()
    _, _, bucket = resampling.feature_buckets(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert sorted(bucket.tolist()) == sorted(features(text)[1])


def test_query_equals_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    expected = plain(docs, target)
    assert sorted(map(tuple, got.collect())) == expected and sum(r[4] is not None for r in expected) > 5


def test_odd_rows(spark):
    long = "word of a long text " * 9000
    docs = [(1, None, "x"), (2, "", "x"), (3, " \n.", "x"), (4, long, "x"), (5, "Some words", None)] + [(i, f"text {i} " * 12, "y") for i in range(10, 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string").withColumn("rank", F.lit(1))
    target = spark.createDataFrame([(1, "a long text of words"), (2, None)], "item_id long, text string")
    got = sorted(map(tuple, resampling.resample(frame, target, percent=30).collect()))
    assert got == plain([d[:2] for d in docs], ["a long text of words", None], 30)
    assert resampling.resample(frame.limit(0), target).count() == 0
    bare = sorted(map(tuple, resampling.resample(frame, target.limit(0), percent=30).collect()))
    assert bare == plain([d[:2] for d in docs], [], 30)


def test_repeated_and_null_ids(spark):
    rows = [(None, "same words " * 15)] * 7 + [(3, "same words " * 15)] * 9 + [(4, "other words here " * 10)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w",)], "text string"), percent=50).collect()
    assert len(got) == 17 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 9))
    order = sorted((r for r in got), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["score"] for r in order[:8]] == [r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]


def test_brackets_widen_and_narrow(spark):
    """Ties of thousands, few rows at once and a coarse sketch: the draw is exact all the same."""
    rng = np.random.default_rng(3)
    values = [(int(i), 5, int(v)) for i, v in enumerate(np.concatenate([rng.integers(-50, 50, 3000), np.full(1500, 7), rng.integers(-(10**12), 10**12, 500)]))]
    frame = spark.createDataFrame(values, "doc_id long, n_features long, score long").repartition(5).cache()
    for wanted in (1, 249, 700, 1800, 2500, 4999, 5000):
        drawn = resampling.draw(frame, F.lit(True), wanted, accuracy=50, at_once=20).where("rank IS NOT NULL").collect()
        expected = sorted(values, key=lambda v: (-v[2], v[0]))[:wanted]
        assert [(r.doc_id, r.n_features, r.score) for r in sorted(drawn, key=lambda r: r.rank)] == expected
        assert sorted(r.rank for r in drawn) == list(range(1, wanted + 1))
