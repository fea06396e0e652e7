import bisect
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from vigilmesh.llm import fingerprints
from vigilmesh.llm.queries import QUERIES

PIECE = re.compile("[^\x20\x09-\x0D]{1,8}")


def chained(values, kind):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(kind(v), seed)
    return seed


def signature(text, k=3, selected=2):
    """{bin: hash} by Order MinHash, in plain Python."""
    pieces = PIECE.findall(text or "")
    kmers = [chained(pieces[i : i + k], str.encode) >> 28 for i in range(max(len(pieces) - k + 1, 1))] if pieces else []
    seen, bins = {}, {}
    signed = lambda x, bits: x - (1 << bits) if x >> (bits - 1) else x
    number = lambda x: struct.pack("<q", x)
    for place, kmer in enumerate(kmers):
        occurrence = seen[kmer] = seen.get(kmer, -1) + 1
        v = chained([signed(kmer, 36), occurrence], number) >> 28
        bins.setdefault(v >> 30, []).append((v & ((1 << 30) - 1), place))
    out = {}
    for b, found in bins.items():
        in_order = [v for v, _ in sorted(sorted(found)[:selected], key=lambda x: x[1])]
        out[signed(b, 6) + 32] = chained(in_order, number) & 0xFFFF
    return out


def plain(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = signature(text), signature(edited), signature(after)
        name = lambda s: "".join(f"{b:02x}{h:04x}" for b, h in sorted(s.items()))
        like = lambda a, b: sum(a[x] == b.get(x) for x in a) / len(a.keys() | b.keys()) if a or b else 1.0
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), name(own), name(other), like(own, other), like(own, following))
    return out


def results(frame):
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return {r.doc_id: tuple(r[c] for c in columns) for r in frame.collect()}


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = QUERIES["op13_document_fingerprints"](spark, sf)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert results(got) == expected
    assert results(fingerprints.edits(docs.repartition(7), stretch=9)) == expected
    # Two thirds of a text are in its edited text: it is nearer than an unrelated one.
    long = [v for v in expected.values() if v[0] > 300]
    assert sum(v[4] > v[5] for v in long) >= 0.95 * len(long)


def test_main_path_has_no_python(spark, capsys):
    fingerprints.edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Window" in plan


def test_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé語 ") for _ in range(rng.randint(1, 12)))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "two words"), (6, "x" * 30_000), (7, "again " * 9000), (8, "\U0001f600é語" * 50), (9, "a b c d " * 3)]
    rows += [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(20, 60)] + [(-5, "below zero"), (2**62, "far up")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, entries int, next string").repartition(3)
    assert results(fingerprints.edits(frame)) == plain(rows) == results(fingerprints.edits(frame, stretch=4))
    assert fingerprints.edits(frame.limit(0)).count() == 0
    assert results(fingerprints.edits(frame.where("doc_id = 5"))) == plain([(5, "two words")])


@pytest.mark.parametrize("stretch", [2000, 5])
def test_repeated_and_null_ids(spark, stretch):
    """An id with most of the rows is cut at its rows' hashes; every row still meets the next one, in a ring."""
    rows = [(7, f"text number {i} of one id") for i in range(60)] + [(None, f"without id {i}") for i in range(9)] + [(8, "same"), (8, "same"), (9, "top of all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(frame, ["doc_id", "text"], stretch=stretch).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
    assert sorted(map(str, ((r.next.doc_id, r.next.text) for r in got))) == sorted(map(str, rows))
    for r in got:
        here, there = r.doc_id or -1, r.next.doc_id or -1
        assert there <= here or (here == -1 and r.next.text == "top of all")


def test_many_stretches(spark):
    """The plan grows with the number of stretches and not with a power of it; ids and texts still follow each other as sorted."""

    def made(n):
        return fingerprints.with_next(spark.createDataFrame([(i * 7919 % 5003, f"text {i}") for i in range(n)], "doc_id long, text string"), ["doc_id"], stretch=1)

    few, many = (len(made(n)._jdf.queryExecution().analyzed().toString()) for n in (24, 240))
    assert many < 10 * few
    got = {r.doc_id: r.next.doc_id for r in made(1500).collect()}
    ids = sorted((i * 7919 % 5003 for i in range(1500)), reverse=True)
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 100])
def test_bounds_are_counted(spark, n):
    """As in plain Python, with bounds that repeat, and at the ends of 64 bits."""
    rng = random.Random(n)
    bounds = sorted(rng.choice([-(1 << 63), (1 << 63) - 1, *range(-20, 20)]) for _ in range(n))
    values = [-(1 << 63), (1 << 63) - 1, *range(-22, 22)]
    under = fingerprints._count_of(bounds, lambda b: b < F.col("x")).alias("under")
    upto = fingerprints._count_of(bounds, lambda b: b <= F.col("x")).alias("upto")
    got = spark.createDataFrame([(v,) for v in values], "x long").select("x", under, upto).collect()
    assert [(r.x, r.under, r.upto) for r in got] == [(v, bisect.bisect_left(bounds, v), bisect.bisect_right(bounds, v)) for v in values]


def test_order_and_repeats_count(spark):
    """Moved halves keep all k-mers but few tuples; a repeat is another occurrence; equal texts are equal."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [words, words[200:] + words[:200], words + words, words[:-1], [f"v{w}" for w in words], words]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = fingerprints.signature(frame, "text", "entries")
    rows = rows.crossJoin(rows.where("doc_id = 0").select(F.col("entries").alias("first")))
    near = {r.doc_id: r.near for r in rows.select("doc_id", fingerprints.likeness("entries", "first").alias("near")).collect()}
    assert near[0] == near[5] == 1 and near[3] > 0.9 and near[4] == 0
    assert 0.3 < near[1] < 0.75 and near[2] < 0.5
