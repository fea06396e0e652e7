import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vigilmesh.llm import passages
from vigilmesh.llm.queries import QUERIES


def prose(rng, n, tag):
    return [f"{tag}{w}" for w in rng.integers(0, 5000, n)]


def planted(rng):
    """Clean texts, and three passages of 51 to 90 words inside otherwise different texts."""
    docs, homes = {}, {}
    parts = [prose(rng, n, "p") for n in (51, 60, 90)]
    for i in range(60):
        words = prose(rng, int(rng.integers(30, 400)), "w")
        if i % 4 == 1:
            p = int(rng.integers(0, 3))
            at = int(rng.integers(0, len(words)))
            words[at:at] = parts[p]
            homes.setdefault(p, []).append(i)
        text = " ".join(words)
        docs[i] = text.replace(" w7", "\nw7") if i % 3 else text
    return docs, homes


def test_planted_passages(spark):
    docs, homes = planted(np.random.default_rng(4))
    common = "a line of thirteen words that very many of the texts have alike."
    docs = {i: t + "\n" + common + "\n" if i % 2 else t for i, t in docs.items()}
    frame = spark.createDataFrame([(i, t, 3, "x") for i, t in docs.items()], "doc_id long, text string, words int, print string")
    rows = passages.repeated_passages(frame).collect()
    assert {r.doc_id for r in rows} == {i for ids in homes.values() for i in sorted(ids)[1:]}
    for r in rows:
        piece = docs[r.doc_id].encode()[r.first_byte : r.last_byte].decode().split()
        assert len(piece) == r.n_words
        assert docs[r.doc_id].split()[r.first_word : r.first_word + r.n_words] == piece
        assert " ".join(piece) in " ".join(docs[r.first_doc_id].split())
    left = {r.doc_id: r.text for r in passages.without(frame, passages.repeated_passages(frame)).collect()}
    gone = {}
    for r in rows:
        gone[r.doc_id] = gone.get(r.doc_id, 0) + r.n_words
    for i, text in docs.items():
        assert len(text.split()) - len(left[i].split()) == gone.get(i, 0)
        assert i in gone or left[i] == text


def test_near_paragraphs(spark):
    """One word changed in a line of thirty: the paragraphs around it repeat, and that with the change by its Jaccard at most."""
    rng = np.random.default_rng(8)
    base = prose(rng, 200, "n")
    other = list(base)
    other[100] = "changed"
    frame = spark.createDataFrame([(5, " ".join(base)), (9, " ".join(other))], "doc_id long, text string")
    rows = passages.repeated_passages(frame).collect()
    assert {r.doc_id for r in rows} == {9} and {r.first_doc_id for r in rows} == {5}
    assert sum(r.n_words for r in rows) >= 150


def test_edges(spark):
    long = " ".join(prose(np.random.default_rng(1), 20000, "l"))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 500), (5, "word " * 500), (6, long), (7, long), (7, long), (None, long), (8, "é ü " * 40)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, times int")
    found = passages.repeated_passages(frame).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(5, 4), (7, 6)}
    assert {(r.doc_id, r.n_words) for r in found} == {(5, 500), (7, 20000)}
    assert passages.repeated_passages(frame.limit(0)).count() == 0
    left = passages.without(frame, passages.repeated_passages(frame))
    assert left.columns == ["doc_id", "text", "times"] and left.count() == len(rows)


def test_two_texts_of_an_id_are_two_documents(spark):
    rng = np.random.default_rng(6)
    shared, clean, other = prose(rng, 120, "s"), " ".join(prose(rng, 600, "c")), prose(rng, 300, "o")
    rows = [(1, " ".join(shared)), (5, clean), (5, " ".join(other + shared)), (5, " ".join(other + shared))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(frame)
    assert [(r.doc_id, r.first_doc_id) for r in found.collect()] == [(5, 1)]
    left = sorted(r.text for r in passages.without(frame, found).collect())
    assert left[:2] != left[1:3] and clean in left and rows[0][1] in left
    assert [len(t.split()) < 320 for t in left if t.startswith("o")] == [True, True]


def test_a_filter_on_what_is_left_cuts_no_second_time(spark, capsys):
    """A second pass of Python in a task is a second worker, which stays and holds what later stages broadcast."""
    frame = spark.createDataFrame([(1, "one two three"), (2, "one two three four"), (3, None)], "doc_id long, text string")
    spans = frame.where("doc_id < 3").select("doc_id", F.xxhash64("text").alias("text_print"), F.lit(0).cast("long").alias("first_byte"), F.lit(8).cast("long").alias("last_byte"))
    left = passages.without(frame, spans).where(F.length("text") > 5).withColumn("n", F.length("text"))
    left.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython [") == 1
    assert [tuple(r) for r in left.collect()] == [(2, "three four", 10)]


def test_query_misses_no_long_passage(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    holders, short = {}, {}
    for i, w in docs.items():
        for size, table in ((60, holders), (20, short)):
            for k in range(len(w) - size + 1):
                table.setdefault(tuple(w[k : k + size]), set()).add(i)
    must = {i for ids in holders.values() if len(ids) > 1 for i in sorted(ids)[1:]}
    found = {r.doc_id for r in QUERIES["op6_substring_dedup"](spark, folder).collect()}
    assert len(must) > 5 and len(must - found) <= 0.02 * len(must)


def test_shingles_are_made_only_where_they_are_used():
    rng = np.random.default_rng(12)
    texts = ["a b c", "one", "same " * 300, "", " ".join(prose(rng, 400, "z")) + "\n" + " ".join(prose(rng, 3, "y")), "r s t u v r s t u v r s t u v"]
    flat, offsets = passages.text_bytes(pa.array(texts))
    with np.errstate(over="ignore"):
        plain, whole = passages.paragraphs(flat, offsets, shingles=False), passages.paragraphs(flat, offsets)
    assert "shingle" not in plain and all((plain[c] == whole[c]).all() for c in plain)
    assert whole["words"].max() <= passages.LONGEST and whole["words"].sum() == sum(len(t.split()) for t in texts)
    # A paragraph has as many shingles as places, one if it is short; those of the text that repeats a word are all alike.
    held = np.bincount(whole["owner"], minlength=len(whole["words"]))
    assert (held == np.maximum(whole["words"] - passages.WORDS + 1, 1)).all()
    (batch,) = passages._contents(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    sets = {p: np.frombuffer(x, np.uint64) for p, x in zip(batch.column("print").to_pylist(), batch.column("shingles").to_pylist())}
    for i, p in enumerate(passages.long_array(whole["print"]).to_pylist()):
        assert (sets[p] == whole["shingle"][whole["owner"] == i]).all()
    assert len(sets) == batch.num_rows
