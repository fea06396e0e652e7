import hashlib

import numpy as np

import corpus_pipeline
from tests.llm.test_jaccard import expected
from tests.llm.test_mixing import fill
from vigilmesh.llm import bpe
from vigilmesh.llm.queries import tokenizer

SMALL = "/root/testdata/sf0.001"


def rows_of(frame):
    return frame.select("doc_id", "text", "source", "n_chars").collect()


def words(text):
    return (text or "").split()


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    tables, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, at, SMALL).write.parquet(path)
        at = spark.read.parquet(path)
        tables[name] = at
        if name != "byte_bpe":
            assert at.columns == docs.columns and at.dtypes == docs.dtypes

    whole, clean = rows_of(docs), rows_of(tables["toxicity"])
    gone = {r.doc_id for r in whole} - {r.doc_id for r in clean}
    assert sum(toxic.get(i, 1) for i in gone) >= 0.9 * len(gone)
    assert len(clean) + len(gone) == len(whole)

    want = expected([(r.doc_id, r.text) for r in clean])
    single = rows_of(tables["ngram_jaccard_join"])
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, c) in want.items() if i == c)

    before, cut = {r.doc_id: r for r in single}, rows_of(tables["substring_dedup"])
    for r in cut:
        left, old = words(r.text), iter(words(before[r.doc_id].text))
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text or len(left) < len(words(before[r.doc_id].text)))
        assert all(any(w == o or o.endswith(w) or o.startswith(w) for o in old) for w in left[:50])
    seen = {}
    for r in cut:
        w = words(r.text)
        for k in range(len(w) - 59):
            seen.setdefault(tuple(w[k : k + 60]), set()).add(r.doc_id)
    assert sum(len(ids) > 1 for ids in seen.values()) <= 0.01 * max(1, len(seen))

    totals, largest, taken = {}, {}, {}
    for r in cut:
        n = len(words(r.text))
        totals[r.source], largest[r.source] = totals.get(r.source, 0) + n, max(largest.get(r.source, 0), n)
    mixed = rows_of(tables["mixing"])
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    for source, target in fill(totals).items():
        assert abs(taken.get(source, 0) - target) <= 2 * largest[source]

    encoding = bpe.encoder(*tokenizer())
    want = []
    for r in mixed:
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tables["byte_bpe"].collect()]
    assert sorted(got) == sorted(want)


def test_run_and_edges(spark, tmp_path):
    folder = str(tmp_path)
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "two", None, None, 3), (4, "w " * 30000, "en", "b", 60000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(odd, kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, 4, None} and 4 in {r.doc_id for r in out}
    empty = tmp_path / "empty"
    spark.createDataFrame([], kind).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    """Two texts of an id are two documents, a row without an id is one, and equal rows are one."""
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [(7, text("a")), (7, text("b")), (None, text("c")), (None, text("d")), (None, text("a")), (9, text("b") + " more"), (3, text("e")), (3, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text) for r in single)) == sorted([(7, text("a")), (7, text("b")), (0, text("c")), (0, text("d")), (3, text("e"))])
    mixed = corpus_pipeline.mix_sources(spark, docs.dropDuplicates(["doc_id", "text"]), "").collect()
    sizes = {t: len(t.split()) for _, t in rows}
    total = sum(sizes[t] for _, t in set(rows))
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * total) <= 2 * max(sizes.values())
    assert {(r.doc_id, r.text) for r in mixed} <= set(rows)
