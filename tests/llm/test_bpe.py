import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilmesh.llm import bpe
from vigilmesh.llm.queries import QUERIES, tokenizer

ENCODING = bpe.encoder(*tokenizer())

ALPHABET = st.sampled_from(
    ["a", "the", "'", "'s", "'re", "R", "E", " ", "  ", "\n", "\t", "1", "23", "!", "--", "é", "ß", "中", "文字", "　", "😀", "S", "zz"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=60), st.integers(1, 9))
def test_tree_equals_plain_encoding(parts, leaf):
    text = "".join(parts)
    assert bpe.encode_tree(ENCODING, text, leaf=leaf) == ENCODING.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab", "x7", "9", "!?", "-", "é", "中文", " ", "\n ", "thequickbrown", "'s", "A'"])
def test_long_runs(unit):
    rng = np.random.default_rng(3)
    noise = "".join(chr(97 + c) for c in rng.integers(0, 26, 20000))
    for text in (unit * 9000, "start " + unit * 7000 + noise + unit * 300):
        assert bpe.encode_tree(ENCODING, text) == ENCODING.encode_ordinary(text)
        assert bpe.decode_tree(ENCODING, bpe.encode_tree(ENCODING, text)) == text.encode()


def test_edges_and_segments(spark):
    path, pattern = tokenizer()
    texts = [None, "", " ", "a", "word " * 40000, "q" * 150000, ("naïve 12 " * 9000 + "it's").strip(), "same", "same"]
    ids = [1, 2, 3, 4, 5, None, 7, 8, 8]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n_tokens int, row string")
    rows = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.bytes)) for r in rows)
    want = []
    for i, text in zip(ids, texts):
        tokens = ENCODING.encode_ordinary(text or "")
        want.append((i or 0, len(tokens), np.array(tokens, "<u4").tobytes(), (text or "").encode()))
    assert got == sorted(want)
    assert bpe.encode(docs.limit(0), path, pattern).count() == 0


def test_query_against_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op10_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = ENCODING.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(tokens)
        assert r.ids_sha256 == hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
