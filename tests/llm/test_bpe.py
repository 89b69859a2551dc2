"""Ids and decoded texts equal those of the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from obsload.llm import bpe
from obsload.llm.queries import op10_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.Vocabulary.read(PATH)
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "\t\ta", "it's we'll 'tis !'s \n'd 'S",
    "aaaaaaaa aaaaaaa", "x" * 3000, "é" * 301, "日本語 テスト 123456 ½", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x",
    "\x1c\x1d a\x85b c d 　e", "🙂🙂 x‍", "'re're 've", "-- --", "a\r\nb  \r\n  c", "\x00 \x00",
]


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(VOCABULARY).encode(texts)]


def test_odd_texts_match_the_library():
    for text, ids in zip(ODD, ids_of(ODD), strict=True):
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)
        back = bpe.decode_ids(np.array(ids, "<u4").tobytes(), VOCABULARY)
        assert back == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 's\n\tZ9é日.-! ́'rev"))) | st.text())
def test_any_text_matches_the_library(text):
    assert ids_of([text])[0] == LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 50256), max_size=12))
@settings(max_examples=100, deadline=None)
def test_any_ids_decode_as_the_library_does(ids):
    found = bpe.decode_ids(np.array(ids, "<u4").tobytes(), VOCABULARY)
    assert found == LIBRARY.decode(ids, skip_special_tokens=False)


def test_ids_outside_the_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([50257], "<u4").tobytes(), VOCABULARY)


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (1, "", "z"), (1, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.with_ids(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids"]
    assert sorted(len(r["ids"]) for r in out.collect()) == [0, 0, 8, 8]
    assert bpe.with_ids(docs.limit(0), PATH).count() == 0


def test_query_matches_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op10_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_texts_are_encoded_once_a_row(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, coded string")
    for made in (op10_bpe(spark, "/root/testdata/sf0.001"), corpus_pipeline.token_ids(spark, docs, "")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [both(") == 1 and plan.count("both(") == plan.count("ArrowEvalPython")
    both = docs.select("doc_id", bpe.coded("text", PATH, docs).alias("c")).select("doc_id", "c.ids", "c.decoded")
    assert {r["doc_id"]: (len(r["ids"]), r["decoded"]) for r in both.collect()} == {1: (8, "a b"), 2: (0, "")}


def test_very_long_texts_are_encoded_whole():
    long = "some words and 12 numbers, " * (bpe.CHUNK_CHARS // 25)
    assert len(long) > bpe.CHUNK_CHARS
    found = [x for c in bpe._chunks(pa.array(["a", long, None, "b"])) for x in bpe.Encoder(VOCABULARY).encode(c)]
    assert np.frombuffer(found[1], "<u4").tolist() == LIBRARY.encode(long, add_special_tokens=False).ids
    assert found[2] == b"" and bpe.decode_ids(found[1], VOCABULARY) == long
