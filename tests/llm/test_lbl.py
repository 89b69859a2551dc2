"""Base score against plain counting; the model's probabilities add up and beat the base on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsload.llm import lbl
from obsload.llm.queries import op7_lbl

FOLDER = "/root/testdata/sf0.01"


def plain_tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


@pytest.mark.parametrize("heavy", [lbl.HEAVY, 50])
def test_base_score_against_plain_counting(spark, monkeypatch, heavy):
    monkeypatch.setattr(lbl, "HEAVY", heavy)
    monkeypatch.setattr(lbl, "WORDS", 20)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    counts = Counter(t for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for t in plain_tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in op7_lbl(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, words = got[r["doc_id"]], plain_tokens(r["text"])
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(words), sum(w in counts for w in words), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)


def test_probabilities_of_every_context_add_up(spark, monkeypatch):
    monkeypatch.setattr(lbl, "WORDS", 30)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = lbl.word_counts(docs, "text").cache()
    v = lbl.vocabulary(counts)
    model = lbl.train(docs, v, "text")
    first, second, norm = model.tables()
    rng = np.random.default_rng(0)
    for a, b in rng.integers(0, v.outputs, (20, 2)):
        p = np.exp(first[a].astype(float) + second[b] - norm[a, b])
        assert p.sum() == pytest.approx(1, abs=1e-3)
    # inside a class, words seen and the one part of the unseen
    inside = Counter()
    kept = sorted(((r["n"], bytes(r["word"])) for r in counts.collect() if r["word"]), key=lambda x: (-x[0], x[1]))
    for n, word in kept[30:]:
        inside[lbl.class_of(word)] += n + 1
    for c, total in inside.items():
        assert 10 ** v.share[31 + c] * (total + 1) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = op7_lbl(spark, FOLDER).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert rows[0] > rows[1] + 0.05 * rows[2]


def test_nulls_empty_texts_and_repeats(spark):
    rows = [(1, "a b a", "x"), (2, None, "y"), (3, "", "z"), (None, "a zzz", "w"), (1, "a b a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = [tuple(r) for r in lbl.scored(docs, F.lit(True)).select("doc_id", "n_tokens", "n_known", "train_tokens").collect()]
    assert sorted(got, key=str) == sorted([(1, 4, 4, 10), (1, 4, 4, 10), (2, 1, 1, 10), (3, 1, 1, 10), (None, 3, 2, 10)], key=str)
    assert lbl.scored(docs.limit(0), F.lit(True)).count() == 0
    none = lbl.scored(docs, F.lit(False)).collect()
    assert len(none) == 5 and all(r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in none)


def test_a_chunk_of_one_token(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "")], "doc_id long, text string")
    v = lbl.vocabulary(lbl.word_counts(docs, "text").cache())
    whole, alone = lbl._stream(["a b a", None], v), lbl._stream([None], v)
    for x in alone[1:5]:
        assert len(x) == 1
    assert [x[-1] for x in whole[2:5]] == [x[0] for x in alone[2:5]]
    assert lbl._stream(["a"], v)[4].tolist() == [v.end, v.end]
