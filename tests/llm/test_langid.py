"""Held-out accuracy, calibration and odd input of language identification."""

import numpy as np
from pyspark.sql import functions as F

from obsload.llm import langid
from obsload.llm.queries import op8_langid

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_scores(spark):
    rows = op8_langid(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"]]
    right = np.array([r["lang_pred"] == r["lang"] for r in held])
    scores = np.array([r["score"] for r in held])
    assert len(held) > 150 and right.mean() > 0.97
    assert (scores >= 0).all() and (scores <= 1).all()
    assert abs(scores.mean() - right.mean()) < 0.05


def test_counts_of_blocks_equal_counts_of_the_whole(monkeypatch):
    text = "Ünïcode 🙂 text, a b c " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    cut = langid.counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_temperature_is_found():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    classes = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.fit_temperature(logits * 4, classes) - 4) < 0.4


def test_nulls_empty_texts_and_clashing_columns(spark):
    rows = [(1, "le la les des", "fr", 1), (2, "the and of", "en", 2), (3, None, "en", 3), (None, "12 34", None, 4), (5, "", "fr", 5), (1, "le la les des", "fr", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(docs, F.lit(True))
    assert model.languages == ["en", "fr"]
    out = langid.with_language(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    found = [(r["lang_pred"], r["score"]) for r in out.collect()]
    assert found[2] == found[3] == found[4] == ("und", 0.0)
    assert found[0] == found[5] and found[0][0] in ("en", "fr")
    empty = langid.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.with_language(docs, empty).collect()} == {"und"}
