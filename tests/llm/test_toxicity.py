"""Exact neighbours, held-out accuracy, calibration and odd input."""

import numpy as np
from pyspark.sql import functions as F

from obsload.llm import toxicity
from obsload.llm.queries import op6_toxicity

FOLDER = "/root/testdata/sf0.1"


def made_index(seed=0, n=700, terms=120):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = np.unique(rng.zipf(1.4, 12).clip(1, terms) - 1)
        rows.append((i, int(rng.integers(2)), at, rng.integers(1, 5, len(at))))
    return toxicity.Index.of([f"t{i}" for i in range(terms)], rng.uniform(1, 5, terms), rows, 0.3), rows


def test_neighbours_are_the_exact_nearest():
    index, rows = made_index()
    dense = np.zeros((len(rows), 120))
    for i, (_, _, at, n) in enumerate(rows):
        dense[i, at] = toxicity._normed(at, n, index.idf)
    for at, q in ((np.flatnonzero(d), d[d > 0]) for d in dense[:200]):
        near, sims = index.nearest(at, q)
        all_ = dense[:, at] @ q
        expected = np.sort(all_[all_ > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(sims, expected) and np.allclose(all_[near], sims)


def test_held_out_accuracy_and_calibration(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    out = op6_toxicity(spark, FOLDER)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "evidence"]
    rows = out.join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    assert len(rows) > 500 and (p >= 0).all() and (p <= 1).all()
    assert ((p >= 0.5) == (y == 1)).mean() > 0.96
    assert abs(p.mean() - y.mean()) < 0.03


def test_nulls_empty_texts_repeats_and_one_label(spark):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} word{i} thing", 1) for i in range(40)] + [(90, None, 1), (91, "", 1), (None, "vile", 1), (1, "vile", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = [(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (5, None), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    index = toxicity.build(docs, labels, F.lit(True))
    out = toxicity.with_toxicity(docs, index)
    assert out.columns == ["doc_id", "text", "score", "evidence", "predicted"]
    got = {(r["doc_id"], r["text"]): r["score"] for r in out.collect()}
    assert got[None, "vile"] == got[1, "vile"] > 0.5 > got[2, "kind word2 thing"]
    assert got[90, None] == got[91, ""]
    one = toxicity.build(docs, labels.where("toxic = 1"), F.lit(True))
    assert {r["score"] for r in toxicity.with_toxicity(docs, one).collect()} == {1.0}
    none = toxicity.build(docs.limit(0), labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.with_toxicity(docs, none).collect()} == {0.0}


def test_ids_of_other_types_and_private_names(spark):
    rows = [(f"d{i}", f"{'vile' if i % 2 else 'kind'} thing", "keep") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _id string").withColumn("_rated", F.lit(1))
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, toxic int")
    out = toxicity.with_toxicity(docs, toxicity.build(docs, labels, F.lit(True))).collect()
    assert all(r["predicted"] == int(r["text"].startswith("vile")) for r in out)
    assert all(r["evidence"][0].startswith("d") and r["_id"] == "keep" and r["_rated"] == 1 for r in out)
