"""The pipeline's stages on the given documents and on odd rows, against plain Python."""

import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def staged(spark, docs, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    return docs


def test_stages_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spoken = staged(spark, docs, 1)
    assert spoken.columns == docs.columns and spoken.count() == len(texts)  # clean documents stay
    groups = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    single = staged(spark, docs, 2)
    assert {r["doc_id"] for r in single.collect()} == set(groups.values())
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaking = {i for i in set(groups.values()) if any(" ".join(w) in " ".join(re.findall(r"\w+", texts[i].lower())) for w in items)}
    clean = staged(spark, docs, 3)
    left = {r["doc_id"] for r in clean.collect()}
    assert left == set(groups.values()) - leaking
    private = {r["doc_id"]: r for r in staged(spark, docs, 4).collect()}
    assert private.keys() == left
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == left
    for r in rows:
        text = private[r["doc_id"]]["text"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert r["decoded_chars"] == len(text) == private[r["doc_id"]]["n_chars"]


def test_odd_rows_pass_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    said = "the house and the garden of the man who sold the boat to her"
    rows = [
        (1, said, "en", None, None, "a"),
        (1, said, "en", None, None, "a"),
        (2, said.upper(), "en", "s", 1, "b"),
        (3, None, None, "s", 0, "c"),
        (4, "", "en", "s", 0, "d"),
        (5, "12 34 !!", None, "s", 0, "e"),
        (None, "la casa y el jardín del hombre que vendió el barco " * 300, "es", "s", 0, None),
    ]
    for name, data in (("full", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert sorted(str(r["doc_id"]) for r in out.collect()) == (["1", "None"] if data else [])
    assert out.where(F.col("n_tokens") < 0).count() == 0


def test_texts_with_a_letter_stay_where_no_row_has_a_language(spark, tmp_path):
    rows = [(1, "the house and the garden", None), (2, "Дом и сад", None), (3, "12 34 !!", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.languages(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}
    unnamed = spark.createDataFrame([(None, "the house", "en")], docs.schema)
    assert corpus_pipeline.languages(spark, unnamed, str(tmp_path)).count() == 1


def test_one_row_of_each_group_whatever_the_ids(spark):
    near = "the house and the garden of the man who sold the boat to her"
    a, b, c, d = "seven ships sailed south", "old bread is hard to cut", "rain fell on all the roofs", "no bell rang that night"
    rows = [(3, near, "x"), (7, near.upper(), "x"), (7, a, "x"), (9, b, "x"), (9, c, "x"), (9, c, "x"), (9, c, "y")]
    rows += [(None, d, "x"), (None, d, "x"), (None, d, "y"), (None, near, "x"), (12, None, "x"), (12, a, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [corpus_pipeline.near_copies(spark, docs.repartition(n), FOLDER) for n in (1, 5)]
    assert found[0].columns == docs.columns
    one, other = ([tuple(r) for r in out.collect()] for out in found)
    assert sorted((r[0] or 0, r[1] or "") for r in one) == sorted([(3, near), (7, a), (9, b), (9, c), (0, d), (12, "")])
    assert set(one) == set(other)  # whichever way the rows lie


def test_columns_named_like_those_of_the_stages(spark, tmp_path):
    names = ["_id", "_row", "_hash", "_pred", "_sure", "_language", "_replaced", "_attempts", "_row_key", "_coded", "_decoded", "_CODED"]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        schema = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
        rows = [
            (1, "the house and the garden of the man who sold the boat to anna.berg@example.com", "en"),
            (2, "la casa y el jardín del hombre que vendió el barco a su hermana", "es"),
        ]
        folder = str(tmp_path)
        docs = spark.createDataFrame([(*r, *[f"keep {n}" for n in names]) for r in rows], schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "other words than those of the texts")], "item_id long, text string").write.parquet(
            f"{folder}/benchmark.parquet"
        )
        out = corpus_pipeline.run(spark, folder).collect()
        assert len(out) == 2 and all(r[n] == f"keep {n}" for r in out for n in names)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
