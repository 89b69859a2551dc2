"""From raw documents to token ids: the stages of the corpus, each one an operator of ``obsload.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before has kept; what it
returns is written as Parquet and read again. All but the last return the columns of ``documents``.

* Rows go where the text is null or has no letter, or where its language is predicted with a
  probability under one half. Rows without language teach nothing; none goes for its label. Where no row
  teaches a language nothing is predicted, and every text with a letter stays.
* Of each group of near copies one row stays, that of the smallest ``doc_id``; rows without id come last,
  and a hash of the row decides between rows of one id. Rows of one id that differ in text are each judged
  by their own group.
* Rows go that hold four fifths or more of a benchmark item. ``benchmark`` may be empty.
* Personal data is replaced; no row goes.
* Texts become ids and the length of what these decode to. The empty text has no ids. A column that bears
  the name of a result is replaced.

An empty table passes all stages. Repeated rows leave one row.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsload.llm import bpe, langid, simhash, surrogates, tiling
from obsload.llm.names import free
from obsload.llm.registry import table
from obsload.workspace import work_path

SURE = 0.5
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: replaced or made by the last stage
MADE = ("text", "ids", "n_tokens", "decoded_chars", "decoded_sha256")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    pred, sure = free(docs, "_pred", "_sure")
    named = langid.with_language(docs, model, pred=pred, score=sure)
    return named.where((F.col(pred) != "und") & (F.col(sure) >= SURE)).select(*[f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs, all_without_id=False)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = surrogates.with_surrogates(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (coded,) = free(docs, "_coded")
    kept = [f"`{c}`" for c in docs.columns if c not in MADE]
    made = docs.select(*kept, bpe.coded("text", TOKENIZER, docs).alias(coded))
    return made.select(
        *kept,
        f"{coded}.ids",
        (F.octet_length(f"{coded}.ids") / 4).cast("long").alias("n_tokens"),
        F.length(f"{coded}.decoded").cast("long").alias("decoded_chars"),
        F.sha2(F.encode(f"{coded}.decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", languages),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: fitted models, similarity and string tiling are beyond SQL; the tests compare with plain Python
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
