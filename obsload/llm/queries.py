"""One query for each text operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from obsload.llm import (
    blocks,
    bpe,
    editprint,
    langid,
    lbl,
    quality,
    simhash,
    suffixes,
    surrogates,
    tiling,
    toxicity,
    variants,
    whitening,
)
from obsload.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@query("op10_bpe")
def op10_bpe(spark, folder):
    """Digests of the ids of every document and of the text they decode to."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.coded("text", BYTE_BPE, docs).alias("coded"))
    return coded.select(
        "doc_id",
        (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("coded.decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


@query("op1_simhash")
def op1_simhash(spark, folder):
    """Fingerprint and component of every document, three words a shingle and two bits apart."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_langid")
def op8_langid(spark, folder):
    """Language of every document, learned from the documents outside the fold that is held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = langid.remainder("doc_id", 4)
    model = langid.fit(docs, fold != 2)
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return langid.with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


@query("op2_quality")
def op2_quality(spark, folder):
    """Base counts of every document and the verdict of the weighed rules."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *counts, "base_failed", "kept", "posterior")


@query("op3_tiling")
def op3_tiling(spark, folder):
    """Documents that hold benchmark items, with the share of the item that tiles cover."""
    found = tiling.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    best = F.max(F.struct("coverage", "longest", "n_tiles", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


@query("op9_surrogates")
def op9_surrogates(spark, folder):
    """Every document with its personal data replaced, and how many entities it held."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, count="n_entities")


@query("op5_suffixes")
def op5_suffixes(spark, folder):
    """What removing repeated strings of 200 bytes leaves of every document."""
    cleared = suffixes.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cleared.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_toxicity")
def op6_toxicity(spark, folder):
    """Toxicity of every document, learned from the labels outside the fold that is held out."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    fold = langid.remainder("doc_id", 5)
    index = toxicity.build(docs, labels.select("doc_id", "toxic"), fold != 0)
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return toxicity.with_toxicity(docs, index).select("doc_id", held_out, "score", "predicted", "evidence")


@query("op7_lbl")
def op7_lbl(spark, folder):
    """Log-probability of every document, learned from the documents outside the fold that is held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = langid.remainder("doc_id", 7)
    found = lbl.scored(docs, fold != 2)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), *found.columns[1:])


@query("op4_blocks")
def op4_blocks(spark, folder):
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    read = blocks.with_main_text(pages, blocks.learned(pages))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_whitening")
def op11_whitening(spark, folder):
    """Every vector on the eight leading components of all, whitened."""
    return whitening.whitened(table(spark, folder, "embeddings"))


@query("op12_variants")
def op12_variants(spark, folder):
    """Words of all documents with their near words, forms and roots."""
    return variants.variants(table(spark, folder, "documents"))


@query("op13_editprint")
def op13_editprint(spark, folder):
    """Fingerprints of every document and of its text edited by the next one, with their likeness."""
    return editprint.with_next(table(spark, folder, "documents"))
