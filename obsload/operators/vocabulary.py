"""Controlled vocabularies: value mapping, defaults, and the rules between coded fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsload.model.dictionary import Field
from obsload.operators.issues import Check
from obsload.operators.keyed import BROADCAST_BYTES, BROADCAST_KEYS, fetch
from obsload.workspace import small_enough, written

PROOF_VOCABULARY, PROOF_YES = "PREUVE_EXIST", "Oui"
SOURCE_VOCABULARY, SOURCE_LITERATURE = "STATUT_SOURCE", "Li"


def exploded_mappings(mappings: DataFrame) -> DataFrame:
    """``(id_load, mapping JSON)`` to ``(id_load, vocab, value, code)``."""
    parsed = mappings.select(
        "id_load", F.from_json("mapping", "map<string,map<string,string>>").alias("m")
    )
    return parsed.select("id_load", F.explode("m").alias("vocab", "codes")).select(
        "id_load", "vocab", F.explode("codes").alias("value", "code")
    )


def mapping_rows(spark: SparkSession, content_mapping: dict) -> DataFrame:
    """A content mapping held on the driver as ``(vocab, value, code)``."""
    rows = [(v, value, code) for v, codes in content_mapping.items() for value, code in codes.items()]
    return spark.createDataFrame(rows, "vocab string, value string, code string")


def value_terms(mapping: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Source values with the term their code stands for; codes no longer in use drop out.

    One line for each value: of terms that share a code the lowest identifier counts.
    """
    terms = vocabulary.groupBy("vocab", "code").agg(F.min("id").alias("id"))
    return mapping.join(terms, ["vocab", "code"]).groupBy("vocab", "value").agg(F.min("id").alias("id"))


def mapped_by_join(
    df: DataFrame, f: Field, terms: DataFrame, spread: Column, broadcast: bool = False
) -> DataFrame:
    """One coded field looked up among ``terms(vocab, value, id)``, which hold each value once.

    ``broadcast`` picks the way of the join only; the rows are the same.
    """
    own = terms.where(F.col("vocab") == f.vocab).select(
        F.col("value").alias("_value"), F.col("id").cast("int").alias(f.name)
    )
    keyed = df.drop(f.name).withColumn("_value", F.coalesce(F.col(f.source_column), F.lit("")))
    if broadcast:
        return keyed.join(F.broadcast(own), "_value", "left").select(*[c for c in keyed.columns if c != "_value"], f.name)
    return fetch(keyed, own, ["_value"], [f.name], spread).drop("_value")


def map_values(
    df: DataFrame,
    fields: list[Field],
    content_mapping: dict,
    vocabulary: DataFrame,
    spread: Column,
    broadcast_rows: int = BROADCAST_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Term of every mapped coded field; null where the mapping does not know the value.

    The values are written and measured: below both limits they are broadcast, above they are looked
    up by key.
    """
    if not fields:
        return df
    used = {f.vocab: content_mapping.get(f.vocab, {}) for f in fields}
    mapping = mapping_rows(df.sparkSession, {v: codes for v, codes in used.items() if codes})
    terms = written(value_terms(mapping, vocabulary).coalesce(1), "terms")
    small = small_enough(terms, broadcast_rows, broadcast_bytes)
    for f in fields:
        df = mapped_by_join(df, f, terms, spread, small)
    return df


def default_terms(vocabulary: DataFrame, vocabs: list[str]) -> dict[str, int]:
    """Default term per vocabulary; one row each."""
    rows = (
        vocabulary.where(F.col("is_default") & F.col("vocab").isin(*vocabs))
        .groupBy("vocab")
        .agg(F.min("id").alias("id"))
        .collect()
    )
    return {r["vocab"]: r["id"] for r in rows}


def fill_defaults(
    df: DataFrame, coded: list[Field], mapped: set[str], defaults: dict[str, int], fill_mapped: bool
) -> DataFrame:
    """Default term where the source is empty and no term was found.

    Unmapped fields always receive it; mapped ones when ``fill_mapped``.
    """
    filled: dict[str, Column] = {}
    for f in coded:
        default = F.lit(defaults.get(f.vocab)).cast("int")
        if f.name not in mapped:
            filled[f.name] = default
        elif fill_mapped:
            empty = F.coalesce(F.col(f.source_column), F.lit("")) == ""
            filled[f.name] = F.coalesce(F.col(f.name), F.when(empty, default))
    return df.withColumns(filled)


def unknown_value_checks(fields: list[Field], label) -> list[Check]:
    return [
        Check("INVALID_NOMENCLATURE", label(f.name), F.col(f.name).isNull(), F.col(f.source_column))
        for f in fields
    ]


def term_id(vocabulary: DataFrame, vocab: str, column: str, value: str) -> int | None:
    row = vocabulary.where((F.col("vocab") == vocab) & (F.col(column) == value)).select("id").first()
    return None if row is None else row["id"]


def _filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def proof_disagrees(status: Column, yes: int | None, proofs: list[str]) -> Column:
    """"Yes" without a proof, or a proof without "yes"; an unknown status is not reported."""
    is_yes = status == F.lit(yes).cast("int")
    proven = reduce(lambda a, b: a | b, [_filled(p) for p in proofs])
    return (is_yes & ~proven) | (~is_yes & proven)


def unreferenced_literature(status: Column, literature: int | None, reference: Column) -> Column:
    """Status "literature" without a bibliographic reference."""
    return (status == F.lit(literature).cast("int")) & (F.coalesce(reference, F.lit("")) == "")
