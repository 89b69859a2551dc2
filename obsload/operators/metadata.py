"""Validation of mapping templates, all violations of all templates in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_mapping_issues(mappings: DataFrame, dictionary_table: DataFrame) -> DataFrame:
    """Faults of field mappings ``(id_mapping, values JSON)`` as ``(id_mapping, key, fault)``.

    Keys must be displayed fields, mandatory fields must be present, and values be a boolean for
    generated fields, a list for multi fields and a string otherwise.
    """
    shown = dictionary_table.where("display").select(
        F.col("field").alias("key"), "mandatory", "generated", "multi"
    )
    parsed = mappings.select("id_mapping", F.from_json("values", "map<string,variant>").alias("m"))
    pairs = parsed.select("id_mapping", F.explode("m").alias("key", "value")).withColumn(
        "kind", F.schema_of_variant("value")
    )
    known = pairs.join(F.broadcast(shown), "key", "left")
    expected = (
        F.when(F.col("generated"), F.col("kind") == "BOOLEAN")
        .when(F.col("multi"), F.col("kind").startswith("ARRAY"))
        .otherwise(F.col("kind") == "STRING")
    )
    wrong = known.select(
        "id_mapping",
        "key",
        F.when(F.col("mandatory").isNull(), "unknown key").when(~expected, "wrong type").alias("fault"),
    ).where(F.col("fault").isNotNull())
    # mandatory fields come from the dictionary, a fixed handful
    required = shown.where("mandatory").agg(F.collect_set("key").alias("required"))
    missing = (
        parsed.withColumn("required", required.scalar())
        .select(
            "id_mapping",
            F.explode(F.array_except("required", F.map_keys("m"))).alias("key"),
            F.lit("missing key").alias("fault"),
        )
    )
    return wrong.unionByName(missing)


def content_mapping_issues(entries: DataFrame, vocabulary: DataFrame, used: list[str]) -> DataFrame:
    """Faults of content mappings exploded to ``(id_mapping, vocab, value, code)``.

    Vocabularies must belong to a coded field and codes to their vocabulary.
    """
    known = F.col("vocab").isin(*used)
    strange = entries.where(~known).withColumn("fault", F.lit("unknown vocabulary"))
    foreign = (
        entries.where(known)
        .join(vocabulary.select("vocab", "code").distinct(), ["vocab", "code"], "left_anti")
        .withColumn("fault", F.lit("unknown code"))
    )
    columns = ["id_mapping", "vocab", "value", "code", "fault"]
    return strange.select(columns).unionByName(foreign.select(columns))


def repeated_labels(mappings: DataFrame) -> DataFrame:
    """Labels borne by several templates of one type."""
    return (
        mappings.groupBy("type", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )


def position_mapping_ok(mapping: Column) -> Column:
    """Rule on the position fields of a field mapping: a geometry, both axes, or an area code.

    X and Y come together; a mapping giving none of the three is refused.
    """

    def given(name: str) -> Column:
        return F.try_element_at(mapping, F.lit(name)).isNotNull()

    one_axis = given("longitude") != given("latitude")
    code = given("codecommune") | given("codemaille") | given("codedepartement")
    return ~one_axis & (given("WKT") | given("longitude") | code)


def inconsistent_terms(rows: DataFrame, dictionary_table: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows ``(target, id)`` whose term is not in the vocabulary of their field."""
    allowed = (
        dictionary_table.where(F.col("vocab").isNotNull())
        .select(F.col("field").alias("target"), "vocab")
        .join(vocabulary.select("vocab", "id"), "vocab")
        .select("target", "id")
    )
    return rows.join(allowed, ["target", "id"], "left_anti")


def field_catalogue(dictionary_table: DataFrame, themes: DataFrame) -> DataFrame:
    """Displayed fields nested in their themes, both in display order."""
    listed = dictionary_table.where("display").groupBy("theme").agg(
        F.array_sort(
            F.collect_list(F.struct("order_field", "field", "mandatory", "generated", "multi"))
        ).alias("fields")
    )
    return themes.join(listed, "theme").orderBy("order_theme").select("theme", "order_theme", "fields")


def vocabulary_catalogue(dictionary_table: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabularies of coded fields with their terms as a map from code to label."""
    used = dictionary_table.where(F.col("vocab").isNotNull()).select("vocab").distinct()
    terms = vocabulary.join(used, "vocab", "left_semi").groupBy("vocab", "code").agg(
        F.min("label").alias("label")
    )
    return terms.groupBy("vocab").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "label")))).alias("terms")
    )
