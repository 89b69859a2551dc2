"""Field mappings: projecting file columns onto the dictionary, and the algebra of mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.scalars import merged_attributes, overlay
from obsload.model.dictionary import DICTIONARY, Dictionary
from obsload.model.loads import Load


def staged_columns(load: Load, dictionary: Dictionary = DICTIONARY) -> dict[str, Column]:
    """Dictionary column -> source expression, for every field the file feeds.

    One file column may feed several fields. Columns no field uses go to ``extra_fields``.
    """
    out: dict[str, Column] = {}
    used: set[str] = set()
    for f in load.mapped(dictionary).values():
        source = load.field_mapping[f.name]
        out[f.source_column] = F.col(f"`{source}`")
        used.add(source)
    for name, columns in load.mapped_lists(dictionary).items():
        out[name] = merged_attributes(columns)
        used.update(columns)
    extra = [c for c in load.columns if c not in used]
    out["extra_fields"] = extra_map(extra)
    return out


def extra_map(columns: list[str]) -> Column:
    """Map of column name to cell over ``columns``."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    names = F.array(*[F.lit(c) for c in columns])
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    return F.map_from_arrays(names, cells)


def overlay_nested(base: Column, top: Column) -> Column:
    """Update of a two-level mapping, vocabulary by vocabulary."""
    nothing = F.create_map().cast("map<string,string>")
    return F.map_zip_with(
        base, top, lambda _, old, new: overlay(F.coalesce(old, nothing), F.coalesce(new, nothing))
    )


def without_key(mapping: Column, key: str) -> Column:
    return F.map_filter(mapping, lambda name, _: name != key)


def autofill(template: DataFrame, file_columns: DataFrame, dictionary_table: DataFrame) -> DataFrame:
    """What a template gives for each file.

    ``template(target, sources ARRAY)`` and ``file_columns(id_file, columns ARRAY)``; kept are
    displayed targets that are generated or have at least one source in the file, list targets with
    the sources present. Files and template meet per source name, an equi-join.
    """
    shown = dictionary_table.where("display").select(
        F.col("field").alias("target"), "generated"
    )
    known = template.join(F.broadcast(shown), "target")
    wanted = known.where(~F.col("generated")).select("target", F.explode("sources").alias("source"))
    present = file_columns.select("id_file", F.explode("columns").alias("source")).distinct()
    by_source = present.join(wanted, "source").groupBy("id_file", "target").agg(
        F.array_sort(F.collect_set("source")).alias("sources")
    )
    # generation flags are the same few for every file
    flags = known.where("generated").agg(F.collect_list(F.struct("target", "sources"))).scalar()
    flagged = (
        file_columns.select("id_file").distinct()
        .select("id_file", F.explode(flags).alias("flag"))
        .select("id_file", "flag.target", "flag.sources")
    )
    return by_source.unionByName(flagged)


def coverage(filled: DataFrame, file_columns: DataFrame, targets: list[str]) -> DataFrame:
    """Mapped and unmapped targets and sources per file, as sorted arrays."""
    used = filled.groupBy("id_file").agg(
        F.collect_set("target").alias("t"),
        F.array_distinct(F.flatten(F.collect_list("sources"))).alias("s"),
    )
    every = F.array(*[F.lit(t) for t in targets])
    none = F.array().cast("array<string>")
    t, s = F.coalesce("t", none), F.coalesce("s", none)
    return file_columns.join(used, "id_file", "left").select(
        "id_file",
        F.array_sort(F.array_intersect(every, t)).alias("mapped_targets"),
        F.array_sort(F.array_except(every, t)).alias("unmapped_targets"),
        F.array_sort(F.array_intersect("columns", s)).alias("mapped_sources"),
        F.array_sort(F.array_except("columns", s)).alias("unmapped_sources"),
    )


def distinct_values(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct cells of several coded columns in one pass: ``(field, value, n)``.

    ``columns`` is field name -> column. Kept as rows, since a column may hold any number of values.
    """
    pairs = F.create_map(
        *[item for name, c in columns.items() for item in (F.lit(name), F.coalesce(F.col(c), F.lit("")))]
    )
    return (
        df.select(F.explode(pairs).alias("field", "value"))
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def numeric_order(code: str = "code") -> list[Column]:
    """Sort keys placing numeric codes first, by number, then the others by text."""
    return [F.col(code).try_cast("int").asc_nulls_last(), F.col(code).asc()]


def terms_in_order(vocabulary: DataFrame) -> DataFrame:
    """Terms of each vocabulary as one array in numeric code order."""
    entry = F.struct(
        F.coalesce(F.col("code").try_cast("int"), F.lit(2**31 - 1)).alias("rank"), "code", "label", "id"
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["code"], e["label"], e["id"])
    )
    return vocabulary.groupBy("vocab").agg(ordered.alias("terms"))


def suggest_by_label(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Term whose label equals the value, lowest code first; null when none does."""
    labelled = vocabulary.groupBy("vocab", F.col("label").alias("value")).agg(
        F.min("code").alias("code")
    )
    return values.join(labelled, ["vocab", "value"], "left")


def suggest_by_template(values: DataFrame, template: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Code a stored mapping ``(vocab, value, code)`` gives, when still in the vocabulary."""
    current = template.join(vocabulary.select("vocab", "code").distinct(), ["vocab", "code"], "left_semi")
    return values.join(current, ["vocab", "value"], "left")


def pivot_rows(rows: DataFrame, by: str = "id_mapping") -> DataFrame:
    """``(mapping, vocab, value, code)`` rows to one two-level map per mapping."""
    single = rows.groupBy(by, "vocab", "value").agg(F.min("code").alias("code"))
    inner = single.groupBy(by, "vocab").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "code")))).alias("codes")
    )
    return inner.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("vocab", "codes"))).alias("mapping")
    )


def field_rows_to_map(rows: DataFrame, dictionary_table: DataFrame) -> DataFrame:
    """``(id_mapping, target, source)`` rows to one JSON object per mapping.

    Empty sources drop out; generation flags become booleans. A mapping without any plain source
    has no object.
    """
    kinds = dictionary_table.select(F.col("field").alias("target"), "generated")
    typed = rows.join(F.broadcast(kinds), "target")
    plain = typed.where(~F.col("generated") & (F.coalesce("source", F.lit("")) != ""))
    entry = F.struct(F.col("target"), F.to_json(F.struct(F.col("source").alias("v"))).alias("v"))

    def object_of(part: DataFrame, value: Column, name: str) -> DataFrame:
        item = F.concat(F.lit('"'), F.col("target"), F.lit('":'), value)
        return part.groupBy("id_mapping").agg(F.array_sort(F.collect_set(item)).alias(name))

    quoted = F.regexp_extract(entry["v"], r'^\{"v":(.*)\}$', 1)
    sources = object_of(plain, quoted, "sources")
    flags = object_of(
        typed.where("generated"),
        F.when(F.col("source") == "true", "true").otherwise("false"),
        "flags",
    )
    both = sources.join(flags, "id_mapping", "left")
    items = F.concat("sources", F.coalesce("flags", F.array().cast("array<string>")))
    return both.select(
        "id_mapping", F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")).alias("mapping")
    )


def default_value_mapping(vocabulary: DataFrame, used: list[str], by: str) -> DataFrame:
    """Generated value mapping: the ``by`` column (label or code) of each term to its code."""
    return vocabulary.where(F.col("vocab").isin(*used)).select(
        "vocab", F.col(by).alias("value"), "code"
    )
