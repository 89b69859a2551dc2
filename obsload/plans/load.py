"""From files to staged rows, and from checked rows to the target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsload.model.dictionary import DICTIONARY, Dictionary
from obsload.model.loads import Load, Settings
from obsload.operators.areas import AREA_SHAPES, with_area_shapes
from obsload.operators.mapping import staged_columns
from obsload.sinks.tables import appended_rows, replace_partition
from obsload.sources.delimited import (
    CORRUPT,
    numbered,
    ragged_code,
    ragged_issues,
    read_delimited,
    refuse_surplus,
    without_blank_records,
)
from obsload.sources.profile import MAX_FILE_SIZE, list_files, load_file_issues
from obsload.sources.split import read_records


@dataclass(frozen=True)
class Staged:
    """Numbered source records, the rows staged from them, issues of ragged records and of whole files."""

    records: DataFrame
    rows: DataFrame
    ragged: DataFrame
    files: DataFrame


def stage(records: DataFrame, load: Load, dictionary: Dictionary = DICTIONARY) -> DataFrame:
    """Numbered records projected onto the dictionary; ``_ragged`` is the code of a ragged record."""
    kept = without_blank_records(records, load.columns)
    columns = [expr.alias(name) for name, expr in staged_columns(load, dictionary).items()]
    ragged = ragged_code(load.columns, load.separator) if CORRUPT in records.columns else F.lit(None).cast("string")
    return kept.select("id_load", "line_no", *columns, ragged.alias("_ragged"))


def load_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    load: Load,
    strict: bool = True,
    multiline: bool = True,
    dictionary: Dictionary = DICTIONARY,
    staging_path: str | None = None,
    max_size: int | None = None,
) -> Staged:
    """Reads, numbers and stages the files of one load.

    Large files are read by many tasks each; ``multiline=False`` spares the pass that looks for line breaks in
    cells where there are none. A file larger than ``max_size`` bytes aborts the load before any is read, one of
    another header or encoding while they are read; ``files`` of the result tells all such faults of all files. ``strict`` also aborts on a record with surplus
    cells; otherwise ragged records are staged with their code, which makes them invalid when the load
    is checked. With ``staging_path`` the rows are written there as the load's partition.
    """
    if max_size is not None:
        large = list_files(spark, paths).where(F.col("length") > max_size).orderBy("path").first()
        if large is not None:
            raise ValueError(f"{large['path']} has {large['length']} bytes, {max_size} are accepted")
    if multiline:
        records = read_records(spark, paths, load.columns, load.separator, load.encoding, load.id_load)
    else:
        raw = read_delimited(spark, paths, load.columns, load.separator, load.encoding, multiline=False)
        records = numbered(raw, load.id_load)
    if strict:
        refuse_surplus(records, load.columns, load.separator)
    ragged = ragged_issues(records, load.columns, load.separator)
    rows = stage(records, load, dictionary)
    if staging_path is not None:
        replace_partition(rows, staging_path, "id_load")
        back = spark.read.schema(rows.schema).parquet(staging_path)
        rows = back.where(F.col("id_load") == load.id_load).select(*rows.columns)
    files = load_file_issues(spark, paths, load.columns, load.encoding, max_size or MAX_FILE_SIZE)
    return Staged(records, rows, ragged, files)


def commit(
    rows: DataFrame,
    load: Load,
    settings: Settings,
    target_path: str,
    dictionary: Dictionary = DICTIONARY,
    areas: DataFrame | None = None,
) -> DataFrame:
    """Appends the valid rows of a checked load as the partition of its source.

    Rows attached to an area get its shape here, from ``areas``; without these such rows are refused. So is a load
    without a valid row.
    """
    if rows.where("valid").isEmpty():
        raise ValueError(f"load {load.id_load} has no valid row")
    if areas is not None:
        rows = with_area_shapes(rows, areas, settings.local_srid)
    elif {*AREA_SHAPES, "id_area_attachment"} <= set(rows.columns):
        shapeless = F.col("the_geom_local").isNull() & F.col("id_area_attachment").isNotNull()
        if not rows.where("valid").where(shapeless).isEmpty():
            raise ValueError(f"load {load.id_load} has rows attached to areas, whose shapes are not given")
    fresh = appended_rows(rows, load, settings, dictionary)
    replace_partition(fresh, target_path, "id_source")
    return fresh
