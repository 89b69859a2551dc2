"""Delimited files: every column as text, records numbered as a reader of the file counts them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from obsload.sources.profile import ENCODINGS
from obsload.workspace import written

CORRUPT = "_corrupt"
# numbering offsets are one row per scanned file block; below this many they are broadcast
BROADCAST_BLOCKS = 200_000


def header_of(spark: SparkSession, path: str, separator: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of one file; only its first record reaches the driver."""
    first = (
        spark.read.option("header", False)
        .option("multiLine", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .csv(path)
        .first()
    )
    return [] if first is None else ["" if v is None else v for v in first]


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    separator: str = ";",
    encoding: str = "UTF-8",
    multiline: bool = True,
) -> DataFrame:
    """Raw records with their place: ``columns…, _corrupt, _file, _block, _pos``.

    The header of every file is compared with ``columns``, names and order; reading fails where they
    differ, and so does this function on bytes that do not fit the encoding.

    ``multiline`` keeps line breaks inside quoted cells and makes each file one task; turn it off for
    huge files without such cells, which are then split. :func:`obsload.sources.split.read_records` splits both.
    """
    refuse_undecodable(spark, paths, encoding)
    schema = StructType([StructField(c, StringType()) for c in [*columns, CORRUPT]])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)  # or only the columns in use would be compared
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("maxCharsPerColumn", -1)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(list(paths) if not isinstance(paths, str) else paths)
    )
    return raw.select(
        *[F.col(f"`{c}`") for c in columns],
        CORRUPT,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )


def undecodable(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files with lines that are not valid UTF-8, ``(path, lines)``; lines are scanned, never whole files."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    bad = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("path"))
    return bad.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


def refuse_undecodable(spark: SparkSession, paths: str | Sequence[str], encoding: str) -> None:
    """Aborts a load of another encoding than declared; in the Latin sets every byte has a meaning."""
    if encoding.lower() not in ENCODINGS:
        raise ValueError(f"encoding {encoding!r} is not accepted")
    fault = undecodable(spark, paths).orderBy("path").first() if encoding.lower() == "utf-8" else None
    if fault is not None:
        raise ValueError(f"{fault['lines']} lines of {fault['path']} are not {encoding}")


def numbered(raw: DataFrame, id_load: int | None = None) -> DataFrame:
    """Adds ``line_no``, the 1-based count of records of a load over its files in path order.

    Records of one file block are consecutive within a task, so a record's number is its distance
    from the first of its block plus the records of earlier blocks. The raw records are written
    first: a second scan could be split differently and would move the positions.
    """
    kept = raw if id_load is None else raw.withColumn("id_load", F.lit(id_load))
    kept = written(kept, "raw-records")
    blocks = kept.groupBy("id_load", "_file", "_block").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = (
        Window.partitionBy("id_load")
        .orderBy("_file", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = written(
        blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"),
        "record-offsets",
    )
    n_blocks = offsets.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    lookup = F.broadcast(offsets) if n_blocks <= BROADCAST_BLOCKS else offsets
    joined = kept.join(lookup, ["id_load", "_file", "_block"])
    line_no = F.col("_offset") + F.col("_pos") - F.col("_first") + 1
    return joined.withColumn("line_no", line_no).drop("_first", "_offset", "_pos")


def blank(columns: Sequence[str]) -> Column:
    """All cells of the record are empty."""
    empty = F.lit(True)
    for c in columns:
        empty = empty & (F.coalesce(F.col(f"`{c}`"), F.lit("")) == "")
    return empty


def without_blank_records(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(~blank(columns))


def cell_count(record: Column, separator: str) -> Column:
    """Cells of a raw record, separators inside quotes not counted."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def ragged_code(columns: Sequence[str], separator: str) -> Column:
    """Issue code of a record with more or fewer cells than the header, null for others."""
    cells = cell_count(F.col(CORRUPT), separator)
    return F.when(cells > len(columns), "ROW_HAVE_TOO_MUCH_COLUMN").when(cells < len(columns), "ROW_HAVE_LESS_COLUMN")


def ragged_issues(df: DataFrame, columns: Sequence[str], separator: str) -> DataFrame:
    """Long issues for records with more or fewer cells than the header."""
    return (
        df.withColumn("code", ragged_code(columns, separator))
        .where(F.col("code").isNotNull())
        .select("id_load", "line_no", "code", F.lit("").alias("column"), F.col(CORRUPT).alias("value"))
    )


def refuse_surplus(df: DataFrame, columns: Sequence[str], separator: str) -> None:
    """Aborts a load one of whose records has more cells than the header, naming the line."""
    surplus = (
        ragged_issues(df, columns, separator)
        .where(F.col("code") == "ROW_HAVE_TOO_MUCH_COLUMN")
        .orderBy("line_no")
        .first()
    )
    if surplus is not None:
        raise ValueError(f"line {surplus['line_no']} has surplus cells: {surplus['value']!r}")
