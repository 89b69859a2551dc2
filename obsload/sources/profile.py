"""File profiles: header, separator, encoding and size of many files in one job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsload.workspace import written

# Separators and encodings a load may declare, and the size limit in bytes.
SEPARATORS = [",", ";"]
ENCODINGS = ["utf-8", "iso-8859-1", "iso-8859-15"]
MAX_FILE_SIZE = 1000 * 1024 * 1024
EXTENSIONS = ["csv", "geojson"]
NAME_LIMIT = 100


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Files as ``path, length``, empty ones included; no byte of them is read.

    A scan leaves out files of no bytes, so the listing the driver already holds is joined back.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = found.select(_plain_path("path").alias("path"), "length")
    listed = spark.createDataFrame([(f,) for f in found.inputFiles()], "path string")
    names = listed.select(_named("path").alias("path"))
    return names.join(sizes, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))


def read_files(spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """Facts of each file as ``path, length, bad_lines, first_line, has_data``.

    Lines are streamed and aggregated where they are read, so a file may be of any size and split among tasks. Files
    are listed once and read once: the facts are written, and files of no bytes, which no scan shows, come from the
    listing the scan already holds.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding {encoding!r} is not accepted")
    scanned = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = scanned.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"), "value", place.alias("place"))
    bad = ~F.is_valid_utf8("value") if encoding == "utf-8" else F.lit(False)
    filled = F.when(F.trim("value", F.lit(" \r")) != "", F.col("place"))
    facts = lines.groupBy("file").agg(
        F.max("length").alias("length"),
        F.count_if(bad).alias("bad_lines"),
        F.min_by("value", "place").alias("first_line"),
        F.min("place").alias("first"),
        F.max(filled).alias("last_filled"),
    )
    raw = F.regexp_replace("first_line", "\r$", "")
    # every byte has a meaning in the Latin sets
    text = raw if encoding == "utf-8" else F.decode(raw.cast("binary"), "ISO-8859-1")
    read = facts.select(
        _named("file").alias("path"),
        "length",
        "bad_lines",
        F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).alias("first_line"),
        F.coalesce(F.col("last_filled") > F.col("first"), F.lit(False)).alias("has_data"),
    )
    names = spark.createDataFrame([(f,) for f in scanned.inputFiles()], "path string").select(_named("path").alias("path"))
    whole = names.join(read, "path", "left").select(
        "path", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"), "first_line",
        F.coalesce("has_data", F.lit(False)).alias("has_data"),
    )
    return written(whole, "facts")


def _named(column: str) -> Column:
    """Path of a file from its address."""
    return _plain_path(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))))


def _plain_path(column: Column | str) -> Column:
    return F.regexp_replace(column, "^file:/+", "file:/")


def separator_of(line: Column) -> Column:
    """The accepted separator occurring most often outside quotes in a header line."""
    bare = F.regexp_replace(line, '"[^"]*"', "")

    def times(mark: str) -> Column:
        return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(mark), F.lit("")))

    best = F.greatest(*[times(s) for s in SEPARATORS])
    picked = reduce(
        lambda chosen, s: F.when(times(s) == best, F.lit(s)).otherwise(chosen),
        reversed(SEPARATORS),
        F.lit(None).cast("string"),
    )
    return F.when(best > 0, picked)


def header_cells(line: Column, separator: Column) -> Column:
    """Names of a header line, quotes removed."""
    cells = F.split(line, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1)
    return F.transform(cells, lambda c: F.regexp_replace(c, '^"|"$', ""))


def profile_files(files: DataFrame) -> DataFrame:
    """Adds separator and columns, read off the first line, and whether all lines fit the encoding."""
    separated = files.withColumns({"decodes": F.col("bad_lines") == 0, "separator": separator_of(F.col("first_line"))})
    names = F.when(F.col("separator").isNotNull(), header_cells(F.col("first_line"), F.col("separator")))
    return separated.withColumn("columns", F.coalesce(names, F.array("first_line")))


def file_issues(profile: DataFrame, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """One line per file and fault: ``path, code``."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.substring_index(name, ".", -1))
    empty = F.col("length") == 0
    readable = ~empty & F.col("decodes")
    header = F.coalesce(F.col("first_line"), F.lit(""))
    rules = [
        ("EMPTY_FILE", empty),
        ("FILE_OVERSIZE", F.col("length") > max_size),
        ("FILE_EXTENSION_ERROR", ~extension.isin(*EXTENSIONS)),
        ("FILE_NAME_TOO_LONG", F.char_length(name) > NAME_LIMIT),
        ("FILE_NAME_ERROR", F.substring_index(name, ".", 1).rlike("^[0-9]+$")),
        ("ENCODING_ERROR", ~empty & ~F.col("decodes")),
        ("FILE_FORMAT_ERROR", readable & (header == "")),
        (
            "HEADER_COLUMN_EMPTY",
            readable & (header != "") & F.exists("columns", lambda c: F.trim(c) == ""),
        ),
        (
            "HEADER_SAME_COLUMN_NAME",
            readable & (F.size(F.array_distinct("columns")) < F.size("columns")),
        ),
        ("FILE_WITH_NO_DATA", readable & (header != "") & ~F.col("has_data")),
    ]
    raised = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in rules]))
    return profile.select("path", F.explode(raised).alias("code"))


def header_differs(profile: DataFrame, declared: Sequence[str]) -> DataFrame:
    """Files whose header is not the declared column list, as ``path, columns``; empty files have none to compare."""
    return profile.where((F.col("length") > 0) & (F.col("columns") != F.array(*[F.lit(c) for c in declared]))).select(
        "path", "columns"
    )


def load_file_issues(
    spark: SparkSession, path: str | Sequence[str], declared: Sequence[str], encoding: str, max_size: int = MAX_FILE_SIZE
) -> DataFrame:
    """Faults of the files of a load, ``path, code``: those of :func:`file_issues`, and headers other than declared."""
    profile = profile_files(read_files(spark, path, encoding.lower()))
    other = header_differs(profile, declared).select("path", F.lit("FILE_FORMAT_ERROR").alias("code"))
    return file_issues(profile, max_size).unionByName(other).distinct()
