"""Tables a load writes: staging, issues, target; their reset and the export of invalid records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsload.functions.geometry import GEOMETRY
from obsload.model.dictionary import ALWAYS_APPENDED, DICTIONARY, Dictionary
from obsload.model.loads import Load, Settings


_MADE_TYPES = {"datetime_min": "timestamp_ntz", "datetime_max": "timestamp_ntz", "id_area_attachment": "int"}


class Step(IntEnum):
    """Steps of a load; resetting one clears what later steps made."""

    UPLOAD = 1
    DECODE = 2
    LOAD = 3
    PREPARE = 4
    IMPORT = 5


@dataclass(frozen=True)
class Tables:
    """Locations of the partitioned tables."""

    staging: str
    issues: str
    target: str


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Writes ``df``, replacing only the partitions it holds: a repeated load changes nothing."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def drop_partition(spark: SparkSession, path: str, by: str, value: int) -> None:
    """Removes one partition of a table through the file system Spark itself uses."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(folder):
        files.delete(folder, True)


def target_columns(load: Load, settings: Settings, dictionary: Dictionary = DICTIONARY) -> list[str]:
    """Target columns a load appends: the mapped fields and those always or optionally made."""
    names = set(load.field_mapping)
    names |= set(ALWAYS_APPENDED)
    if load.wants("unique_id_sinp_generate", settings.generate_missing_uuid):
        names.add("unique_id_sinp")
    if load.wants("altitudes_generate", False):
        names |= {"altitude_min", "altitude_max"}
    targets = [f.name for f in dictionary if f.target and f.name in names]
    return targets + [n for n in ALWAYS_APPENDED if n not in targets]


def appended_rows(
    rows: DataFrame, load: Load, settings: Settings, dictionary: Dictionary = DICTIONARY
) -> DataFrame:
    """Valid rows as target rows, with their provenance.

    Whatever the load maps, all target columns of the dictionary are there, in its order and with its
    types, null where the load has nothing for them: partitions of any two loads read back alike.
    """
    appended = set(target_columns(load, settings, dictionary))
    kinds = target_types(dictionary)
    columns = [
        (F.col(n) if n in appended and n in rows.columns else F.lit(None)).cast(kind).alias(n)
        for n, kind in kinds.items()
    ]
    return rows.where("valid").select(
        *columns,
        F.lit(load.id_source).cast("int").alias("id_source"),
        F.lit(load.id_module).cast("int").alias("id_module"),
        F.lit(load.id_dataset).cast("int").alias("id_dataset"),
        F.lit("I").alias("last_action"),
    )


def target_types(dictionary: Dictionary = DICTIONARY) -> dict[str, str]:
    """Type of every column of the target table that comes from the dictionary."""
    kinds = {"integer": "int", "timestamp": "timestamp_ntz", "geometry": GEOMETRY}
    made = {f.name: kinds.get(f.kind, "string") for f in dictionary if f.target}
    return made | {n: _MADE_TYPES[n] for n in ALWAYS_APPENDED if n in _MADE_TYPES}


def retract(target: DataFrame, id_source: int) -> DataFrame:
    """The target without the rows of one source; rows of no source stay."""
    return target.where(~F.col("id_source").eqNullSafe(F.lit(id_source)))


def reload(target: DataFrame, fresh: DataFrame) -> DataFrame:
    """The target with the sources of ``fresh`` replaced by it."""
    sources = fresh.select("id_source").distinct()
    kept = target.join(sources, "id_source", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def invalid_records(source: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Source records of the invalid lines, original columns in original order."""
    bad = rows.where(~F.col("valid")).select("id_load", "line_no")
    picked = source.join(bad, ["id_load", "line_no"], "left_semi")
    return picked.orderBy("id_load", "line_no").select(*[F.col(f"`{c}`") for c in columns])


def write_delimited(df: DataFrame, path: str, separator: str, encoding: str = "UTF-8") -> None:
    """Delimited text in the reader's dialect; cells with breaks or separators are quoted again."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("encoding", encoding)
        .csv(path)
    )


def reset_loads(loads: DataFrame, step: Column | int) -> DataFrame:
    """Load rows after a reset to ``step``: counters and flags of that and later steps cleared."""
    at = F.lit(int(step)) if isinstance(step, int) else step

    def cleared(name: str, kind: Step, empty: Column) -> Column:
        return F.when(at <= int(kind), empty).otherwise(F.col(name)).alias(name)

    types = dict(loads.dtypes)
    steps = {
        "columns": (Step.DECODE, None),
        "source_count": (Step.LOAD, None),
        "loaded": (Step.LOAD, False),
        "erroneous_rows": (Step.PREPARE, None),
        "processed": (Step.PREPARE, False),
        "taxa_count": (Step.IMPORT, None),
        "import_count": (Step.IMPORT, None),
        "date_end_import": (Step.IMPORT, None),
        "id_source": (Step.IMPORT, None),
    }
    out = []
    for name in loads.columns:
        if name in steps:
            kind, empty = steps[name]
            out.append(cleared(name, kind, F.lit(empty).cast(types[name])))
        else:
            out.append(F.col(name))
    return loads.select(*out)


def reset_tables(spark: SparkSession, tables: Tables, load: Load, step: int) -> None:
    """Clears the partitions of a load made by ``step`` and later ones."""
    if step <= Step.LOAD:
        drop_partition(spark, tables.staging, "id_load", load.id_load)
    if step <= Step.PREPARE:
        drop_partition(spark, tables.issues, "id_load", load.id_load)
    if step <= Step.IMPORT and load.id_source is not None:
        drop_partition(spark, tables.target, "id_source", load.id_source)
