"""Written tables that cut lineage between the steps of a load.

They live in the shared folder the cluster names in ``spark.checkpoint.dir``, so a lost executor
costs a re-read and never a re-parse of the source files. Results read them when they are used; once
these are saved, :func:`release` removes the tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="obsload-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_MADE: list[str] = []


def work_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes the tables this driver has written, whose readers must be done; how many were there."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _MADE:
        folder = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(folder.getFileSystem(conf).delete(folder, True))
    return gone


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as parquet and read back: pruned scans, no recomputation."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int, size: int) -> bool:
    """True when a *written* table has at most ``rows`` rows and ``size`` bytes as text."""
    measured = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("size"),
    ).first()
    return measured["n"] <= rows and measured["size"] <= size
