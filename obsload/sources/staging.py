"""Reading staged loads back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = 100_000


def read_staging(
    spark: SparkSession, path: str, id_load: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of one load; the partition and the columns are pruned at the scan."""
    rows = spark.read.parquet(path).where(F.col("id_load") == id_load)
    return rows.select("id_load", "line_no", *columns) if columns else rows


def batch_slice(rows: DataFrame, offset: int, limit: int, span: int = SPAN) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` of each load in line order.

    Lines fall into runs of ``span`` numbers; run sizes locate the runs the slice touches and only
    those are ranked, each run on its own, so no task ever sorts a whole load.
    """
    run = F.floor((F.col("line_no") - 1) / span)
    runs = rows.groupBy("id_load", run.alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy("id_load").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    touched = placed.where(
        (F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)
    ).drop("_n")
    inside = Window.partitionBy("id_load", "_run").orderBy("line_no")
    ranked = (
        rows.withColumn("_run", run)
        .join(touched, ["id_load", "_run"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
    )
    return ranked.where(F.col("_rank").between(offset + 1, offset + limit)).select(*rows.columns)
