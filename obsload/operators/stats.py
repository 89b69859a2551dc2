"""Counts, extents and previews of checked rows and of the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.geometry import bounds, box_wkt

PREVIEW_ROWS = 100
# Taxonomic ranks a distribution may be asked for.
RANKS = [
    "regne", "phylum", "classe", "ordre", "famille", "sous_famille", "tribu", "group1_inpn",
    "group2_inpn",
]


def validity_counts(rows: DataFrame, by: Sequence[str] = ("id_load",)) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count_if("valid").alias("n_valid_data"), F.count_if(~F.col("valid")).alias("n_invalid_data")
    )


def extent(rows: DataFrame, geom: str, by: Sequence[str]) -> DataFrame:
    """Bounding box of the geometries of each group, with its polygon text."""
    boxed = rows.where(F.col(geom).isNotNull()).select(*by, bounds(F.col(geom)).alias("b"))
    grown = boxed.groupBy(*by).agg(
        F.min("b.xmin").alias("xmin"),
        F.min("b.ymin").alias("ymin"),
        F.max("b.xmax").alias("xmax"),
        F.max("b.ymax").alias("ymax"),
    )
    return grown.withColumn("bbox", box_wkt(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


def import_counts(target: DataFrame) -> DataFrame:
    """Rows and distinct taxa per source.

    Pairs are reduced before the shuffle, so a source owning most rows sends one row per taxon and
    task.
    """
    pairs = target.groupBy("id_source", "cd_nom").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("id_source").agg(
        F.sum("n").alias("import_count"), F.count("cd_nom").alias("taxa_count")
    )


def taxa_distribution(target: DataFrame, taxa: DataFrame, rank: str, id_source: int | None = None) -> DataFrame:
    """Observations per group of a taxonomic rank.

    Rows are counted per taxon before the referential is joined: the join sees one row per taxon.
    """
    if rank not in RANKS:
        raise ValueError(f"unknown rank {rank!r}")
    rows = target if id_source is None else target.where(F.col("id_source") == id_source)
    per_taxon = rows.groupBy("cd_nom").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_taxon.join(taxa.select("cd_nom", F.col(rank).alias("group")), "cd_nom")
        .groupBy("group")
        .agg(F.sum("n").alias("count"))
    )


def preview(rows: DataFrame, columns: Sequence[str], size: int = PREVIEW_ROWS) -> DataFrame:
    """First valid rows in line order; a top-k, so each task keeps ``size`` rows."""
    return rows.where("valid").select("line_no", *columns).orderBy("line_no").limit(size)


def staged_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id_load").agg(F.count(F.lit(1)).alias("source_count"))


def with_load_counters(loads: DataFrame, target: DataFrame, at: Column) -> DataFrame:
    """Load rows completed with the counts of their source and the end date ``at``."""
    counts = import_counts(target)
    kept = loads.drop("import_count", "taxa_count", "date_end_import")
    return kept.join(counts, "id_source", "left").withColumn(
        "date_end_import", F.when(F.col("import_count").isNotNull(), at)
    )
