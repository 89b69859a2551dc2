"""Areas: attachment of rows by code, and the shapes of those they are attached to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.crs import GEOGRAPHIC, reproject
from obsload.functions.geometry import centroid, first_vertex
from obsload.operators.keyed import BROADCAST_BYTES, BROADCAST_KEYS, fetch
from obsload.workspace import small_enough, written

# Area types accepted for each code field.
AREA_TYPES = {
    "codecommune": ["COM"],
    "codedepartement": ["DEP"],
    "codemaille": ["M1", "M5", "M10"],
}

# what a row carries of its area; shapes stay in the referential until rows are appended
ATTACHED = ["id_area_attachment", "area_x", "area_y"]
AREA_SHAPES = ["the_geom_local", "the_geom_4326"]


def attachment_table(areas: DataFrame, local: int) -> DataFrame:
    """One area per code field and code, with its centre: the one of the lowest identifier.

    Reprojected and centred here, once per area instead of once per row attached to it. Areas without a
    shape place nothing.
    """
    kind = F.lit(None).cast("string")
    for name, types in AREA_TYPES.items():
        kind = F.when(F.col("type").isin(*types), F.lit(name)).otherwise(kind)
    single = (
        areas.select(kind.alias("code_field"), F.col("code").alias("area_code"), "id_area", "geom")
        .where(F.col("code_field").isNotNull() & F.col("geom").isNotNull())
        .groupBy("code_field", "area_code")
        .agg(
            F.min("id_area").alias("id_area_attachment"),
            F.min_by("geom", "id_area").alias("area_geom"),
        )
    )
    centre = first_vertex(centroid(reproject(F.col("area_geom"), local, GEOGRAPHIC)))
    placed = single.select("code_field", "area_code", "id_area_attachment", centre.alias("centre"))
    return placed.select("code_field", "area_code", "id_area_attachment", F.col("centre.x").alias("area_x"), F.col("centre.y").alias("area_y"))


def area_code(code_columns: dict[str, str], needs: Column) -> tuple[Column, Column]:
    """Field and value of the first filled code of a row that ``needs`` marks, null for others."""
    field = F.lit(None).cast("string")
    code = F.lit(None).cast("string")
    for name in reversed([n for n in AREA_TYPES if n in code_columns]):
        given = needs & F.col(code_columns[name]).isNotNull()
        field = F.when(given, F.lit(name)).otherwise(field)
        code = F.when(given, F.col(code_columns[name])).otherwise(code)
    return field, code


def with_area_shapes(rows: DataFrame, areas: DataFrame, local: int) -> DataFrame:
    """Shapes of the areas that rows without a position of their own are attached to, by identifier.

    Each area in use is reprojected once; few and small ones are broadcast, so that rows are not shuffled.
    """
    lacking = F.col("the_geom_local").isNull() & F.col("id_area_attachment").isNotNull()
    used = rows.where(lacking).select(F.col("id_area_attachment").alias("_area")).distinct()
    once = areas.groupBy(F.col("id_area").alias("_area")).agg(F.min_by("geom", F.xxhash64("code")).alias("_local"))
    shapes = once.join(used, "_area").withColumn("_geographic", reproject(F.col("_local"), local, GEOGRAPHIC))
    shapes = written(shapes, "area-shapes")
    keyed = rows.withColumn("_area", F.when(lacking, F.col("id_area_attachment")))
    if small_enough(shapes, BROADCAST_KEYS, BROADCAST_BYTES):
        joined = keyed.join(F.broadcast(shapes), "_area", "left")
    else:
        joined = fetch(keyed, shapes, ["_area"], ["_local", "_geographic"], F.col("line_no"), unique=True)
    own = {n: F.coalesce(n, made) for n, made in zip(AREA_SHAPES, ("_local", "_geographic"), strict=True)}
    return joined.withColumns(own).select(*rows.columns)


def attach_by_code(
    df: DataFrame,
    areas: DataFrame,
    code_columns: dict[str, str],
    local: int,
    needs: Column,
    spread: Column,
    settle: bool = False,
) -> DataFrame:
    """The ``ATTACHED`` columns for the rows that ``needs`` marks, from their first filled code."""
    field, code = area_code(code_columns, needs)
    keyed = df.withColumns({"code_field": field, "area_code": code})
    found = fetch(
        keyed, attachment_table(areas, local), ["code_field", "area_code"], ATTACHED, spread, settle, unique=True
    )
    return found.drop("code_field", "area_code")
