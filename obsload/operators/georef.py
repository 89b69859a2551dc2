"""Completion of the geometry columns of a load and the set checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.crs import GEOGRAPHIC, reproject
from obsload.model.dictionary import Field
from obsload.model.error_types import GEOMETRY_COLUMNS
from obsload.operators.areas import AREA_TYPES, attach_by_code
from obsload.operators.issues import Check


def both_systems(df: DataFrame, srid: int, local: int) -> DataFrame:
    """``the_geom_4326`` and ``the_geom_local`` from ``geom``, which is in the file's system."""
    geom = F.col("geom")
    return df.withColumns(
        {
            "the_geom_4326": reproject(geom, srid, GEOGRAPHIC),
            "the_geom_local": reproject(geom, srid, local),
        }
    )


def attach_areas(
    df: DataFrame, areas: DataFrame | None, fields: dict[str, Field], local: int, spread: Column,
    settle: bool = False,
) -> DataFrame:
    """Area of the valid rows that only give an area code, and its centre as ``area_x`` and ``area_y``.

    Shapes do not travel with rows: :func:`obsload.operators.areas.with_area_shapes` fills them in at the end.
    """
    codes = code_columns(fields)
    if areas is None or not codes:
        kinds = {"id_area_attachment": "int", "area_x": "double", "area_y": "double"}
        return df.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})
    return attach_by_code(df, areas, codes, local, needs_area(), spread, settle)


def code_columns(fields: dict[str, Field]) -> dict[str, str]:
    return {name: fields[name].source_column for name in AREA_TYPES if name in fields}


def needs_area() -> Column:
    """A valid row without a position of its own."""
    return F.col("row_ok") & F.col("geom").isNull()


def attachment_checks(fields: dict[str, Field], label) -> list[Check]:
    """A code given by a valid row that led to no geometry, and valid rows left without any."""
    unplaced = F.col("row_ok") & F.col("the_geom_4326").isNull() & F.col("id_area_attachment").isNull()
    checks, explained = [], F.lit(False)
    for name in AREA_TYPES:
        if name in fields:
            source = F.col(fields[name].source_column)
            failed = unplaced & ~explained & source.isNotNull()
            checks.append(Check("INVALID_ATTACHMENT_CODE", label(name), failed, source))
            explained = explained | source.isNotNull()
    checks.append(Check("NO-GEOM", GEOMETRY_COLUMNS, unplaced & ~explained))
    return checks

