"""Altitudes read from an elevation grid under a geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.geometry import first_vertex, is_areal, members, segments
from obsload.operators.keyed import key_counts, left_lookup

AREA_KEY = "area "


#: a block of the coarsest level spans two to this power cells of a row
TOP = 8


def pyramid(grid: DataFrame, top: int = TOP) -> DataFrame:
    """Lowest and highest altitude ``(cy, level, block, low, high)`` of runs of ``2 ** level`` cells of a row.

    The grid is dealt out once, by row and coarsest block; all levels are then aggregated where they lie.
    """
    dealt = grid.select("cy", F.shiftright("cx", top).alias("part"), "cx", "alt").repartition("cy", "part")
    levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    leveled = dealt.select("cy", "part", "cx", "alt", levels)
    # shifting by the level of a row: a division, since shifts take constants only
    block = F.floor(F.col("cx") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    found = leveled.groupBy("cy", "part", "level", block.alias("block")).agg(F.min("alt").alias("low"), F.max("alt").alias("high"))
    return found.drop("part")


def band_runs(shapes: DataFrame, size: float) -> DataFrame:
    """Runs of cells ``(geo_key, cy, first, last)`` that each shape meets, row by row of the grid.

    A segment meets, in a row, the cells under its part inside the row; a polygon also meets those whose centre
    lies between an odd crossing of the row's middle and the next one. Runs may overlap.
    """
    edges = shapes.select("geo_key", is_areal(F.col("geom")).alias("areal"), F.explode(segments(F.col("geom"))).alias("e"))
    edges = edges.select("geo_key", "areal", "e.*")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")

    def between(first: Column, last: Column) -> Column:
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    rows = between(F.ceil(low / size).cast("long") - 1, F.floor(high / size).cast("long")).alias("cy")
    banded = edges.select("geo_key", "x0", "y0", "x1", "y1", rows)

    def x_at(y: Column) -> Column:
        inside = F.least(F.greatest(y, F.least("y0", "y1")), F.greatest("y0", "y1"))
        within = F.col("x0") + (inside - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
        return F.when(inside == F.col("y0"), F.col("x0")).when(inside == F.col("y1"), F.col("x1")).otherwise(within)

    bottom = F.col("cy") * size
    ends = [x_at(bottom), x_at(bottom + size)]
    level = F.col("y0") == F.col("y1")
    left = F.when(level, F.least("x0", "x1")).otherwise(F.least(*ends))
    right = F.when(level, F.greatest("x0", "x1")).otherwise(F.greatest(*ends))
    touched = banded.select(
        "geo_key", "cy", (F.ceil(left / size) - 1).cast("long").alias("first"), F.floor(right / size).cast("long").alias("last")
    )

    # rows whose middle lies between the ends of an edge, the lower one included
    first_row = F.ceil(low / size - 0.5).cast("long")
    middles = between(first_row, (F.ceil(high / size - 0.5) - 1).cast("long")).alias("cy")
    crossed = edges.where("areal").select("geo_key", "x0", "y0", "x1", "y1", middles)
    at = F.col("x0") + ((F.col("cy") + 0.5) * size - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    lines = crossed.groupBy("geo_key", "cy").agg(F.array_sort(F.collect_list(at)).alias("at"))
    pairs = lines.select("geo_key", "cy", "at", F.explode(F.sequence(F.lit(1), F.size("at"), F.lit(2))).alias("i"))
    start, stop = F.element_at("at", F.col("i")), F.element_at("at", F.col("i") + 1)
    filled = pairs.select(
        "geo_key",
        "cy",
        F.ceil(start / size - 0.5).cast("long").alias("first"),
        (F.ceil(stop / size - 0.5) - 1).cast("long").alias("last"),
    )
    return touched.unionByName(filled.where("first <= last"))


def run_blocks(runs: DataFrame, top: int = TOP) -> DataFrame:
    """Fewest blocks ``(geo_key, cy, level, block)`` of :func:`pyramid` that make up the runs."""
    span = F.col("last") - F.col("first") + 1
    highest = F.least(F.lit(top), F.floor(F.log2(span)).cast("int"))
    leveled = runs.select("geo_key", "cy", "first", "last", F.explode(F.sequence(F.lit(0), highest)).alias("level"), highest.alias("highest"))

    def whole(level: Column) -> tuple[Column, Column]:
        """First and last block of a level that lie wholly in the run."""
        size = F.pow(F.lit(2.0), level)
        return F.ceil(F.col("first") / size).cast("long"), (F.floor((F.col("last") + 1) / size) - 1).cast("long")

    (a, b), (up_a, up_b) = whole(F.col("level")), whole(F.col("level") + 1)
    covered = (F.col("level") < F.col("highest")) & (up_a <= up_b)
    none = F.array().cast("array<bigint>")
    sides = F.concat(
        F.when(a < 2 * up_a, F.array(a)).otherwise(none), F.when(b > 2 * up_b + 1, F.array(b)).otherwise(none)
    )
    blocks = F.when(covered, sides).when(a <= b, F.sequence(a, b)).otherwise(none)
    return leveled.select("geo_key", "cy", "level", F.explode(blocks).alias("block")).distinct()


def shape_altitudes(shapes: DataFrame, grid: DataFrame, cell: float) -> DataFrame:
    """Lowest and highest altitude per ``geo_key`` over the grid cells a shape meets.

    Shapes become runs of cells, and these become blocks of a pyramid over the grid, so the inside of a large
    shape costs a few rows for each row of the grid and never one for each cell.
    """
    single = shapes.select("geo_key", F.explode(members(F.col("geom"))).alias("geom"))
    wanted = run_blocks(band_runs(single, cell))
    met = wanted.join(pyramid(grid), ["cy", "level", "block"])
    return met.groupBy("geo_key").agg(F.min("low").alias("alt_low"), F.max("high").alias("alt_high"))


def with_altitudes(
    df: DataFrame, geom: str, grid: DataFrame, cell: float, wanted: Column, spread: Column,
    settle: bool = False, areas: DataFrame | None = None, area: Column | None = None,
) -> DataFrame:
    """Adds ``alt_low`` and ``alt_high`` under the geometry of the rows ``wanted`` marks.

    Each distinct position or shape is answered once, so rows sharing one cost nothing more. A row without a
    geometry is answered by the area ``area`` names, one of ``areas(geo_key, geom)``.
    """
    g = F.col(geom)
    head = first_vertex(g)
    is_point = g["kind"] == "POINT"
    cx = F.floor(head["x"] / cell).cast("long")
    cy = F.floor(head["y"] / cell).cast("long")
    key = F.when(wanted & is_point, F.concat_ws(":", cx, cy)).when(
        wanted & g.isNotNull(), F.sha2(F.to_json(g), 256)
    )
    if area is not None:
        key = F.coalesce(key, F.when(wanted & g.isNull(), area))
    # a cell given twice answers once
    grid = grid.groupBy("cx", "cy").agg(F.min("alt").alias("alt"))
    keyed = df.withColumn("geo_key", key)
    counts = key_counts(keyed, ["geo_key"])
    pieces = F.split("geo_key", ":")
    located = counts.where(F.col("geo_key").rlike("^-?[0-9]+:-?[0-9]+$")).select(
        "geo_key", "n", pieces[0].cast("long").alias("cx"), pieces[1].cast("long").alias("cy")
    )
    points = located.join(grid, ["cx", "cy"]).select(
        "geo_key", "n", F.col("alt").alias("alt_low"), F.col("alt").alias("alt_high")
    )
    shapes = (
        keyed.where(F.col("geo_key").isNotNull() & ~is_point)
        .select("geo_key", g.alias("geom"))
        .dropDuplicates(["geo_key"])
    )
    if areas is not None:
        named = counts.where(F.startswith("geo_key", F.lit(AREA_KEY))).select("geo_key")
        shapes = shapes.unionByName(areas.join(named, "geo_key", "left_semi").select("geo_key", "geom"))
    covered = counts.join(shape_altitudes(shapes, grid, cell), "geo_key").select(points.columns)
    found = points.unionByName(covered)
    looked = left_lookup(keyed, found, ["geo_key"], ["alt_low", "alt_high"], counts, spread, settle)
    return looked.drop("geo_key")


def filled_altitudes(df: DataFrame, sources: dict[str, str | None]) -> DataFrame:
    """Each altitude from the grid only where its own source cell is empty."""
    filled = {}
    for name, grid_value in (("altitude_min", "alt_low"), ("altitude_max", "alt_high")):
        source = sources.get(name)
        own = F.col(name) if name in df.columns else F.lit(None).cast("int")
        empty = F.lit(True) if source is None else F.coalesce(F.col(source), F.lit("")) == ""
        known = F.col("has_position")
        filled[name] = F.when(known & empty, F.col(grid_value).cast("int")).otherwise(own)
    return df.withColumns(filled)
