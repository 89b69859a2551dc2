"""Areas as cells of a quadtree: each cell is split until it lies inside, outside, or holds few edges.

Small areas are cut into few cells, and of a long border only the cells along it grow small. A cell keeps the edges
that meet its box and whether its reference point is inside; another point of the cell is inside if the way from the
reference point crosses an even number of these edges, and outside for an odd one, or the other way about.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.binding import let
from obsload.functions.geometry import bounds, in_rings, on_edges, segments
from obsload.operators.keyed import BROADCAST_BYTES, BROADCAST_KEYS, key_counts, left_lookup
from obsload.workspace import small_enough, written

FEW = 16  # edges of a cell that need no further cut
MANY = 1024  # vertices of a cell whose edges are dealt as rows, never as one array
#: the reference point, as a share of the side; odd numbers keep it off edges drawn on round ones
REFERENCE = (0.41421356, 0.57721566)
_SLACK = 1e-9


def crosses_oddly(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the way from ``(x0, y0)`` up or down to ``y1`` and then across to ``x1`` crosses edges an odd number of times."""

    return F.aggregate(edges, F.lit(0), lambda n, e: n + _crossings(e, x0, y0, x1, y1)) % 2 == 1


def _crossings(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """How often the way from ``(x0, y0)`` up or down to ``y1`` and then across to ``x1`` crosses one edge."""
    upright = (e["x0"] > x0) != (e["x1"] > x0)
    y = e["y0"] + (x0 - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"])
    across = (e["y0"] > y1) != (e["y1"] > y1)
    x = e["x0"] + (y1 - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])
    one = F.when(upright & ((y0 < y) != (y1 < y)), 1).otherwise(0)
    return one + F.when(across & ((x0 < x) != (x1 < x)), 1).otherwise(0)


def _meets_box(e: Column, left: Column, bottom: Column, side: Column) -> Column:
    """A segment comes within a hair of a square: boxes overlap and the corners are not all on one side of it."""
    return _meets_lines(e, _lines(left, bottom, side))


def _lines(left: Column, bottom: Column, side: Column) -> dict[str, Column]:
    """The four sides of a square, a hair outside of it."""
    slack = side * _SLACK
    return {"low_x": left - slack, "high_x": left + side + slack, "low_y": bottom - slack, "high_y": bottom + side + slack}


def _meets_lines(e: Column, lines: dict[str, Column] | Column) -> Column:
    low_x, high_x, low_y, high_y = (lines[n] for n in ("low_x", "high_x", "low_y", "high_y"))
    boxes = (
        (F.greatest(e["x0"], e["x1"]) >= low_x)
        & (F.least(e["x0"], e["x1"]) <= high_x)
        & (F.greatest(e["y0"], e["y1"]) >= low_y)
        & (F.least(e["y0"], e["y1"]) <= high_y)
    )

    def beside(x: Column, y: Column) -> Column:
        return (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])

    sides = [beside(x, y) for x in (low_x, high_x) for y in (low_y, high_y)]
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _meeting(edges: Column, left: Column, bottom: Column, side: Column) -> Column:
    """The edges that meet a square, whose sides are computed once and not for each edge."""
    lines = F.struct(*[c.alias(n) for n, c in _lines(left, bottom, side).items()])
    return let(lines, lambda b: F.filter(edges, lambda e: _meets_lines(e, b)))


def _way_crosses_oddly(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """:func:`crosses_oddly` with the ends of the way computed once and not for each edge."""
    way = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return let(way, lambda w: crosses_oddly(edges, w["x0"], w["y0"], w["x1"], w["y1"]))


def _side(level: Column, unit: float) -> Column:
    return F.lit(unit) * F.pow(F.lit(2.0), level)


def _reference(cx: Column, cy: Column, side: Column) -> tuple[Column, Column]:
    return (cx + REFERENCE[0]) * side, (cy + REFERENCE[1]) * side


def quad_cells(areas: DataFrame, unit: float) -> DataFrame:
    """Cells ``(level, cx, cy, id_area, inside, edges)`` of side ``unit * 2 ** level`` that make up each area.

    A cell without edges lies inside. Cells of one area do not overlap; the smallest ones have level 0 and may keep
    more than ``FEW`` edges.
    """
    shaped = areas.where(F.size("geom.parts") > 0).select("id_area", bounds(F.col("geom")).alias("b"), segments(F.col("geom")).alias("edges"))
    roots = _roots(shaped.withColumn("level", _level_of(F.col("b"), unit)), unit)
    inside = in_rings(*_reference(F.col("cx"), F.col("cy"), F.col("side")), F.col("edges"))
    return _divided(_kept(roots.withColumn("inside", inside), F.col("edges")), unit)


def _level_of(box: Column, unit: float) -> Column:
    """The level at which a box meets two cells at most either way."""
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    return F.when(extent > unit, F.ceil(F.log2(extent / unit))).otherwise(0).cast("int")


def _reach(low: Column, high: Column, side: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / side).cast("long"), F.floor(high / side).cast("long")))


def _roots(boxed: DataFrame, unit: float) -> DataFrame:
    """Rows with ``b`` and ``level`` for each cell of that level in their box."""
    sided = boxed.withColumn("side", _side(F.col("level"), unit))
    rows = sided.select("*", _reach(F.col("b.xmin"), F.col("b.xmax"), F.col("side")).alias("cx"))
    return rows.select("*", _reach(F.col("b.ymin"), F.col("b.ymax"), F.col("side")).alias("cy"))


def _divided(cells: DataFrame, unit: float) -> DataFrame:
    """Written cells, and those with many edges split until they hold few."""
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = []
    while True:
        large = (F.size("edges") > FEW) & (F.col("level") > 0)
        done.append(cells.where(~large))
        if cells.where(large).isEmpty():
            return reduce(DataFrame.unionByName, done)
        quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        # few bytes but much work, so spread by number
        parents = cells.where(large).repartition(tasks, "id_area", "cx", "cy")
        parents = parents.withColumn("side", _side(F.col("level"), unit)).withColumn("quarter", quarters)
        children = parents.select(
            "id_area",
            (F.col("level") - 1).alias("level"),
            (F.col("cx") * 2 + F.col("quarter.i")).alias("cx"),
            (F.col("cy") * 2 + F.col("quarter.j")).alias("cy"),
            (F.col("side") / 2).alias("side"),
            F.struct("cx", "cy", "side", "inside", "edges").alias("of"),
        )
        there = _reference(F.col("of.cx"), F.col("of.cy"), F.col("of.side"))
        here = _reference(F.col("cx"), F.col("cy"), F.col("side"))
        turned = _way_crosses_oddly(F.col("of.edges"), *there, *here)
        cells = _kept(children.withColumn("inside", F.col("of.inside") != turned), F.col("of.edges"))


def _kept(cells: DataFrame, edges: Column) -> DataFrame:
    """Cells with the edges that meet them, written, without those that lie outside."""
    near = _meeting(edges, F.col("cx") * F.col("side"), F.col("cy") * F.col("side"), F.col("side"))
    own = cells.select("level", "cx", "cy", "id_area", "inside", near.alias("edges"))
    # a filter before the writing would look for the edges twice
    return written(own, "quads").where((F.size("edges") > 0) | F.col("inside"))


def edge_cells(edges: DataFrame, unit: float) -> DataFrame:
    """The cells :func:`quad_cells` makes, of areas that come as edges ``(id_area, x0, y0, x1, y1)``, of any number.

    Vertices are counted for each cell of each level. A cell with more than ``MANY`` is split, which its edges would
    have it anyway; edges meet the remaining cells by a join. Whether a cell holds its reference point is told from the
    edges crossing the ways between the reference points of the cells it lies in. An edge with a null end is left out.
    """
    corner = lambda least, c: least(F.least(f"{c}0", f"{c}1") if least is F.min else F.greatest(f"{c}0", f"{c}1"))
    box = F.struct(*[corner(f, c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    boxes = edges.groupBy("id_area").agg(box.alias("b"), F.count(F.lit(1)).alias("n")).withColumn("top", _level_of(F.col("b"), unit))
    boxes = written(boxes.where("b.xmin is not null and b.ymin is not null"), "boxes")
    whole = edges.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    counted = boxes.select("id_area", "b", "top", "n")
    sound = left_lookup(whole, counted, ["id_area"], ["b", "top"], counted, F.xxhash64("x0", "y0"))
    sound = written(sound.select("id_area", "b", "top", F.struct("x0", "y0", "x1", "y1").alias("e")), "edges")
    keys = ["id_area", "level", "cx", "cy"]

    side = _side(F.col("level"), unit)
    at = [F.floor(F.col(f"e.{c}0") / side).cast("long").alias(f"c{c}") for c in "xy"]
    levels = F.explode(F.when(F.col("top") > 0, F.sequence(F.lit(1), F.col("top"))))
    starts = sound.select("id_area", "e", levels.alias("level")).select("id_area", "level", *at)
    split = written(key_counts(starts, keys).where(F.col("n") > MANY).select(*keys).withColumn("split", F.lit(True)), "split-cells")
    roots = _roots(boxes.select("id_area", "b", "top", F.col("top").alias("level")), unit)
    quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    below = split.join(boxes.select("id_area", "top"), "id_area").withColumn("q", quarters)
    children = below.select(
        "id_area", "top", (F.col("level") - 1).alias("level"), (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy")
    )
    nodes = roots.select("id_area", "top", "level", "cx", "cy").unionByName(children).join(split, keys, "left")
    nodes = written(nodes, "nodes")
    leaves = nodes.where("split is null").drop("split")
    inner = nodes.where("split").drop("split")

    # from the roots down to the leaves
    rooted = _roots(sound.select("id_area", "b", "e", F.col("top").alias("level")), unit)
    begun = rooted.where(_right_of(F.col("e"), *_reference(F.col("cx"), F.col("cy"), F.col("side"))))
    turned = _met(sound, inner, unit, _straddles).select(*keys, F.explode(_turned(unit)).alias("q")).select(
        "id_area", (F.col("level") - 1).alias("level"), (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy")
    )
    odd = begun.select(*keys).unionByName(turned).groupBy(*keys).agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    step = F.col("at") - F.col("level")
    chain = leaves.select(F.struct(*keys).alias("leaf"), *keys, F.explode(F.sequence("level", "top")).alias("at")).select(
        "leaf", "id_area", F.col("at").alias("level"), _above("cx", step).alias("cx"), _above("cy", step).alias("cy")
    )
    within = chain.join(odd, keys).groupBy("leaf").agg((F.count(F.lit(1)) % 2 == 1).alias("inside")).select("leaf.*", "inside")
    held = _met(sound, leaves, unit, _meets_box).groupBy(*keys).agg(F.collect_list("e").alias("edges"))
    none = F.array().cast(held.schema["edges"].dataType)
    cells = leaves.join(within, keys, "left").join(held, keys, "left").select(
        "level", "cx", "cy", "id_area", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("edges", none).alias("edges")
    )
    return _divided(written(cells.where((F.size("edges") > 0) | F.col("inside")), "quads"), unit)


def _right_of(e: Column, x: Column, y: Column) -> Column:
    """A ray from a position to the right meets an edge, as :func:`in_rings` tells it."""
    return ((e["y0"] > y) != (e["y1"] > y)) & (x < e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]))


def _above(column: str, step: Column) -> Column:
    """The cell ``step`` levels above one."""
    return F.floor(F.col(column) / F.pow(F.lit(2.0), step)).cast("long")


def _straddles(e: Column, left: Column, bottom: Column, side: Column) -> Column:
    """An edge crosses a line on which ways between the reference points of a cell and of its quarters run."""
    lines = [("x", left + REFERENCE[0] * side), *[("y", bottom + (i + REFERENCE[1]) * side / 2) for i in (0, 1)]]
    slack = side * _SLACK
    return reduce(
        lambda a, b: a | b,
        [(F.least(e[f"{c}0"], e[f"{c}1"]) <= at + slack) & (F.greatest(e[f"{c}0"], e[f"{c}1"]) >= at - slack) for c, at in lines],
    )


def _turned(unit: float) -> Column:
    """Quarters of a cell to whose reference point the edge ``e`` cuts the way from that of the cell."""
    side = _side(F.col("level"), unit)
    there = _reference(F.col("cx"), F.col("cy"), side)
    ways = []
    for i in (0, 1):
        for j in (0, 1):
            here = _reference(F.col("cx") * 2 + i, F.col("cy") * 2 + j, side / 2)
            ways.append(F.when(_crossings(F.col("e"), *there, *here) % 2 == 1, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))))
    return F.array_compact(F.array(*ways))


def _met(edges: DataFrame, cells: DataFrame, unit: float, keep) -> DataFrame:
    """Pairs of an edge ``e`` and a cell ``(id_area, level, cx, cy)`` where ``keep(e, left, bottom, side)`` holds.

    An edge looks for cells of its own size or larger in the cells it may meet, and for smaller ones under those of
    its size. Few cells are broadcast.
    """
    keys = ["id_area", "level", "cx", "cy"]
    cells = written(cells.select(*keys, "top"), "cells")
    used = sorted(r["level"] for r in cells.select("level").distinct().collect())  # a few dozen at most
    e, side = F.col("e"), F.col("side")
    length = F.greatest(F.abs(e["x1"] - e["x0"]), F.abs(e["y1"] - e["y0"]))
    own = F.least(F.when(length > unit, F.ceil(F.log2(length / unit))).otherwise(0).cast("int"), F.col("top"))
    sized = edges.select("id_area", "e", "top", own.alias("own"))

    def asked(levels: Column) -> DataFrame:
        rows = sized.select("id_area", "e", "own", F.explode(levels).alias("level")).withColumn("side", _side(F.col("level"), unit))
        slack = side * _SLACK
        for c in "xy":
            low, high = F.least(e[f"{c}0"], e[f"{c}1"]), F.greatest(e[f"{c}0"], e[f"{c}1"])
            rows = rows.select("*", _reach(low - slack, high + slack, side).alias(f"c{c}"))
        return rows

    def kept(rows: DataFrame) -> DataFrame:
        return rows.where(keep(e, F.col("cx") * side, F.col("cy") * side, side)).select(*keys, "e")

    all_used = F.array(*[F.lit(k) for k in used]).cast("array<int>")
    sought = F.broadcast(cells) if small_enough(cells, BROADCAST_KEYS, BROADCAST_BYTES) else cells
    pairs = kept(asked(F.filter(all_used, lambda k: (k >= F.col("own")) & (k <= F.col("top"))))).join(sought.select(*keys), keys)
    long = sized.where(F.col("own") > (used[0] if used else 0))
    sizes = sorted(r["own"] for r in long.select("own").distinct().collect()) if used else []
    if not sizes:
        return pairs
    step = F.col("at") - F.col("level")
    over = F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: (k > F.col("level")) & (k <= F.col("top")))
    under = cells.select("*", F.explode(over).alias("at")).select(
        "id_area", F.col("at").alias("own"), _above("cx", step).alias("ox"), _above("cy", step).alias("oy"), "level", "cx", "cy"
    )
    longer = asked(F.when(F.col("own") > used[0], F.array("own"))).select("id_area", "e", "own", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    joined = longer.join(under, ["id_area", "own", "ox", "oy"]).withColumn("side", _side(F.col("level"), unit))
    return pairs.unionByName(kept(joined))


def _holding(candidates: Column, x: Column, y: Column, level: Column, unit: float, with_border: bool) -> Column:
    """Ids of the candidates of a point's cell that hold it."""
    side = _side(level, unit)
    start = _reference(F.floor(x / side), F.floor(y / side), side)

    def held(way: Column) -> Column:
        def holds(c: Column) -> Column:
            px, py = way["x1"], way["y1"]
            odd, on = crosses_oddly(c["edges"], way["x0"], way["y0"], px, py), on_edges(px, py, c["edges"])
            within = c["inside"] != odd
            return (F.size(c["edges"]) == 0) | ((within | on) if with_border else (within & ~on))

        return F.transform(F.filter(candidates, holds), lambda c: c["id_area"])

    # the reference point is computed once and not for each edge
    return let(F.struct(start[0].alias("x0"), start[1].alias("y0"), x.alias("x1"), y.alias("y1")), held)


def areas_of_points(
    points: DataFrame, areas: DataFrame, unit: float, x: str, y: str, spread: Column,
    broadcast_keys: int = BROADCAST_KEYS, broadcast_bytes: int = BROADCAST_BYTES, with_border: bool = False,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Points with ``id_areas``, the ordered ids of the areas containing them; borders count ``with_border`` only.

    ``cells`` are those :func:`quad_cells` makes of the areas, where a caller has them already.

    Points meet the cells of each level in use by an equi-join. The cells are written and measured: small ones are
    broadcast, so points are not shuffled; otherwise each distinct position is looked up once, hot cells and hot
    positions by broadcast.
    """
    candidates = F.collect_list(F.struct("id_area", "inside", "edges")).alias("candidates")
    cells = quad_cells(areas, unit) if cells is None else cells
    per_cell = written(cells.groupBy("level", "cx", "cy").agg(candidates), "quad-cells")
    levels = sorted(r["level"] for r in per_cell.select("level").distinct().collect())  # a few dozen at most
    none = F.array().cast(areas.select(F.array("id_area")).schema[0].dataType)
    px, py = F.col(x), F.col(y)
    if not levels:
        return points.withColumn("id_areas", none)

    def cell(level: Column) -> tuple[Column, Column]:
        side = _side(level, unit)
        return F.floor(px / side).cast("long"), F.floor(py / side).cast("long")

    if small_enough(per_cell, broadcast_keys, broadcast_bytes):
        found, rows = [], points
        for k in levels:
            own = per_cell.where(F.col("level") == k).select(
                F.col("cx").alias("_qx"), F.col("cy").alias("_qy"), F.col("candidates").alias(f"_held{k}")
            )
            at = cell(F.lit(k))
            rows = rows.withColumns({"_qx": at[0], "_qy": at[1]}).join(F.broadcast(own), ["_qx", "_qy"], "left").drop("_qx", "_qy")
            found.append(F.coalesce(_holding(F.col(f"_held{k}"), px, py, F.lit(k), unit, with_border), none))
        ids = F.array_sort(F.concat(*found))
        return rows.select(*points.columns, ids.alias("id_areas"))

    positions = written(key_counts(points, [x, y]), "positions")
    leveled = positions.select(x, y, F.explode(F.array(*[F.lit(k) for k in levels])).alias("level"))
    at = cell(F.col("level"))
    asked = leveled.withColumns({"cx": at[0], "cy": at[1]})
    keys = ["level", "cx", "cy"]
    counts = key_counts(asked, keys)
    known = counts.join(per_cell, keys)
    met = left_lookup(asked, known, keys, ["candidates"], counts, F.xxhash64(x, y)).where(F.col("candidates").isNotNull())
    ids = met.select(x, y, F.explode(_holding(F.col("candidates"), px, py, F.col("level"), unit, with_border)).alias("id"))
    held = ids.groupBy(x, y).agg(F.array_sort(F.collect_list("id")).alias("id_areas")).join(positions, [x, y])
    looked = left_lookup(points, held, [x, y], ["id_areas"], positions, spread)
    return looked.select(*points.columns, F.coalesce("id_areas", none).alias("id_areas"))
