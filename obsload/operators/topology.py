"""Validity of lines and polygons, and whether they share a position with an area, as joins of edges on cells.

The edges of a shape are dealt into cells, split in four until a cell holds few, and only edges of one cell are compared;
a shape of few edges is one cell. How rings lie in each other is told by casting a ray from one position of each ring
along a band of the shape. A shape meets an area if an edge of the one touches an edge of the other, or a ring of the
one begins inside the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from obsload.functions.binding import let
from obsload.functions.geometry import _segments, bounds, first_vertex, in_rings, is_areal, members, rings, segments, vertices
from obsload.operators.keyed import BROADCAST_BYTES, BROADCAST_KEYS
from obsload.operators.quads import FEW, _meets_box, areas_of_points, quad_cells
from obsload.workspace import small_enough, written

DEEPEST = 24  # splits of the box of a shape; beyond, edges meet in one position
OUTLINE_LEVELS = 12


def _side(e: Column, x: Column, y: Column) -> Column:
    return F.signum((e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"]))


def _sides(a: Column, b: Column) -> list[Column]:
    """On which side of the other edge the ends of each lie."""
    return [_side(b, a["x0"], a["y0"]), _side(b, a["x1"], a["y1"]), _side(a, b["x0"], b["y0"]), _side(a, b["x1"], b["y1"])]


def touching(a: Column, b: Column) -> Column:
    """Two edges share at least one position."""
    boxes = F.lit(True)
    for low, high in (("x0", "x1"), ("y0", "y1")):
        boxes = boxes & (F.greatest(a[low], a[high]) >= F.least(b[low], b[high]))
        boxes = boxes & (F.greatest(b[low], b[high]) >= F.least(a[low], a[high]))
    da, db, dc, dd = _sides(a, b)
    return boxes & (da * db <= 0) & (dc * dd <= 0)


def _along(a: Column, b: Column) -> Column:
    return (a["x1"] - a["x0"]) * (b["x1"] - b["x0"]) + (a["y1"] - a["y0"]) * (b["y1"] - b["y0"])


def _folds_back(a: Column, b: Column) -> Column:
    """The edge after ``a`` runs back along it."""
    turn = (a["x1"] - a["x0"]) * (b["y1"] - b["y0"]) - (a["y1"] - a["y0"]) * (b["x1"] - b["x0"])
    return (turn == 0) & (_along(a, b) < 0)


def _cross_or_overlap(a: Column, b: Column) -> Column:
    """Touching edges of two rings that share more than a position in which rings may meet."""
    da, db, dc, dd = _sides(a, b)
    crossing = (da * db < 0) & (dc * dd < 0)
    flat = (da == 0) & (db == 0) & (dc == 0) & (dd == 0)

    def end(e: Column, i: int) -> Column:
        return F.struct(e[f"x{i}"].alias("x"), e[f"y{i}"].alias("y"))

    # edges on one line may only share an end from which they run apart
    met = [((i, j), end(a, i) == end(b, j)) for i in (0, 1) for j in (0, 1)]
    number = reduce(lambda n, m: n + m, [same.cast("int") for _, same in met])
    apart = F.lit(False)
    for (i, j), same in met:
        apart = apart | (same & ((_along(a, b) < 0) if i == j else (_along(a, b) > 0)))
    return F.when(flat, ~((number == 1) & apart)).otherwise(crossing)


def _faulty(a: Column, b: Column) -> Column:
    """Two edges of a polygon, ``a`` the earlier one, that may not lie as they do."""
    next_, round_ = b["seq"] == a["seq"] + 1, (a["seq"] == 0) & (b["seq"] == b["n"] - 1)
    own = F.when(next_, _folds_back(a, b)).when(round_, _folds_back(b, a)).otherwise(touching(a, b))
    return F.when(a["ring"] == b["ring"], own).otherwise(touching(a, b) & _cross_or_overlap(a, b))


def _numbered_rings(geometry: Column) -> Column:
    """Rings as ``struct<part, hole, v>``."""
    return F.flatten(
        F.transform(
            geometry["parts"],
            lambda part, p: F.transform(part, lambda ring, r: F.struct(p.alias("part"), (r > 0).alias("hole"), ring.alias("v"))),
        )
    )


def _numbered_edges(rings_: Column) -> Column:
    """Edges of some length as ``struct<x0, y0, x1, y1, ring, seq, n>``, numbered within their ring."""

    def of_ring(ring: Column, i: Column) -> Column:
        real = F.filter(_segments(ring["v"]), lambda e: (e["x0"] != e["x1"]) | (e["y0"] != e["y1"]))
        return let(real, lambda es: F.transform(es, lambda e, k: F.struct(
            *[e[c].alias(c) for c in ("x0", "y0", "x1", "y1")], i.alias("ring"), k.alias("seq"), F.size(es).alias("n")
        )))

    return F.flatten(F.transform(rings_, of_ring))


def _bad_ring(ring: Column) -> Column:
    """A ring that is open, too short, without area, or has a coordinate that is not finite."""
    v = ring["v"]
    first = F.get(v, F.lit(0))
    odd = F.exists(v, lambda p: F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    area = F.aggregate(
        _segments(v), F.lit(0.0),
        lambda s, e: s + (e["x0"] - first["x"]) * (e["y1"] - first["y"]) - (e["x1"] - first["x"]) * (e["y0"] - first["y"]),
    )
    return odd | (F.size(v) < 4) | (first != F.get(v, F.size(v) - 1)) | (area == 0)


def _faulty_pairs(cells: DataFrame) -> DataFrame:
    """Keys of the cells two edges of which are faulty; pairs are rows, so that generated code compares them."""
    first = cells.select("key", "edges", F.posexplode("edges").alias("at", "a"))
    # edges come in the order of their rings
    pairs = first.select("key", "a", F.explode(F.slice("edges", F.col("at") + 2, F.size("edges"))).alias("b"))
    return pairs.where(_faulty(F.col("a"), F.col("b"))).select("key")


def _crossed(polygons: DataFrame, tasks: int) -> DataFrame:
    """Keys of the polygons of which two edges may not lie as they do; ``polygons(key, edges, b)``."""
    side = F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin"))
    cells = polygons.select("key", F.lit(0).alias("depth"), F.col("b.xmin").alias("left"), F.col("b.ymin").alias("bottom"), side.alias("side"), "edges")
    cells = written(cells, "edge-cells")
    settled = []
    while True:
        large = (F.size("edges") > FEW) & (F.col("depth") < DEEPEST)
        before = lambda a, b: (a["ring"] < b["ring"]) | (a["ring"] == b["ring"]) & (a["seq"] < b["seq"])
        fault = F.exists("edges", lambda a: F.exists("edges", lambda b: before(a, b) & _faulty(a, b)))
        few = F.size("edges") <= FEW
        settled.append(cells.where(few))
        if cells.where(large).isEmpty():
            deepest = cells.where(~few).where(fault).select("key")
            return _faulty_pairs(reduce(DataFrame.unionByName, settled)).unionByName(deepest)
        half = F.col("side") / 2
        quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        parents = cells.where(large).repartition(tasks, "key", "left", "bottom").withColumn("q", quarters)
        children = parents.select(
            "key", (F.col("depth") + 1).alias("depth"), (F.col("left") + F.col("q.i") * half).alias("left"),
            (F.col("bottom") + F.col("q.j") * half).alias("bottom"), half.alias("side"), "edges",
        )
        near = F.filter("edges", lambda e: _meets_box(e, F.col("left"), F.col("bottom"), F.col("side")))
        cells = written(children.withColumn("edges", near).where(F.size("edges") > 1), "edge-cells")


def _misplaced(polygons: DataFrame) -> DataFrame:
    """Keys of the polygons with a ring where none may lie; ``polygons(key, rings, edges, b)``, each of several rings.

    A hole lies in its own shell and in no other hole of it; a shell lies in no other shell but in a hole of it.
    """
    ringed = polygons.select("key", F.posexplode("rings").alias("ring", "r")).select("key", "ring", "r.part", "r.hole", "r.v")
    corners = ringed.select("key", "ring", F.posexplode("v").alias("at", "p")).select("key", "ring", "at", "p.x", "p.y")
    # a position that other rings share says nothing
    owners = corners.groupBy("key", "x", "y").agg(F.min("ring").alias("ring"), F.max("ring").alias("last"), F.min("at").alias("at"))
    free = owners.where("ring = last").groupBy("key", "ring").agg(F.min_by(F.struct("x", "y"), "at").alias("free"))
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    middle = F.struct(((first["x"] + second["x"]) / 2).alias("x"), ((first["y"] + second["y"]) / 2).alias("y"))
    info = ringed.join(free, ["key", "ring"], "left").select("key", "ring", "part", "hole", F.coalesce("free", middle).alias("p"))

    boxed = polygons.select("key", "edges", F.col("b.ymin").alias("low"), ((F.col("b.ymax") - F.col("b.ymin")) / F.ceil(F.sqrt(F.size("edges")))).alias("band"))
    band = lambda y: F.floor((y - F.col("low")) / F.col("band")).cast("long")
    edges = boxed.select("key", "low", "band", F.explode("edges").alias("e"))
    edges = edges.select("key", "e.*", F.explode(F.sequence(band(F.least("e.y0", "e.y1")), band(F.greatest("e.y0", "e.y1")))).alias("at"))
    rays = info.join(boxed.drop("edges"), "key").select("key", F.col("ring").alias("from"), "p.x", "p.y", band(F.col("p.y")).alias("at"))
    met = rays.join(edges, ["key", "at"]).where((F.col("from") != F.col("ring")) & ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))))
    right = F.col("x") < F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    inside = met.groupBy("key", "from", "ring").agg(F.count_if(right).alias("n")).where("n % 2 = 1")
    around = inside.join(info.select("key", "ring", "part", "hole"), ["key", "ring"]).groupBy("key", F.col("from").alias("ring")).agg(
        F.collect_set(F.when(~F.col("hole"), F.col("part"))).alias("shells"), F.collect_set(F.when(F.col("hole"), F.col("part"))).alias("holes")
    )
    none = F.array().cast("array<int>")
    placed = info.join(around, ["key", "ring"], "left").withColumns({c: F.coalesce(c, none) for c in ("shells", "holes")})
    own = F.col("part")
    in_place = F.array_contains("shells", own) & ~F.array_contains("holes", own)
    swallowed = F.exists(F.array_except("shells", "holes"), lambda p: p != own)
    return placed.where(F.when(F.col("hole"), ~in_place).otherwise(swallowed)).select("key")


def invalid_shapes(shapes: DataFrame, key: Sequence[str], geom: str = "geom") -> DataFrame:
    """Keys of the lines without length and of the polygons that are not valid; points and empty shapes are."""
    g = F.col(geom)
    some = shapes.where(g.isNotNull() & (F.size(g["parts"]) > 0)).select(F.struct(*key).alias("key"), F.explode(members(g)).alias("g"))
    # the lines and the polygons of a collection are judged apart
    some = some.select(F.struct("key", F.col("g.kind").alias("kind")).alias("key"), "g")
    g = F.col("g")
    flat = some.where(g["kind"].isin("LINESTRING", "MULTILINESTRING") & F.exists(rings(g), lambda r: F.size(F.array_distinct(r)) < 2))
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes but much work, so spread by number
    ringed = some.where(is_areal(g)).repartition(tasks, "key").select("key", _numbered_rings(g).alias("rings"), bounds(g).alias("b"))
    areal = written(ringed, "rings")
    if areal.isEmpty():
        return flat.select("key.key.*")
    odd = F.exists("rings", _bad_ring)
    sound = written(areal.where(~odd).select("key", "rings", "b", _numbered_edges(F.col("rings")).alias("edges")), "edges")
    parts = [flat.select("key"), areal.where(odd).select("key"), _crossed(sound.select("key", "b", "edges"), tasks)]
    parts.append(_misplaced(sound.where(F.size("rings") > 1)))
    return reduce(DataFrame.unionByName, parts).select("key.key.*").distinct()


@dataclass(frozen=True)
class Outline:
    """An area as cells, its box and one of its corners."""

    area: DataFrame
    box: Row
    corner: Row
    unit: float
    cells: DataFrame

    @classmethod
    def of(cls, area: DataFrame) -> Outline | None:
        """The outline of ``area(id_area, geom)``, one row; none without a shape."""
        found = area.select(bounds(F.col("geom")).alias("b"), first_vertex(F.col("geom")).alias("v")).first()
        if found is None or found["v"] is None:
            return None
        b = found["b"]
        unit = max(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) / 2**OUTLINE_LEVELS or 1.0
        return cls(area, b, found["v"], unit, written(quad_cells(area, unit), "outline"))

    def holding(self, points: DataFrame, x: str, y: str, spread: Column) -> DataFrame:
        """Points with ``id_areas``, which holds the area where a point lies in it or on its border."""
        return areas_of_points(points, self.area, self.unit, x, y, spread, with_border=True, cells=self.cells)


def shapes_meeting(shapes: DataFrame, key: Sequence[str], area: DataFrame | Outline, geom: str = "geom") -> DataFrame:
    """Keys of the shapes that share a position with ``area(id_area, geom)``, one row; borders belong to both."""
    outline = area if isinstance(area, Outline) else Outline.of(area)
    if outline is None:
        return shapes.limit(0).select(*key)
    b, corner, unit = outline.box, outline.corner, outline.unit
    g = F.col(geom)
    some = written(shapes.where(g.isNotNull() & (F.size(g["parts"]) > 0)).select(*key, F.explode(members(g)).alias("g")), "shapes")
    g = F.col("g")

    # edges meet the cells of the border: those of their own size or larger by the cells above them, smaller ones by theirs
    border = outline.cells.where(F.size("edges") > 0).select("level", "cx", "cy", F.col("edges").alias("outline"))
    step = F.col("at") - F.col("level")
    over = border.select("*", F.explode(F.sequence(F.col("level"), F.lit(OUTLINE_LEVELS + 1))).alias("at")).select(
        F.col("at").alias("level"), _up("cx", step).alias("cx"), _up("cy", step).alias("cy"), (step > 0).alias("above"), "outline"
    )
    over = written(over, "border")
    used = F.array(*[F.lit(r["level"]) for r in over.select("level").distinct().collect()]).cast("array<int>")  # some dozen
    over = F.broadcast(over) if small_enough(over, BROADCAST_KEYS, BROADCAST_BYTES) else over
    edges = some.select(*key, F.explode(segments(g)).alias("e"))
    length = F.greatest(F.abs(F.col("e.x1") - F.col("e.x0")), F.abs(F.col("e.y1") - F.col("e.y0")))
    level = F.least(F.lit(OUTLINE_LEVELS + 1), F.when(length > unit, F.ceil(F.log2(length / unit))).otherwise(0)).cast("int")
    sized = edges.withColumn("level", level).withColumn("side", F.lit(unit) * F.pow(F.lit(2.0), F.col("level")))

    def reach(low: Column, high: Column, first: float, last: float) -> Column:
        """Cells between two coordinates that also lie in the box of the area, with one more on either side."""
        a = F.greatest(F.floor(low / F.col("side")), F.floor(F.lit(first) / F.col("side")) - 1).cast("long")
        z = F.least(F.floor(high / F.col("side")), F.floor(F.lit(last) / F.col("side")) + 1).cast("long")
        return F.explode(F.when(a <= z, F.sequence(a, z)))

    across = sized.select("*", reach(F.least("e.x0", "e.x1"), F.greatest("e.x0", "e.x1"), b["xmin"], b["xmax"]).alias("cx"))
    celled = across.select("*", reach(F.least("e.y0", "e.y1"), F.greatest("e.y0", "e.y1"), b["ymin"], b["ymax"]).alias("cy"))
    up = F.col("at") - F.col("level")
    asked = celled.select("*", F.explode(F.filter(used, lambda k: k >= F.col("level"))).alias("at")).select(
        *key, "e", F.col("at").alias("level"), _up("cx", up).alias("cx"), _up("cy", up).alias("cy"), (up > 0).alias("raised")
    )
    # a raised edge looks for cells at their own level only, as others have met below
    met = asked.join(over, ["level", "cx", "cy"]).where(~(F.col("raised") & F.col("above")))
    touched = met.where(F.exists("outline", lambda f: touching(F.col("e"), f))).select(*key)

    # rings that touch no border lie inside or outside as a whole
    lone = F.size(segments(g)) == 0
    starts = F.when(lone, vertices(g)).otherwise(F.transform(rings(g), lambda r: F.get(r, F.lit(0))))
    begun = some.select(*key, F.explode(starts).alias("v")).select(*key, "v.x", "v.y")
    held = outline.holding(begun, "x", "y", F.xxhash64(*key)).where(F.size("id_areas") > 0).select(*key)
    around = some.where(is_areal(g) & in_rings(F.lit(corner["x"]), F.lit(corner["y"]), segments(g))).select(*key)
    return reduce(DataFrame.unionByName, [touched, held, around]).distinct()


def _up(column: str, step: Column) -> Column:
    """The cell ``step`` levels above one."""
    return F.floor(F.col(column) / F.pow(F.lit(2.0), step)).cast("long")
