"""Areas of points by quadtree cells against an even-odd test with all edges, whichever way points meet the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsload.functions.geometry import parse_wkt, segments
from obsload.operators import quads


def ring_text(ring):
    return "(" + ", ".join(f"{x} {y}" for x, y in ring) + ")"


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, r[1:], strict=False):
            if (x1 - x0) * (y - y0) == (y1 - y0) * (x - x0) and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
                return False
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
    return odd


def shapes():
    rng = np.random.default_rng(2)
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    far = 30 + rng.uniform(-6, 6, 400)
    jagged = [(round(float(f * np.cos(t)), 4), round(float(f * np.sin(t)), 4)) for f, t in zip(far, turn, strict=True)]
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    return {
        1: [jagged + jagged[:1], box(-4, -4, 8)],
        2: [box(0, 0, 1)],
        3: [box(1, 0, 1)],
        4: [box(-64, -64, 128)],
        5: [[(0, 0), (16, 0), (0, 16), (0, 0)]],
        6: [box(3.5, 3.5, 0.01)],
    }


@pytest.mark.parametrize("keys, few", [(quads.BROADCAST_KEYS, 16), (0, 16), (0, 3)])
def test_points_against_all_edges(spark, monkeypatch, keys, few):
    monkeypatch.setattr(quads, "FEW", few)
    areas = shapes()
    rng = np.random.default_rng(4)
    points = [(float(x), float(y)) for x, y in rng.uniform(-40, 40, (900, 2)).round(3)]
    points += [(float(x), float(y)) for x in range(-6, 18, 2) for y in range(-6, 18, 2)]  # on borders and corners
    points += [(0.5, 0.5)] * 700 + [(3.505, 3.505), (1e6, 0.0)]
    rows = [(i, x, y) for i, (x, y) in enumerate(points)] + [(-1, None, 0.5)]
    df = spark.createDataFrame(rows, "n int, x double, y double").repartition(4)
    wkt = [(i, "POLYGON(" + ", ".join(map(ring_text, r)) + ")") for i, r in areas.items()] + [(9, "POLYGON EMPTY"), (10, None)]
    known = spark.createDataFrame(wkt, "id_area int, wkt string").select("id_area", parse_wkt(F.col("wkt")).alias("geom"))
    out = quads.areas_of_points(df, known, 0.5, "x", "y", F.col("n"), broadcast_keys=keys)
    assert out.columns == ["n", "x", "y", "id_areas"]
    got = {r["n"]: r["id_areas"] for r in out.collect()}
    assert len(got) == len(rows) and got.pop(-1) == []
    for n, (x, y) in enumerate(points):
        assert got[n] == [i for i, rings in areas.items() if inside(rings, x, y)], (x, y)


def test_cells_are_small_along_borders_only(spark):
    wkt = [(i, "POLYGON(" + ", ".join(map(ring_text, r)) + ")") for i, r in shapes().items()]
    known = spark.createDataFrame(wkt, "id_area int, wkt string").select("id_area", parse_wkt(F.col("wkt")).alias("geom"))
    cells = quads.quad_cells(known, 0.25).select("id_area", "level", F.size("edges").alias("n")).collect()
    few = [r for r in cells if r["id_area"] in (2, 3, 4, 5, 6)]
    assert len(few) <= 4 * 9 and all(r["n"] <= quads.FEW or r["level"] == 0 for r in cells)
    coast = [r for r in cells if r["id_area"] == 1]
    assert 25 < len(coast) < 400 and len({r["level"] for r in coast}) > 2


def test_no_areas(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    none = spark.createDataFrame([], "id_area int, wkt string").select("id_area", parse_wkt(F.col("wkt")).alias("geom"))
    assert quads.areas_of_points(points, none, 1.0, "x", "y", F.col("x")).first()["id_areas"] == []


@pytest.mark.parametrize("many", [4, 60])
def test_cells_of_edges_in_rows(spark, monkeypatch, many):
    monkeypatch.setattr(quads, "MANY", many)
    monkeypatch.setattr(quads, "FEW", 4)
    wkt = [(i, "POLYGON(" + ", ".join(map(ring_text, r)) + ")") for i, r in shapes().items()]
    # one edge above all others, and an area whose corners lie on those of cells
    wkt.append((7, "POLYGON((-100 -100, 100 -100, 0 -99.5, -100 -100))"))
    wkt.append((8, "POLYGON((" + ", ".join(f"{x} {-8 if x % 2 else 8}" for x in range(-16, 17)) + ", 16 -16, -16 -16, -16 8))"))
    known = spark.createDataFrame(wkt, "id_area int, wkt string").select("id_area", parse_wkt(F.col("wkt")).alias("geom"))
    edges = known.select("id_area", F.explode(segments(F.col("geom"))).alias("e")).select("id_area", "e.*")
    odd = spark.createDataFrame([(1, None, 1.0, 2.0, 2.0), (11, None, 1.0, None, 2.0)], "id_area int, x0 double, y0 double, x1 double, y1 double")
    told = [
        sorted(map(str, cells.withColumn("edges", F.array_sort("edges")).select("id_area", "level", "cx", "cy", "inside", "edges").collect()))
        for cells in (quads.quad_cells(known, 0.25), quads.edge_cells(edges.unionByName(odd), 0.25))
    ]
    assert told[0] == told[1] and len(told[0]) > 100
    assert quads.edge_cells(edges.limit(0), 0.25).isEmpty()
