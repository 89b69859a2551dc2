"""Validity of polygons and meeting of shapes, by joins of edges, against plain tests of all edges."""

import numpy as np
import pytest
from plain_shapes import apart_from, valid_polygon
from pyspark.sql import functions as F

from obsload.functions.geometry import parse_wkt
from obsload.operators import topology
from obsload.workspace import written


def flat(parts):
    rings = [r for p in parts for r in p]
    xy = np.array([v for r in rings for v in r], dtype=float)
    return xy[:, 0], xy[:, 1], np.array([len(r) for r in rings]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def text(ring):
    return "(" + ", ".join(f"{x} {y}" for x, y in ring) + ")"


def wkt(kind, parts):
    if kind == "LINESTRING":
        return f"{kind} {text(parts[0][0])}"
    if kind == "MULTIPOINT":
        return f"{kind} {text(parts[0][0])}"
    bodies = ["(" + ", ".join(map(text, p)) + ")" for p in parts]
    return f"{kind} {bodies[0]}" if kind == "POLYGON" else f"MULTIPOLYGON ({', '.join(bodies)})"


def star(rng, n, x, y, size, integers=True):
    """A ring round a position, now and then with two corners swapped."""
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.4, 1, n) * size
    ring = [(x + f * np.cos(t), y + f * np.sin(t)) for f, t in zip(far, turn, strict=True)]
    ring = [(round(float(a)), round(float(b))) if integers else (round(float(a), 3), round(float(b), 3)) for a, b in ring]
    if rng.random() < 0.3:
        i, j = rng.integers(0, n, 2)
        ring[i], ring[j] = ring[j], ring[i]
    return ring + ring[:1]


def polygons(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 4)):
            x, y = rng.integers(-12, 12, 2)
            rings = [star(rng, int(rng.integers(3, 9)), x, y, 9)]
            for _ in range(rng.integers(0, 3)):
                rings.append(star(rng, int(rng.integers(3, 5)), x + rng.integers(-3, 4), y + rng.integers(-3, 4), 3))
            parts.append(rings)
        out.append(parts)
    for size in (40, 300, 900):
        for good in (True, False):
            ring = star(np.random.default_rng(size), size, 0, 0, 50, False)
            ring = sorted(ring[:-1], key=lambda p: np.arctan2(p[1], p[0])) if good else ring[:-1]
            if not good:
                ring[3], ring[size // 2] = ring[size // 2], ring[3]
            out.append([[[*ring, ring[0]], [(-1, -1), (1, -1), (0, 1), (-1, -1)]]])
    fan = [(0, 0)]
    for i in range(30):  # thirty tips that come back to one corner
        fan += [(10 + i, 40 - i), (10.5 + i, 39.5 - i), (0, 0)]
    return [*out, [[fan]]]


@pytest.mark.parametrize("few", [16, 3])
def test_validity_against_all_edges(spark, monkeypatch, few):
    monkeypatch.setattr(topology, "FEW", few)
    shapes = polygons(few, 150)
    rows = [(1, i, wkt("MULTIPOLYGON", p)) for i, p in enumerate(shapes)]
    df = spark.createDataFrame(rows, "a int, i int, t string").select("a", "i", parse_wkt(F.col("t")).alias("geom"))
    known = written(df, "known")
    read = {r["i"] for r in known.where("geom IS NOT NULL").select("i").collect()}
    bad = {r["i"] for r in topology.invalid_shapes(known, ["a", "i"]).collect()}
    expected = {i for i, p in enumerate(shapes) if i in read and not valid_polygon(*flat(p))}
    assert bad == expected and 20 < len(bad) < len(read) - 20


def test_other_kinds(spark):
    cells = {
        "POINT (1 2)": True, "POINT EMPTY": True, "MULTIPOINT (1 1, 1 1)": True, "LINESTRING (1 1, 2 2, 1 1)": True,
        "LINESTRING (1 1, 1 1)": False, "MULTILINESTRING ((0 0, 1 1), (2 2, 2 2))": False, "POLYGON EMPTY": True, None: True,
        "POLYGON ((0 0, 4 0, 4 0, 4 4, 0 0))": True, "POLYGON ((0 0, 4 0, 8 0, 0 0))": False,
    }
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, t string").select("i", parse_wkt(F.col("t")).alias("geom"))
    bad = {r["i"] for r in topology.invalid_shapes(written(rows, "kinds"), ["i"]).collect()}
    assert [i not in bad for i in range(len(cells))] == list(cells.values())
    assert topology.invalid_shapes(rows.limit(0), ["i"]).count() == 0


@pytest.mark.parametrize("corners, few", [(7, 16), (400, 16), (400, 3)])
def test_meeting_against_all_edges(spark, monkeypatch, corners, few):
    from obsload.operators import quads

    monkeypatch.setattr(quads, "FEW", few)
    rng = np.random.default_rng(corners)
    ring = sorted(star(rng, corners, 0, 0, 60, False)[:-1], key=lambda p: np.arctan2(p[1], p[0]))
    hole = [(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)]
    area = [[[*ring, ring[0]], hole]]
    outline = np.array([(*a, *b) for r in area[0] for a, b in zip(r, r[1:], strict=False)], dtype=float)
    made = []
    for i in range(240):
        x, y = rng.uniform(-75, 75, 2).round(2)
        size = float(rng.choice([0.05, 1, 8, 90]))
        n = int(rng.integers(3, 7))
        shape = star(rng, n, float(x), float(y), size, False)
        kind = ["POLYGON", "LINESTRING", "MULTIPOINT"][i % 3]
        made.append((kind, [[shape if kind == "POLYGON" else shape[:-1]]]))
    made += [
        ("POLYGON", [[[(-2, -2), (2, -2), (0, 2), (-2, -2)]]]),  # in the hole
        ("POLYGON", [[[(-9, -9), (-5, -9), (-5, -5), (-9, -9)]]]),  # in the hole, along its border
        ("POLYGON", [[[(-200, -200), (200, -200), (200, 200), (-200, 200), (-200, -200)]]]),
        ("LINESTRING", [[[(9, 9), (5, 5)]]]), ("MULTIPOINT", [[[(9, 3), (0, 0)]]]), ("LINESTRING", [[[(-300, 0.5), (300, 0.5)]]]),
    ]
    rows = [(i, wkt(*s)) for i, s in enumerate(made)] + [(-1, None), (-2, "POLYGON EMPTY")]
    df = written(spark.createDataFrame(rows, "i int, t string").select("i", parse_wkt(F.col("t")).alias("geom")), "made")
    known = spark.createDataFrame([(1, wkt("POLYGON", area))], "id_area int, t string").select("id_area", parse_wkt(F.col("t")).alias("geom"))
    got = {r["i"] for r in topology.shapes_meeting(df, ["i"], written(known, "area")).collect()}
    read = {r["i"] for r in df.where("geom IS NOT NULL AND i >= 0").select("i").collect()}
    expected = set()
    for i, (kind, parts) in enumerate(made):
        xs, ys, sizes, _ = flat(parts)
        if kind == "MULTIPOINT":
            xs, ys, sizes = xs, ys, np.ones(len(xs), int)
        if i in read and not apart_from(xs, ys, sizes, kind == "POLYGON", outline):
            expected.add(i)
    assert got == expected and 30 < len(got) < 220
    assert topology.shapes_meeting(df, ["i"], known.limit(0)).count() == 0


def test_few_bytes_of_shapes_are_spread_over_tasks(spark):
    squares = spark.range(40).coalesce(1).select(
        "id", parse_wkt(F.concat(F.lit("POLYGON((0 0, "), F.col("id").cast("string"), F.lit(" 0, 3 3, 0 3, 0 0))"))).alias("geom")
    )
    bad = topology.invalid_shapes(written(squares, "one-task"), ["id"])
    assert len([f for f in bad.inputFiles() if "/edge-cells-" in f]) > 1
    assert bad.collect() == []
