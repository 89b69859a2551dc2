"""Altitudes under shapes against a plain test of every cell; blocks of runs against the cells they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsload.functions.geometry import parse_wkt
from obsload.operators import elevation


def wkt(kind, rings):
    parts = ["(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings]
    return f"{kind} ({', '.join(parts)})" if kind == "POLYGON" else f"{kind} {parts[0]}"


def meets(a, b, left, bottom, size):
    """A segment and a closed square, by clipping against its four sides."""
    t0, t1 = 0.0, 1.0
    for p, q in ((b[0] - a[0], (left, left + size, a[0])), (b[1] - a[1], (bottom, bottom + size, a[1]))):
        low, high, at = q
        if p == 0:
            if not low <= at <= high:
                return False
        else:
            s, e = sorted(((low - at) / p, (high - at) / p))
            t0, t1 = max(t0, s), min(t1, e)
    return t0 <= t1


def covered(kind, rings, size, cells):
    edges = [(r[i], r[i + 1]) for r in rings for i in range(len(r) - 1)]
    for cx, cy in cells:
        x, y = (cx + 0.5) * size, (cy + 0.5) * size
        inside = kind == "POLYGON" and sum(
            (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges
        ) % 2
        if inside or any(meets(a, b, cx * size, cy * size, size) for a, b in edges):
            yield cx, cy


@pytest.mark.parametrize("size", [1.0, 2.5])
def test_shapes_against_every_cell(spark, size):
    rng = np.random.default_rng(int(size * 10))
    shapes = {}
    for i in range(12):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 9))
        far = rng.uniform(3, 40, 9)
        ring = [(round(float(f * np.cos(t)) + 3, 3), round(float(f * np.sin(t)) - 2, 3)) for f, t in zip(far, turn, strict=True)]
        hole = [(2.1, -2.2), (3.3, -1.1), (3.9, -2.7), (2.1, -2.2)]
        shapes[f"p{i}"] = ("POLYGON", [ring + ring[:1], *([hole] if i % 2 else [])])
        shapes[f"l{i}"] = ("LINESTRING", [ring])
    shapes["flat"] = ("LINESTRING", [[(-20.3, 4.4), (31.2, 4.4)]])
    shapes["steep"] = ("LINESTRING", [[(4.4, -20.3), (4.4, 31.2), (4.6, 31.2)]])
    span = range(-22, 23) if size > 1 else range(-45, 46)
    cells = [(cx, cy) for cx in span for cy in span if rng.random() < 0.7]
    alt = {c: int(rng.integers(0, 4000)) for c in cells}
    grid = spark.createDataFrame([(cx, cy, a) for (cx, cy), a in alt.items()], "cx long, cy long, alt int")
    rows = spark.createDataFrame([(k, wkt(*s)) for k, s in shapes.items()], "geo_key string, wkt string")
    rows = rows.select("geo_key", parse_wkt(F.col("wkt")).alias("geom"))
    got = {r["geo_key"]: (r["alt_low"], r["alt_high"]) for r in elevation.shape_altitudes(rows, grid, size).collect()}
    for key, (kind, rings) in shapes.items():
        under = [alt[c] for c in covered(kind, rings, size, cells)]
        assert got.get(key) == ((min(under), max(under)) if under else None), key


@pytest.mark.parametrize("top", [0, 3, 8])
def test_blocks_make_up_the_runs(spark, top):
    rng = np.random.default_rng(top)
    runs = [(f"r{i}", 1, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-600, 600, 80), rng.integers(0, 700, 80), strict=True))]
    df = spark.createDataFrame(runs, "geo_key string, cy long, first long, last long")
    found = {}
    for r in elevation.run_blocks(df, top).collect():
        size = 2 ** r["level"]
        found.setdefault(r["geo_key"], []).append(range(r["block"] * size, (r["block"] + 1) * size))
    for key, _, first, last in runs:
        cells = sorted(c for block in found[key] for c in block)
        assert cells == list(range(first, last + 1))  # each once
        assert len(found[key]) <= 2 * top + 1 + (last - first + 1) // 2**top


def test_a_department_needs_few_rows(spark):
    side = 4000.0  # cells of a row
    shape = f"POLYGON((0.5 0.5, {side} 700, {side + 300} {side}, 100 {side - 40}, 0.5 0.5))"
    rows = spark.createDataFrame([("a", shape)], "geo_key string, wkt string").select("geo_key", parse_wkt(F.col("wkt")).alias("geom"))
    blocks = elevation.run_blocks(elevation.band_runs(rows, 1.0)).count()
    assert blocks < 40 * side < 0.05 * side * side
