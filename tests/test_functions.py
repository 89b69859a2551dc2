"""Casts, dates and geometry: boundary cells made from the rules."""

import datetime as dt
import itertools
import math
import uuid

import pytest
from pyspark.sql import functions as F

from obsload.functions import crs, dates, scalars
from obsload.functions.geometry import centroid, parse_wkt, to_wkt, within_convex
from obsload.operators.rows import count_columns
from obsload.operators.topology import invalid_shapes
from obsload.workspace import written


def values(spark, cells, expression):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    rows = df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_every_date_order_and_mark(spark):
    """Each way to write the last of November, with each mark and with every clock precision."""
    day, cells = dt.datetime(1998, 11, 30), {}
    for mark in "-/.":
        cells |= {mark.join(["1998", "11", "30"]): day, mark.join(["30", "11", "1998"]): day}
    clocks = {
        "": {}, " 4": {"hour": 4}, " 04:9": {"hour": 4, "minute": 9}, " 23:59:59": {"hour": 23, "minute": 59, "second": 59},
        " 0:0:0.5": {"microsecond": 500000}, " 18h": {"hour": 18}, " 18h6": {"hour": 18, "minute": 6},
        " 18H06m7s": {"hour": 18, "minute": 6, "second": 7},
    }
    for (text, moment), (clock, parts) in itertools.product(list(cells.items()), clocks.items()):
        cells[text + clock] = moment.replace(**parts)
    assert values(spark, list(cells), dates.lenient_timestamp) == list(cells.values())


def test_cells_just_beyond_a_date(spark):
    leap = {"2000-02-29": dt.datetime(2000, 2, 29), " 29.2.1996 ": dt.datetime(1996, 2, 29), "0001-1-1": dt.datetime(1, 1, 1)}
    beyond = [
        "1900-02-29", "31/04/2011", "2011-13-01", "2011-00-10", "0/1/2011", "98-11-30", "199-11-30", "30-11-98", "1998-11",
        "1998-11-30 24:00", "1998-11-30 7:60", "1998-11-30Z", "1998-11-30 at 7", "November 1998", "0000-11-30", "", " ",
    ]
    assert values(spark, [*leap, *beyond], dates.lenient_timestamp) == [*leap.values(), *[None] * len(beyond)]


def test_moments_follow_from_which_cells_are_empty(spark):
    """All sixteen ways to leave out the end, and the hours, against the rule stated plainly."""
    def start(day, hour):
        return day and f"{day} {hour or '00:00:00'}"

    def end(day, last, hour, late):
        on = last or day
        if on is None:
            return None
        same = day == on
        return f"{on} {late or ((hour or '00:00:00') if same else '00:00:00')}"

    rows = []
    for day, last, hour, late in itertools.product(["1998-11-30"], [None, "1998-11-30", "1998-12-02"], [None, "5:10"], [None, "6"]):
        rows.append((day, hour, last, late, start(day, hour), end(day, last, hour, late)))
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, s string, e string")
    a, b, c, d = (F.col(n) for n in "abcd")
    wrong = df.where(
        ~dates.start_text(a, b).eqNullSafe(F.col("s")) | ~dates.end_text(a, c, b, d).eqNullSafe(F.col("e"))
    )
    assert wrong.count() == 0


def test_integers_up_to_their_bounds(spark):
    fit = ["0", "-0", "+12", " 34\t", "2147483647", "-2147483648"]
    unfit = ["2147483648", "-2147483649", "1e3", "0x1", "--1", "1 2", ""]
    assert values(spark, fit, scalars.lenient_int) == [0, 0, 12, 34, 2**31 - 1, -(2**31)]
    assert values(spark, unfit, scalars.lenient_int) == [None] * len(unfit)


def test_coordinates_with_either_mark(spark):
    cells = {"48,5": 48.5, "-.25": -0.25, "7.": 7.0, "2E-1": 0.2, "north": None, "1,2,3": None, "5f": None}
    assert values(spark, list(cells), scalars.lenient_double) == list(cells.values())


def test_identifiers_are_forced_to_version_4(spark):
    plain = uuid.uuid5(uuid.NAMESPACE_DNS, "a station of this test")
    wanted = str(uuid.UUID(bytes=plain.bytes, version=4))
    said = [str(plain), str(plain).upper(), plain.hex, plain.urn, f"{{{plain}}}"]
    refused = ["", "station", plain.hex[1:], plain.hex + "0", str(plain).replace(plain.hex[0], "g", 1)]
    assert values(spark, said, scalars.normal_uuid) == [wanted] * len(said)
    assert values(spark, refused, scalars.normal_uuid) == [None] * len(refused)


def test_counts_take_the_default_then_each_other(spark):
    pairs = {(None, None): (3, 3), (7, None): (7, 7), (None, 9): (3, 9), (9, 7): (9, 7)}
    df = spark.createDataFrame(list(pairs), "lo int, hi int")
    low, high = count_columns(F.col("lo"), F.col("hi"), 3)
    assert [tuple(r) for r in df.select(low, high).collect()] == list(pairs.values())


def test_wkt_round_trip_and_refusals(spark):
    good = [
        "POINT (-7 0.5)", "LINESTRING (1 1, 2 3, 1 1)", "POLYGON ((0 0, 6 0, 6 6, 0 0), (3 1, 4 1, 4 2, 3 1))",
        "MULTIPOINT ((9 8))", "MULTILINESTRING ((0 1, 1 0), (5 5, 5 6, 6 6))",
        "MULTIPOLYGON (((0 0, 3 0, 0 3, 0 0)), ((7 7, 8 7, 8 8, 7 7)))", "POINT EMPTY",
    ]
    assert values(spark, good, lambda t: to_wkt(parse_wkt(t))) == good
    bad = ["POINT", "POINT()", "POINT(1;2)", "LINESTRING(4 4)", "POLYGON((0 0, 5 0, 5 5, 0 5))", "ELLIPSE(1 2)", " ", "POINT(3 4"]
    assert values(spark, bad, lambda t: to_wkt(parse_wkt(t))) == [None] * len(bad)


def test_polygon_of_many_vertices_parses(spark):
    n = 15000
    ring = [(math.cos(2 * math.pi * i / n) * 3, math.sin(2 * math.pi * i / n) * 3) for i in range(n)]
    text = "POLYGON((" + ",".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"
    (size,) = values(spark, [text], lambda t: F.size(F.get(parse_wkt(t)["parts"][0], F.lit(0))))
    assert size == n + 1


def test_validity(spark):
    outer = "0 0, 12 0, 12 12, 0 12, 0 0"
    cells = {
        f"POLYGON(({outer}))": True,
        f"POLYGON(({outer}), (5 5, 7 5, 6 7, 5 5))": True,
        f"POLYGON(({outer}), (15 5, 17 5, 16 7, 15 5))": False,
        f"POLYGON(({outer}), (10 5, 14 5, 14 7, 10 5))": False,
        "POLYGON((0 0, 4 4, 4 0, 0 4, 0 0))": False,
        "POLYGON((0 0, 3 0, 3 3, 3 0, 0 0))": False,
        f"MULTIPOLYGON((({outer})), ((30 0, 31 0, 31 1, 30 0)))": True,
        f"MULTIPOLYGON((({outer})), ((2 2, 3 2, 3 3, 2 2)))": False,
        "LINESTRING(6 6, 6 6)": False,
        "LINESTRING(6 6, 7 5)": True,
        "POINT(0 0)": True,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    parsed = written(df.select("i", parse_wkt(F.col("t")).alias("g")), "g")
    bad = {r["i"] for r in invalid_shapes(parsed, ["i"], "g").collect()}
    assert [i not in bad for i in range(len(cells))] == list(cells.values())


def test_centroids(spark):
    cells = {
        "POLYGON((1 1, 7 1, 7 3, 1 3, 1 1))": "POINT (4 2)", "LINESTRING(0 0, 0 6)": "POINT (0 3)",
        "MULTIPOINT(1 1, 5 3)": "POINT (3 2)", "POINT(-1 8)": "POINT (-1 8)",
        "MULTIPOLYGON(((0 0, 2 0, 2 2, 0 2, 0 0)), ((8 0, 10 0, 10 2, 8 2, 8 0)))": "POINT (5 1)",
    }
    got = values(spark, list(cells), lambda t: to_wkt(centroid(parse_wkt(t))))
    numbers = lambda text: [float(x) for x in text[7:-1].split()]
    assert [pytest.approx(numbers(v)) for v in cells.values()] == [numbers(v) for v in got]


def test_area_of_use(spark):
    inside, away = "POINT(652000 6862000)", "POINT(-3 48)"
    shape = "POLYGON((652000 6862000, 652010 6862000, 652010 6862010, 652000 6862000))"
    box = crs.area_of_use(crs.LOCAL)
    assert values(spark, [inside, away, shape], lambda t: within_convex(parse_wkt(t), box)) == [True, False, True]


def test_projection_origin_and_round_trip(spark):
    x, y = crs.to_local(F.lit(3.0), F.lit(46.5))
    lon, lat = crs.to_geographic(*crs.to_local(F.lit(-1.75), F.lit(48.125)))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat")).first()
    assert row["x"] == pytest.approx(700000, abs=1e-6) and row["y"] == pytest.approx(6600000, abs=1e-6)
    assert row["lon"] == pytest.approx(-1.75, abs=1e-10) and row["lat"] == pytest.approx(48.125, abs=1e-10)


def test_transverse_mercator_zones(spark):
    import math

    from obsload.functions.geometry import first_vertex, point, within_convex

    zone = crs.zone_of(32631)
    assert (zone.meridian, zone.south) == (3, False) and crs.zone_of(2975).meridian == 57 and crs.zone_of(2975).south
    assert crs.zone_of(25832).meridian == 9 and crs.zone_of(5490).meridian == -63 and crs.zone_of(27700) is None
    # along the meridian north is the scaled length of its arc, summed here in small steps
    f = zone.flattening
    e2 = f * (2 - f)
    steps = 200_000
    arc = sum(1 / (1 - e2 * math.sin(math.radians(47.5 * (i + 0.5) / steps)) ** 2) ** 1.5 for i in range(steps))
    arc *= 6378137.0 * (1 - e2) * math.radians(47.5) / steps
    east, north = zone.project(3, 47.5, math)
    assert abs(east - 500000) < 1e-6 and abs(north - 0.9996 * arc) < 1e-4
    # conformal: a small step east and one north have equal lengths on the map, at right angles
    def step(dlon, dlat):
        a, b = zone.project(5.2 - dlon, 47.5 - dlat, math), zone.project(5.2 + dlon, 47.5 + dlat, math)
        return b[0] - a[0], b[1] - a[1]
    w = 1 - e2 * math.sin(math.radians(47.5)) ** 2
    tiny = 1e-4
    by_lat, by_lon = (1 - e2) / w**1.5, math.cos(math.radians(47.5)) / w**0.5
    (x0, y0), (x1, y1) = step(tiny, 0), step(0, tiny)
    assert abs(math.hypot(x0, y0) / by_lon - math.hypot(x1, y1) / by_lat) < 1e-6 * math.hypot(x0, y0)
    assert abs(x0 * x1 + y0 * y1) < 1e-6 * math.hypot(x0, y0) ** 2
    places = [(500000.0, 5e6, True), (170000.0, 1e5, True), (100000.0, 5e6, False), (500000.0, -10.0, False), (290000.0, 8.1e6, False)]
    df = spark.createDataFrame(places, "x double, y double, inside boolean")
    got = df.select("inside", within_convex(point(F.col("x"), F.col("y")), crs.area_of_use(32631)).alias("found")).collect()
    assert all(r["inside"] == r["found"] for r in got)
    with pytest.raises(ValueError, match="27700"):
        crs.reproject(point(F.lit(1.0), F.lit(2.0)), 27700, crs.GEOGRAPHIC)
    with pytest.raises(ValueError, match="27700"):
        crs.area_of_use(27700)
    there = spark.range(1).select(crs.reproject(point(F.lit(55.5), F.lit(-21.1)), crs.GEOGRAPHIC, 2975).alias("g"))
    web = there.select(crs.reproject(F.col("g"), 2975, crs.WEB).alias("g"))
    back = web.select(first_vertex(crs.reproject(F.col("g"), crs.WEB, crs.GEOGRAPHIC)).alias("v")).first()["v"]
    assert abs(back["x"] - 55.5) < 1e-10 and abs(back["y"] + 21.1) < 1e-10


def test_collections_of_any_depth(spark):
    deep = "GEOMETRYCOLLECTION(" * 60 + "POINT(1 2),LINESTRING(0 0,1e1 1)" + ")" * 60
    cells = {
        deep: "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 10 1))",
        "geometrycollection z (point z (1 2 3), GeometryCollection EMPTY)": "GEOMETRYCOLLECTION (POINT (1 2))",
        "GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0,1 0,0 1,0 0)),((5 5,6 5,5 6,5 5),(5.1 5.1,5.2 5.1,5.1 5.2,5.1 5.1))))":
            "GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 0 1, 0 0)), POLYGON ((5 5, 6 5, 5 6, 5 5), (5.1 5.1, 5.2 5.1, 5.1 5.2, 5.1 5.1)))",
        " GEOMETRYCOLLECTION EMPTY ": "GEOMETRYCOLLECTION EMPTY",
    }
    assert values(spark, list(cells), lambda t: to_wkt(parse_wkt(t))) == list(cells.values())
    bad = [
        "GEOMETRYCOLLECTION(POINT(1 2)", "GEOMETRYCOLLECTION()", "GEOMETRYCOLLECTION(POINT(1 2),)", "GEOMETRYCOLLECTION(POINT(1 2)),POINT(1 1)",
        "GEOMETRYCOLLECTION((POINT(1 2)))", "GEOMETRYCOLLECTION(POINT(1 2) POINT(1 1))", "GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POINT(1 2)))),POINT(1 1)",
        "GEOMETRYCOLLECTION(CIRCLE(1 2))", "GEOMETRYCOLLECTION(POINT(1 2),POLYGON((0 0,1 0,0 1)))",
    ]
    assert values(spark, bad, lambda t: to_wkt(parse_wkt(t))) == [None] * len(bad)
    bow = "GEOMETRYCOLLECTION(POINT(1 2), POLYGON((0 0, 4 4, 4 0, 0 4, 0 0)))"
    flat = "GEOMETRYCOLLECTION(LINESTRING(1 1, 1 1), POLYGON((0 0, 4 4, 4 0, 0 0)))"
    df = spark.createDataFrame([(0, deep), (1, bow), (2, flat), (3, list(cells)[2])], "i int, t string")
    parsed = written(df.select("i", parse_wkt(F.col("t")).alias("g")), "g")
    assert {r["i"] for r in invalid_shapes(parsed, ["i"], "g").collect()} == {1, 2}
    inside = parsed.select("i", within_convex(F.col("g"), [(-1, -1), (8, -1), (8, 8), (-1, 8)]).alias("in")).collect()
    assert {r["i"]: r["in"] for r in inside} == {0: False, 1: True, 2: True, 3: True}
