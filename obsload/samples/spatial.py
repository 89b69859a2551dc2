"""Positions, shapes, areas, projections and altitudes on customers and nations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsload.functions import crs, scalars
from obsload.functions.geometry import (
    GEOMETRY,
    centroid,
    first_vertex,
    parse_wkt,
    point,
    to_wkt,
    vertices,
    within_convex,
)
from obsload.model.dictionary import DICTIONARY
from obsload.operators import quads
from obsload.operators.elevation import AREA_KEY, filled_altitudes, with_altitudes
from obsload.operators.georef import attach_areas, attachment_checks, both_systems
from obsload.operators.issues import long_issues, with_issues
from obsload.operators.rows import position_checks, read_position
from obsload.operators.stats import extent
from obsload.operators.topology import Outline, invalid_shapes, shapes_meeting
from obsload.samples.registry import case, query, table, text
from obsload.workspace import written

# nations as squares of side 10 on a 5 by 5 board; customers scattered over it off the borders
_BOARD = """x0 AS (SELECT n_nationkey AS id, n_regionkey, (n_nationkey % 5) * 10.0 AS x,
  floor(n_nationkey / 5) * 10.0 AS y FROM nation),
c AS (SELECT c_custkey, c_nationkey, (c_custkey * 37 % 5000) / 100.0 + 0.005 AS x,
  (c_custkey * 53 % 5100) / 100.0 + 0.005 AS y FROM customer)"""


COAST = 1000


def customers(spark, folder):
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key,
        "c_nationkey",
        ((key * 37 % 5000) / 100.0 + 0.005).alias("x"),
        ((key * 53 % 5100) / 100.0 + 0.005).alias("y"),
    )


def _coords(*pairs):
    return F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in pairs])


def square_wkt(x, y, side=10):
    """A square from its lower left corner."""
    ring = _coords((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


def rectangle_wkt(x, y, width, height):
    ring = _coords((x, y), (x + width, y), (x + width, y + height), (x, y + height), (x, y))
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


def triangle_wkt(x, y, side=10):
    ring = _coords((x, y), (x + side, y), (x, y + side), (x, y))
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


def nations(spark, folder, shape=square_wkt):
    key = F.col("n_nationkey")
    x, y = (key % 5) * 10, F.floor(key / 5) * 10
    return table(spark, folder, "nation").select(
        key.alias("id_area"),
        case(F.col("n_regionkey"), 3, "COM", "DEP", "M10").alias("type"),
        F.col("n_name").alias("code"),
        parse_wkt(shape(x, y)).alias("geom"),
    )


@query(
    "xy_points",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'east' WHEN 1 THEN NULL
  ELSE CAST(c_custkey % 180 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN ',' ELSE '.' END || '25' END AS lon,
  CASE WHEN c_custkey % 9 = 0 THEN '4e1' ELSE '-' || CAST(c_custkey % 90 AS VARCHAR) END AS lat FROM customer),
v AS (SELECT c_custkey, lon, TRY_CAST(replace(lon, ',', '.') AS DOUBLE) AS x, TRY_CAST(lat AS DOUBLE) AS y FROM t)
SELECT c_custkey, CASE WHEN x IS NOT NULL THEN CAST(x * 100 AS BIGINT) END AS x100,
  CASE WHEN x IS NOT NULL THEN CAST(y * 100 AS BIGINT) END AS y100,
  CASE WHEN lon IS NOT NULL AND x IS NULL THEN 'INVALID_GEOMETRY' END AS code FROM v""",
)
def xy_points(spark, folder):
    key = F.col("c_custkey")
    mark = F.when(key % 2 == 0, ",").otherwise(".")
    lon = F.concat(text(key % 180), mark, F.lit("25"))
    rows = table(spark, folder, "customer").select(
        key,
        case(key, 5, "east", None, lon).alias("lon"),
        F.when(key % 9 == 0, "4e1").otherwise(F.concat(F.lit("-"), text(key % 90))).alias("lat"),
    )
    g = point(scalars.lenient_double(F.col("lon")), scalars.lenient_double(F.col("lat")))
    placed = rows.withColumn("g", g)
    head = first_vertex(F.col("g"))
    failed = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("g").isNull()
    return placed.select(
        key,
        F.round(head["x"] * 100).cast("long").alias("x100"),
        F.round(head["y"] * 100).cast("long").alias("y100"),
        F.when(failed, "INVALID_GEOMETRY").alias("code"),
    )


_GEOREF_FIELDS = {
    f.name: f
    for f in DICTIONARY.named(
        ["WKT", "longitude", "latitude", "codecommune", "codemaille", "codedepartement"]
    )
}


@query(
    "georef_rules",
    """WITH t AS (SELECT c_custkey + 1 AS line_no,
  CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'POINT(a b)' WHEN c_custkey % 5 = 1
    THEN 'POINT(200 10)' ELSE 'POINT(' || c_custkey % 90 || ' 10)' END END AS wkt,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'x' WHEN c_custkey % 7 = 1 THEN '400'
    ELSE CAST(c_custkey % 90 AS VARCHAR) END END AS lon,
  CASE WHEN c_custkey % 6 <> 3 THEN '5' END AS lat,
  CASE WHEN c_custkey % 5 < 2 THEN 'c' END AS c1, CASE WHEN c_custkey % 7 < 3 THEN 'c' END AS c2 FROM customer),
m AS (SELECT *, wkt IS NOT NULL AS w, lon IS NOT NULL AND lat IS NOT NULL AS p,
  (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT AS n FROM t)
SELECT line_no, 'INVALID_WKT' AS code, 'WKT' AS "column" FROM m WHERE wkt = 'POINT(a b)'
UNION ALL SELECT line_no, 'INVALID_GEOMETRY', 'longitude' FROM m WHERE p AND lon = 'x'
UNION ALL SELECT line_no, 'MULTIPLE_ATTACHMENT_TYPE_CODE', 'Champs géométriques' FROM m WHERE w AND p
UNION ALL SELECT line_no, 'GEOMETRY_OUT_OF_BOX', 'WKT' FROM m WHERE w AND NOT p AND wkt = 'POINT(200 10)'
UNION ALL SELECT line_no, 'GEOMETRY_OUT_OF_BOX', 'longitude' FROM m WHERE p AND NOT w AND lon = '400'
UNION ALL SELECT line_no, 'MULTIPLE_CODE_ATTACHMENT', 'Champs géométriques' FROM m WHERE NOT w AND NOT p AND n >= 2
UNION ALL SELECT line_no, 'NO-GEOM', 'Champs géométriques' FROM m WHERE NOT w AND NOT p AND n = 0""",
)
def georef_rules(spark, folder):
    key = F.col("c_custkey")
    shifted = text(key % 90)
    wkt = case(key, 5, "POINT(a b)", "POINT(200 10)", F.concat(F.lit("POINT("), shifted, F.lit(" 10)")))
    rows = table(spark, folder, "customer").select(
        F.lit(1).alias("id_load"),
        (key + 1).alias("line_no"),
        F.when(key % 4 == 0, wkt).alias("src_WKT"),
        F.when(key % 3 == 0, case(key, 7, "x", "400", shifted)).alias("src_longitude"),
        F.when(key % 6 != 3, "5").alias("src_latitude"),
        F.when(key % 5 < 2, "c").alias("src_codecommune"),
        F.when(key % 7 < 3, "c").alias("src_codemaille"),
        F.lit(None).cast("string").alias("src_codedepartement"),
    )
    checks, _ = position_checks(_GEOREF_FIELDS)
    found = with_issues(read_position(rows, _GEOREF_FIELDS, crs.GEOGRAPHIC), checks)
    return long_issues(found).select("line_no", "code", "column")


@query(
    "out_of_box",
    f"""WITH {_BOARD} SELECT c_custkey, x > 5 AND x < 40 AND y > 5 AND y < 40 AND x + y < 60 AS inside,
  x >= 5 AND x + 1 <= 40 AND y >= 5 AND y + 1 <= 40 AND x + 1 + y + 1 <= 60 AS square_inside FROM c""",
)
def out_of_box(spark, folder):
    box = [(5.0, 5.0), (40.0, 5.0), (40.0, 20.0), (20.0, 40.0), (5.0, 40.0)]
    rows = customers(spark, folder).withColumns(
        {
            "p": point(F.col("x"), F.col("y")),
            "q": parse_wkt(square_wkt(F.col("x"), F.col("y"), 1)),
        }
    )
    return rows.select(
        "c_custkey",
        within_convex(F.col("p"), box).alias("inside"),
        within_convex(F.col("q"), box).alias("square_inside"),
    )


@query(
    "wkt_parse",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' WHEN 2 THEN 'POLYGON'
  WHEN 3 THEN 'MULTIPOINT' WHEN 4 THEN 'MULTIPOLYGON' END AS kind,
  CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 8 END AS n_vertices,
  CASE WHEN c_custkey % 7 < 5 THEN c_custkey END AS first_x FROM customer""",
)
def wkt_parse(spark, folder):
    key = F.col("c_custkey")
    k, one = text(key), text(key + 1)

    def build(pattern):
        return F.replace(F.replace(F.lit(pattern), F.lit("{n}"), one), F.lit("{k}"), k)

    shape = case(
        key,
        7,
        build("Point({k} 1)"),
        build(" linestring ( {k} 0,{n} 1 , {n} 2)"),
        build("POLYGON(({k} 0, {n} 0, {n} 1, {k} 1, {k} 0))"),
        build("MULTIPOINT(({k} 0),({n} 1e0))"),
        build("MULTIPOLYGON((({k} 0,{n} 0,{n} 1,{k} 0)),(({k} 5,{n} 5,{n} 6,{k} 5)))"),
        build("POLYGON(({k} 0, {n} 0, {n} 1))"),
        build("POINT({k} x)"),
    )
    rows = table(spark, folder, "customer").select(key, parse_wkt(shape).alias("g"))
    return rows.select(
        key,
        F.col("g.kind").alias("kind"),
        F.when(F.col("g").isNotNull(), F.size(vertices(F.col("g")))).alias("n_vertices"),
        first_vertex(F.col("g"))["x"].cast("long").alias("first_x"),
    )


@query(
    "wkt_collections",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'GEOMETRYCOLLECTION (POINT (' || c_custkey % 90 || ' 1), POLYGON ((0 0, 9 0, 0 9, 0 0)))'
  WHEN 1 THEN 'GEOMETRYCOLLECTION (LINESTRING (0 0, ' || c_custkey % 90 + 1 || ' 2), POINT (5 6), POINT (7 8.5))'
  WHEN 2 THEN 'GEOMETRYCOLLECTION EMPTY' END AS wkt,
  CASE c_custkey % 5 WHEN 0 THEN '3 3' WHEN 1 THEN (c_custkey % 90 + 1) / 2.0 || ' 1.0' END AS centre
FROM customer""",
)
def wkt_collections(spark, folder):
    """Collections in collections, of any depth; the members of the highest dimension make the centre."""
    key = F.col("c_custkey")
    made = case(
        key, 5,
        F.concat(F.lit("geometrycollection ( GEOMETRYCOLLECTION(POINT("), text(key % 90), F.lit(" 1)), POLYGON ((0 0, 9 0, 0 9, 0 0)))")),
        F.concat(F.lit("GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(LINESTRING(0 0,"), text(key % 90 + 1),
                 F.lit(" 2)),GEOMETRYCOLLECTION EMPTY),MULTIPOINT((5 6),(7 8.5)))")),
        "GEOMETRYCOLLECTION EMPTY",
        "GEOMETRYCOLLECTION(POINT(1 2)),POINT(3 4)",
        "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(1 2), POINT(3 4))",
    )
    rows = written(table(spark, folder, "customer").select(key, parse_wkt(made).alias("g")), "collections")
    v = first_vertex(centroid(F.col("g")))
    whole = lambda x: F.regexp_replace(F.round(x, 6).cast("string"), r"\.0$", "")
    near = F.when(key % 5 == 0, F.concat_ws(" ", whole(v["x"]), whole(v["y"]))).otherwise(F.concat(v["x"].cast("string"), F.lit(" "), v["y"].cast("string")))
    return rows.select(key, to_wkt(F.col("g")).alias("wkt"), F.when(v.isNotNull(), near).alias("centre"))


@query(
    "shape_validity",
    """SELECT c_custkey, c_custkey % 4 <> 1 AND c_custkey % 4 <> 3 AS valid FROM customer""",
)
def shape_validity(spark, folder):
    x, y = F.col("c_custkey") % 97, F.col("c_custkey") % 89
    bow = F.concat(
        F.lit("POLYGON(("), _coords((x, y), (x + 2, y + 2), (x + 2, y), (x, y + 2), (x, y)), F.lit("))")
    )
    holed = F.concat(
        F.lit("POLYGON(("),
        _coords((x, y), (x + 9, y), (x + 9, y + 9), (x, y + 9), (x, y)),
        F.lit("),("),
        _coords((x + 2, y + 2), (x + 4, y + 2), (x + 4, y + 4), (x + 2, y + 2)),
        F.lit("))"),
    )
    stray = F.concat(
        F.lit("POLYGON(("),
        _coords((x, y), (x + 9, y), (x + 9, y + 9), (x, y + 9), (x, y)),
        F.lit("),("),
        _coords((x + 20, y + 2), (x + 24, y + 2), (x + 24, y + 4), (x + 20, y + 2)),
        F.lit("))"),
    )
    shape = case(F.col("c_custkey"), 4, square_wkt(x, y), bow, holed, stray)
    # few bytes but much work, so spread by number
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = table(spark, folder, "customer").select("c_custkey").repartition(tasks, "c_custkey")
    rows = written(keys.select("c_custkey", parse_wkt(shape).alias("g")), "shapes")
    bad = invalid_shapes(rows, ["c_custkey"], "g").withColumn("bad", F.lit(True))
    return rows.join(bad, "c_custkey", "left").select("c_custkey", F.col("bad").isNull().alias("valid"))


@query(
    "shape_centroid",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 97 + 5.0) * 12
  WHEN 1 THEN (c_custkey % 97) * 12.0 + 40 WHEN 2 THEN (c_custkey % 97) * 12.0 + 12
  ELSE (c_custkey % 97) * 12.0 + 12 END AS x12 FROM customer""",
)
def shape_centroid(spark, folder):
    x, y = F.col("c_custkey") % 97, F.col("c_custkey") % 89
    line = F.concat(F.lit("LINESTRING("), _coords((x, y), (x + 2, y)), F.lit(")"))
    both = F.concat(F.lit("MULTIPOINT("), _coords((x, y), (x + 2, y + 2)), F.lit(")"))
    shape = case(F.col("c_custkey"), 4, square_wkt(x, y), triangle_wkt(x, y), line, both)
    rows = table(spark, folder, "customer").select("c_custkey", parse_wkt(shape).alias("g"))
    middle = first_vertex(centroid(F.col("g")))
    return rows.select("c_custkey", F.round(middle["x"] * 12, 6).alias("x12"))


@query(
    "area_attach",
    """WITH c AS (SELECT c_custkey + 1 AS line_no, c_custkey % 4 <> 0 AS row_ok, c_custkey % 6 = 0 AS placed,
  CASE WHEN c_custkey % 3 = 1 THEN 'NATION_' || (c_custkey % 30) END AS com,
  CASE WHEN c_custkey % 3 = 2 THEN 'NATION_' || (c_custkey % 30) END AS dep FROM customer),
a AS (SELECT n_nationkey AS id, n_name, CASE n_regionkey % 3 WHEN 0 THEN 'COM' WHEN 1 THEN 'DEP' ELSE 'M10' END AS t
  FROM nation),
j AS (SELECT c.*, a.id FROM c LEFT JOIN a ON row_ok AND NOT placed AND ((t = 'COM' AND n_name = com)
  OR (t = 'DEP' AND n_name = dep)))
SELECT line_no, CAST(id AS VARCHAR) AS area, CASE WHEN row_ok AND NOT placed AND id IS NULL THEN
  CASE WHEN com IS NOT NULL OR dep IS NOT NULL THEN 'INVALID_ATTACHMENT_CODE' ELSE 'NO-GEOM' END END AS code
FROM j""",
)
def area_attach(spark, folder):
    key = F.col("c_custkey")
    code = F.concat(F.lit("NATION_"), text(key % 30))
    placed = F.when(key % 6 == 0, point(F.lit(6.5), F.lit(44.85)))
    rows = table(spark, folder, "customer").select(
        F.lit(1).alias("id_load"),
        (key + 1).alias("line_no"),
        (key % 4 != 0).alias("row_ok"),
        placed.alias("geom"),
        placed.alias("the_geom_4326"),
        placed.alias("the_geom_local"),
        F.when(key % 3 == 1, code).alias("src_codecommune"),
        F.when(key % 3 == 2, code).alias("src_codedepartement"),
    )
    fields = {f.name: f for f in DICTIONARY.named(["codecommune", "codedepartement"])}
    attached = attach_areas(rows, nations(spark, folder), fields, crs.LOCAL, F.col("line_no"))
    flagged = with_issues(attached, attachment_checks(fields, str))
    return flagged.select(
        "line_no", text("id_area_attachment").alias("area"), F.get("issues", F.lit(0))["code"].alias("code")
    )


@query(
    "areas_of_points",
    f"""WITH {_BOARD} SELECT c_custkey, string_agg(CAST(id AS VARCHAR), ',') AS areas
FROM c LEFT JOIN x0 ON n_regionkey <> 4 AND c.x > x0.x AND c.y > x0.y AND (c.x - x0.x) + (c.y - x0.y) < 10
GROUP BY c_custkey""",
)
def areas_of_points(spark, folder):
    """Triangular areas, so cells on the slanted side need the exact test."""
    region = table(spark, folder, "nation").where("n_regionkey <> 4").select(
        F.col("n_nationkey").alias("id_area")
    )
    shapes = nations(spark, folder, triangle_wkt).join(region, "id_area", "left_semi")
    found = quads.areas_of_points(customers(spark, folder), shapes, 3.0, "x", "y", F.col("c_custkey"))
    ids = F.array_join(F.transform("id_areas", lambda i: i.cast("string")), ",")
    return found.select("c_custkey", F.nullif(ids, F.lit("")).alias("areas"))


def coast_edges(spark, folder):
    """Edges of a coast line with a vertex for every order and of the ground under it, one a row.

    Vertices are sorted into runs, each of which is drawn on its own; its last vertex leads to the first of the next.
    """
    height = (100 + F.col("o_custkey") % 29).cast("double")
    vertices_ = table(spark, folder, "orders").select(F.col("o_orderkey").cast("double").alias("x"), height.alias("y"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = written(vertices_.repartitionByRange(tasks, "x", "y").select(F.struct("x", "y").alias("v"), F.spark_partition_id().alias("run")), "coast")
    ends = runs.groupBy("run").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    # one line for each run
    ends = written(ends.withColumn("after", F.lead("first").over(Window.orderBy("run"))), "runs")
    drawn = runs.withColumn("to", F.lead("v").over(Window.partitionBy("run").orderBy("v")))
    drawn = drawn.join(F.broadcast(ends.select("run", "after")), "run").select("v", F.coalesce("to", "after").alias("to"))
    whole = ends.agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first is not null")

    def ground(x):
        return F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))

    zero, under = ground(F.lit(0)), ground(F.col("last.x"))
    closing = F.array(*[F.struct(a.alias("v"), b.alias("to")) for a, b in ((zero, F.col("first")), (F.col("last"), under), (under, zero))])
    edges = drawn.where(F.col("to").isNotNull()).unionByName(whole.select(F.inline(closing)))
    return edges.select(F.lit(COAST).alias("id_area"), *[F.col(f"{p}.{c}").alias(f"{c}{i}") for i, p in enumerate(("v", "to")) for c in "xy"])


@query(
    "coast_of_points",
    """WITH h AS (SELECT o_orderkey AS i, 100 + o_custkey % 29 AS y FROM orders), n AS (SELECT max(i) AS last FROM h),
p AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 37 + l_linenumber) % last + 0.5 AS x, l_partkey % 160 + 0.25 AS y
  FROM lineitem, n),
s AS (SELECT n_nationkey AS id, n_nationkey * 50 + 3 AS x, n_nationkey * 5 + 20 AS y FROM nation)
SELECT l_orderkey, l_linenumber, p.y < (a.y + b.y) / 2.0 AS ashore, CAST(s.id AS VARCHAR) AS square
FROM p JOIN h a ON a.i = floor(p.x) JOIN h b ON b.i = floor(p.x) + 1
LEFT JOIN s ON p.x > s.x AND p.x < s.x + 12 AND p.y > s.y AND p.y < s.y + 4""",
)
def coast_of_points(spark, folder):
    """A coast line with a vertex for every order, beside small squares: only the cells along it grow small."""
    last = table(spark, folder, "orders").agg(F.max("o_orderkey")).scalar()
    n = F.col("n_nationkey")
    boxes = table(spark, folder, "nation").select(
        n.cast("int").alias("id_area"), parse_wkt(rectangle_wkt(n * 50 + 3, n * 5 + 20, 12, 4)).alias("geom")
    )
    points = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        ((F.col("l_orderkey") * 37 + F.col("l_linenumber")) % last + 0.5).cast("double").alias("x"),
        (F.col("l_partkey") % 160 + 0.25).cast("double").alias("y"),
    )
    cells = quads.edge_cells(coast_edges(spark, folder), 1.0).unionByName(quads.quad_cells(boxes, 1.0))
    found = quads.areas_of_points(points, boxes, 1.0, "x", "y", F.col("l_linenumber"), cells=cells)
    squares = F.filter("id_areas", lambda i: i != COAST)
    return found.select(
        "l_orderkey", "l_linenumber", F.array_contains("id_areas", COAST).alias("ashore"), text(F.get(squares, F.lit(0))).alias("square")
    )


@query(
    "area_restriction",
    f"""WITH {_BOARD}, a AS (SELECT x AS ax, y AS ay FROM x0 WHERE id = 7)
SELECT c_custkey, NOT (x >= ax AND y >= ay AND (x - ax) + (y - ay) <= 10) AS point_out,
  NOT (x + 1 >= ax AND y + 1 >= ay AND greatest(x - ax, 0) + greatest(y - ay, 0) <= 10) AS square_out
FROM c, a""",
)
def area_restriction(spark, folder):
    area = nations(spark, folder, triangle_wkt).where("id_area = 7").select("id_area", "geom")
    outline = Outline.of(area)
    rows = outline.holding(customers(spark, folder), "x", "y", F.col("c_custkey"))
    shaped = written(rows.withColumn("g", parse_wkt(square_wkt(F.col("x"), F.col("y"), 1))), "squares")
    near = shapes_meeting(shaped, ["c_custkey"], outline, "g").withColumn("near", F.lit(True))
    return shaped.join(near, "c_custkey", "left").select(
        "c_custkey", (F.size("id_areas") == 0).alias("point_out"), F.col("near").isNull().alias("square_out")
    )


_E2 = repr(crs._E)
_T = f"tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E2} * sin(radians(lat))) / (1 + {_E2} * sin(radians(lat))), {_E2} / 2)"


@query(
    "reproject_roundtrip",
    f"""WITH c AS (SELECT c_custkey, -5 + (c_custkey % 150) / 10.0 AS lon, 41.5 + (c_custkey % 97) / 10.0 AS lat
  FROM customer),
t AS (SELECT *, {repr(crs._SEMI_MAJOR * crs._F)} * pow({_T}, {repr(crs._N)}) AS r,
  {repr(crs._N)} * radians(lon - 3) AS theta FROM c)
SELECT c_custkey, round(700000 + r * sin(theta), 2) AS x,
  round({repr(6600000.0 + crs._R0)} - r * cos(theta), 2) AS y, true AS back FROM t""",
)
def reproject_roundtrip(spark, folder):
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key, (F.lit(-5) + (key % 150) / 10.0).alias("lon"), (F.lit(41.5) + (key % 97) / 10.0).alias("lat")
    )
    local = crs.reproject(point(F.col("lon"), F.col("lat")), crs.GEOGRAPHIC, crs.LOCAL)
    moved = rows.withColumn("g", local)
    again = moved.withColumn("b", crs.reproject(F.col("g"), crs.LOCAL, crs.GEOGRAPHIC))
    here, there = first_vertex(F.col("g")), first_vertex(F.col("b"))
    close = (F.abs(there["x"] - F.col("lon")) < 1e-9) & (F.abs(there["y"] - F.col("lat")) < 1e-9)
    return again.select(
        key, F.round(here["x"], 2).alias("x"), F.round(here["y"], 2).alias("y"), close.alias("back")
    )


# the projection written out from its published parameters, in SQL alone
_CONIC = """p AS (SELECT 6378137.0 AS a, sqrt(2 / 298.257222101 - pow(1 / 298.257222101, 2)) AS e, radians(44) AS p1,
  radians(49) AS p2, radians(46.5) AS p0),
q AS (SELECT *, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2,
  tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1,
  tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2,
  tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0 FROM p),
z AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM q),
w AS (SELECT *, m1 / (n * pow(t1, n)) AS f, a * m1 / (n * pow(t1, n)) * pow(t0, n) AS r0 FROM z)"""


def _nearer(i):
    """One round of the latitude of a conformal one."""
    return (
        f"l{i} AS (SELECT * EXCLUDE (phi), pi() / 2 - 2 * atan(t * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2)) AS phi"
        f" FROM l{i - 1})"
    )


@query(
    "geometry_fill",
    f"""WITH {_CONIC}, c AS (SELECT c_custkey, c_custkey % 2 = 0 AS degrees, -4 + (c_custkey % 130) / 10.0 AS lon,
  42 + (c_custkey % 91) / 10.0 AS lat, 300000.0 + (c_custkey % 150) * 4000 AS x, 6200000.0 + (c_custkey % 97) * 8000 AS y
  FROM customer),
g AS (SELECT c_custkey, a * f * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))),
  e / 2), n) AS r, n * radians(lon - 3) AS th, r0 FROM c, w WHERE degrees),
b AS (SELECT c_custkey, e, n, x, y, r0, pow(sqrt(pow(x - 700000, 2) + pow(r0 + 6600000 - y, 2)) / (a * f), 1 / n) AS t FROM c, w
  WHERE NOT degrees),
l0 AS (SELECT *, pi() / 2 - 2 * atan(t) AS phi FROM b), {", ".join(_nearer(i) for i in range(1, 9))}
SELECT c_custkey, round(700000 + r * sin(th), 2) AS x, round(6600000 + r0 - r * cos(th), 2) AS y FROM g
UNION ALL SELECT c_custkey, round(degrees(atan2(x - 700000, r0 + 6600000 - y)) / n + 3, 7), round(degrees(phi), 7) FROM l8""",
)
def geometry_fill(spark, folder):
    """A load in either system gets its geometry in the other one too."""
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer")
    degrees = rows.where(key % 2 == 0).select(
        key, point((F.lit(-4) + (key % 130) / 10.0).cast("double"), (F.lit(42) + (key % 91) / 10.0).cast("double")).alias("geom")
    )
    metres = rows.where(key % 2 != 0).select(
        key, point((300000 + key % 150 * 4000).cast("double"), (6200000 + key % 97 * 8000).cast("double")).alias("geom")
    )
    there = first_vertex(F.col("the_geom_local"))
    filled = both_systems(degrees, crs.GEOGRAPHIC, crs.LOCAL).select(
        key, F.round(there["x"], 2).alias("x"), F.round(there["y"], 2).alias("y")
    )
    here = first_vertex(F.col("the_geom_4326"))
    back = both_systems(metres, crs.LOCAL, crs.LOCAL).select(
        key, F.round(here["x"], 7).alias("x"), F.round(here["y"], 7).alias("y")
    )
    return filled.unionByName(back)


@query(
    "reproject_utm",
    """WITH p AS (SELECT 1 / (2 * 298.257223563 - 1) AS n, 0.9996 * 6378137.0 AS s),
q AS (SELECT *, s / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS a, 2 * sqrt(n) / (1 + n) AS k,
  n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2,
  61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4 FROM p),
c AS (SELECT c_custkey, c_custkey % 2 = 1 AS south, CASE WHEN c_custkey % 2 = 1 THEN 57 ELSE 3 END AS l0,
  CASE WHEN c_custkey % 2 = 1 THEN 57 ELSE 3 END + (c_custkey % 59 - 29) / 10.0 AS lon,
  CASE WHEN c_custkey % 2 = 1 THEN -79 + c_custkey % 79 ELSE c_custkey % 84 END + 0.5 AS lat FROM customer),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - k * atanh(k * sin(radians(lat)))) AS t, radians(lon - l0) AS d FROM c, q),
u AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)
SELECT c_custkey,
  round(500000 + a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)
    + a4 * cos(8 * xi) * sinh(8 * eta)), 2) AS x,
  round(CASE WHEN south THEN 10000000 ELSE 0 END + a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta)
    + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 2) AS y,
  round(6378137.0 * radians(lon), 2) AS web_x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS web_y, true AS back
FROM u""",
)
def reproject_utm(spark, folder):
    """Positions in zones of either half of the earth and in the system of web maps, there and back."""
    key = F.col("c_custkey")
    parts = []
    for odd, srid, meridian in ((0, 32631, 3), (1, 32740, 57)):
        lat = (key % 79 - 79 if odd else key % 84) + 0.5
        rows = table(spark, folder, "customer").where(key % 2 == odd).select(
            key, point((meridian + (key % 59 - 29) / 10.0).cast("double"), lat.cast("double")).alias("g")
        )
        moved = rows.select(
            key, "g", crs.reproject(F.col("g"), crs.GEOGRAPHIC, srid).alias("z"), crs.reproject(F.col("g"), crs.GEOGRAPHIC, crs.WEB).alias("w")
        )
        # through the web system and back into degrees
        again = moved.withColumn("v", crs.reproject(F.col("z"), srid, crs.WEB))
        again = again.withColumn("b", crs.reproject(F.col("v"), crs.WEB, crs.GEOGRAPHIC))
        g, z, w, b = (first_vertex(F.col(c)) for c in "gzwb")
        parts.append(
            again.select(
                key, F.round(z["x"], 2).alias("x"), F.round(z["y"], 2).alias("y"), F.round(w["x"], 2).alias("web_x"),
                F.round(w["y"], 2).alias("web_y"),
                ((F.abs(g["x"] - b["x"]) < 1e-9) & (F.abs(g["y"] - b["y"]) < 1e-9)).alias("back"),
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "extent",
    """WITH c AS (SELECT c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 180 END AS x,
  CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 90 END AS y FROM customer)
SELECT c_nationkey, 'POLYGON((' || concat_ws(',', min(x) || ' ' || min(y), min(x) || ' ' || max(y) + 2,
  max(x) + 2 || ' ' || max(y) + 2, max(x) + 2 || ' ' || min(y), min(x) || ' ' || min(y)) || '))' AS bbox
FROM c GROUP BY c_nationkey""",
)
def extents(spark, folder):
    key = F.col("c_custkey")
    placed = F.when(key % 4 != 0, square_wkt(key % 180, key % 90, 2))
    rows = table(spark, folder, "customer").select("c_nationkey", parse_wkt(placed).alias("g"))
    return extent(rows, "g", ["c_nationkey"]).select("c_nationkey", "bbox")


# a grid of unit cells, one per part
_GRID = "grid AS (SELECT p_partkey % 50 AS cx, p_partkey // 50 AS cy, p_size * 10 AS alt FROM part)"


def grid(spark, folder):
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        (key % 50).alias("cx"), F.floor(key / 50).alias("cy"), (F.col("p_size") * 10).alias("alt")
    )


@query(
    "elevation_fill",
    f"""WITH {_BOARD}, {_GRID}, r AS (SELECT c_custkey, x, y, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '5' END AS s0,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '99' END AS s1 FROM c)
SELECT c_custkey, CAST(CASE WHEN s0 = '' THEN alt ELSE 5 END AS VARCHAR) AS altitude_min,
  CAST(CASE WHEN s1 IS NULL THEN alt ELSE 99 END AS VARCHAR) AS altitude_max
FROM r LEFT JOIN grid ON cx = floor(x) AND cy = floor(y)""",
)
def elevation_fill(spark, folder):
    key = F.col("c_custkey")
    rows = customers(spark, folder).withColumns(
        {
            "src_min": F.when(key % 3 == 0, "").otherwise("5"),
            "src_max": F.when(key % 4 != 0, "99"),
            "altitude_min": F.when(key % 3 != 0, 5),
            "altitude_max": F.when(key % 4 != 0, 99),
            "g": point(F.col("x"), F.col("y")),
            "has_position": F.lit(True),
        }
    )
    looked = with_altitudes(rows, "g", grid(spark, folder), 1.0, F.lit(True), key)
    filled = filled_altitudes(looked, {"altitude_min": "src_min", "altitude_max": "src_max"})
    return filled.select(
        key, text("altitude_min").alias("altitude_min"), text("altitude_max").alias("altitude_max")
    )


@query(
    "elevation_shapes",
    f"""WITH {_BOARD}, {_GRID} SELECT c_custkey, CAST(min(alt) AS VARCHAR) AS alt_low,
  CAST(max(alt) AS VARCHAR) AS alt_high
FROM c LEFT JOIN grid ON cx <= x + 2 AND cx + 1 >= x AND cy <= y + 2 AND cy + 1 >= y GROUP BY c_custkey""",
)
def elevation_shapes(spark, folder):
    rows = customers(spark, folder).withColumn("g", parse_wkt(square_wkt(F.col("x"), F.col("y"), 2)))
    # parsed once and written, as the row stage of a load does
    rows = written(rows, "shapes")
    looked = with_altitudes(rows, "g", grid(spark, folder), 1.0, F.lit(True), F.col("c_custkey"))
    return looked.select("c_custkey", text("alt_low").alias("alt_low"), text("alt_high").alias("alt_high"))


# towns of a hundred columns and rows of a fine grid, triangles so that no border follows it
_TOWNS = """towns AS (SELECT n_nationkey AS id, n_name, (n_nationkey % 5) * 110 + 0.25 AS x, (n_nationkey // 5) * 240 + 0.75 AS y
  FROM nation), fine AS (SELECT o_orderkey % 600 AS cx, o_orderkey // 600 AS cy, min(o_custkey) AS alt FROM orders GROUP BY ALL)"""


@query(
    "attached_area_altitudes",
    f"""WITH {_TOWNS}, under AS (SELECT id, n_name, min(alt) AS low, max(alt) AS high FROM towns
  LEFT JOIN fine ON cx <= x + 230 AND cx + 1 >= x AND cy <= y + 230 AND cy + 1 >= y
    AND greatest(cx - x, 0) + greatest(cy - y, 0) <= 230 GROUP BY ALL)
SELECT c_custkey, CAST(id AS VARCHAR) AS area, CAST(low AS VARCHAR) AS alt_low, CAST(high AS VARCHAR) AS alt_high
FROM customer LEFT JOIN under ON n_name = 'NATION_' || (c_custkey % 30)""",
)
def attached_area_altitudes(spark, folder):
    """Rows that only name an area get the altitudes under its shape, tens of thousands of cells each."""
    n, key, order = F.col("n_nationkey"), F.col("c_custkey"), F.col("o_orderkey")
    shape = triangle_wkt((n % 5) * 110 + 0.25, F.floor(n / 5) * 240 + 0.75, 230)
    towns = table(spark, folder, "nation").select(
        n.alias("id_area"), F.lit("COM").alias("type"), F.col("n_name").alias("code"), parse_wkt(shape).alias("geom")
    )
    fine = table(spark, folder, "orders").select(
        (order % 600).alias("cx"), F.floor(order / 600).alias("cy"), F.col("o_custkey").alias("alt")
    )
    nowhere = F.lit(None).cast(GEOMETRY)
    rows = table(spark, folder, "customer").select(
        key, key.alias("line_no"), F.lit(True).alias("row_ok"), nowhere.alias("geom"),
        nowhere.alias("the_geom_4326"), nowhere.alias("the_geom_local"),
        F.concat(F.lit("NATION_"), text(key % 30)).alias("src_codecommune"),
    )
    fields = {f.name: f for f in DICTIONARY.named(["codecommune"])}
    attached = attach_areas(rows, towns, fields, crs.LOCAL, key, settle=True)
    shapes = towns.select(F.concat(F.lit(AREA_KEY), "id_area").alias("geo_key"), "geom")
    named = F.concat(F.lit(AREA_KEY), "id_area_attachment")
    looked = with_altitudes(
        attached, "the_geom_local", fine, 1.0, F.lit(True), key, settle=True, areas=shapes, area=named
    )
    return looked.select(
        key, text("id_area_attachment").alias("area"), text("alt_low").alias("alt_low"), text("alt_high").alias("alt_high")
    )


@query(
    "geometry_text",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'POINT (' || c_custkey % 180 || ' 1.5)'
  ELSE 'LINESTRING (0 0, ' || c_custkey % 180 || ' 2)' END AS wkt FROM customer""",
)
def geometry_text(spark, folder):
    key = F.col("c_custkey")
    made = case(
        key,
        2,
        F.concat(F.lit("point( "), text(key % 180), F.lit("  1.50 )")),
        F.concat(F.lit("LineString(0 0,"), text(key % 180), F.lit(" 2)")),
    )
    rows = table(spark, folder, "customer").select(key, parse_wkt(made).alias("g"))
    return rows.select(key, to_wkt(F.col("g")).alias("wkt"))
