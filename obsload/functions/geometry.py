"""Geometry columns: WKT text to a nested structure, and measures over it.

A geometry is ``STRUCT<kind, parts>``; ``parts`` nests part > ring > vertex, so every kind shares
one shape (a point is one part of one ring of one vertex, holes are the rings after the first). A
collection has the parts of all its members, nested ones included, and a letter for each part after
its kind: ``P``, ``L`` or ``A``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsload.functions.binding import let

VERTEX = "struct<x:double,y:double>"
PARTS = f"array<array<array<{VERTEX}>>>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"

_TAGGED = (
    r"(?is)^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION)"
    r"\s*(?:ZM|Z|M)?\s*(EMPTY|\(.*\))\s*$"
)
_PLAIN_POINT = (
    r"(?i)^\s*POINT\s*\(\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:E[+-]?\d+)?)"
    r"\s+([+-]?(?:\d+\.?\d*|\.\d+)(?:E[+-]?\d+)?)\s*\)\s*$"
)
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def _inside(text: Column, depth: int) -> Column:
    """Text stripped of ``depth`` parentheses on both ends; null when they are not there."""
    stripped = F.expr("null")
    wanted = text.startswith("(" * depth) & text.endswith(")" * depth)
    return F.when(wanted, F.substr(text, F.lit(depth + 1), F.char_length(text) - 2 * depth)).otherwise(
        stripped.cast("string")
    )


def _vertex(text: Column) -> Column:
    numbers = F.split(F.trim(text), " +")
    sound = F.size(numbers).between(2, 4) & F.forall(numbers, lambda n: n.rlike(_NUMBER))
    return F.when(
        sound,
        F.struct(
            F.get(numbers, F.lit(0)).try_cast("double").alias("x"),
            F.get(numbers, F.lit(1)).try_cast("double").alias("y"),
        ),
    )


def point(x: Column, y: Column) -> Column:
    """Point geometry, null when a coordinate is."""
    vertex = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    made = F.struct(F.lit("POINT").alias("kind"), F.array(F.array(F.array(vertex))).alias("parts"))
    return F.when(x.isNotNull() & y.isNotNull(), made.cast(GEOMETRY))


def parse_wkt(text: Column) -> Column:
    """Geometry of a WKT cell; null when the text is not WKT, a ring is open or a line too short.

    Rings are cut with ``split`` instead of one validating regex: repeated regex groups recurse in
    the JVM and a polygon of some thousand vertices would overflow the stack.
    """
    x = F.regexp_extract(text, _PLAIN_POINT, 1)
    simple = point(x.try_cast("double"), F.regexp_extract(text, _PLAIN_POINT, 2).try_cast("double"))
    tagged = F.struct(
        F.upper(F.regexp_extract(text, _TAGGED, 1)).alias("kind"),
        F.regexp_replace(
            F.regexp_replace(F.regexp_extract(text, _TAGGED, 2), r"\s+", " "), r" ?([(),]) ?", "$1"
        ).alias("body"),
    )
    # plain points and empty cells, nearly all of a load, never enter the interpreted part
    return F.when(x != "", simple).when(text.isNotNull(), let(tagged, _read))


COLLECTION = "GEOMETRYCOLLECTION"
_LETTERS = {"P": ["POINT", "MULTIPOINT"], "L": ["LINESTRING", "MULTILINESTRING"], "A": ["POLYGON", "MULTIPOLYGON"]}
_WHOLE = {"P": "MULTIPOINT", "L": "MULTILINESTRING", "A": "MULTIPOLYGON"}


def _read(tagged: Column) -> Column:
    return F.when(tagged["kind"] == COLLECTION, _collected(tagged["body"])).otherwise(_shaped(tagged))


def _collected(body: Column) -> Column:
    """Geometry of the tidied body of a collection, of any depth.

    The text is a stream of members between commas, each after the brackets that open collections and before those
    that close them. Depth is folded over the stream: it may come to nought at the end only.
    """
    opening = rf"(?i)^((?:{COLLECTION}(?: ?(?:ZM|Z|M))?\()*)(.*)$"
    pieces = F.split(F.concat(F.lit(COLLECTION), body), r",(?=[A-Za-z])")

    def count(text: Column, letter: str) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit(letter), F.lit("")))

    def token(piece: Column) -> Column:
        rest = F.regexp_extract(piece, opening, 2)
        closes = count(rest, ")") - count(rest, "(")
        text = F.substr(rest, F.lit(1), F.char_length(rest) - F.greatest(closes, F.lit(0)))
        member = F.struct(
            F.upper(F.regexp_extract(text, _MEMBER, 1)).alias("kind"), F.regexp_extract(text, _MEMBER, 2).alias("body")
        )
        return F.struct(
            count(F.regexp_extract(piece, opening, 1), "(").alias("opens"), closes.alias("closes"),
            F.endswith(rest, F.repeat(F.lit(")"), F.greatest(closes, F.lit(0)))).alias("ends"), member.alias("member"),
        )

    def judged(tokens: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("sound"), F.lit(True).alias("first"))
        folded = F.aggregate(
            tokens, start,
            lambda s, t: F.struct(
                (s["depth"] + t["opens"] - t["closes"]).alias("depth"),
                (s["sound"] & (s["first"] | (s["depth"] > 0)) & (t["closes"] >= 0) & t["ends"]).alias("sound"),
                F.lit(False).alias("first"),
            ),
        )
        members = F.transform(tokens, lambda t: F.when(
            (t["member"]["kind"] == COLLECTION) & (F.upper(t["member"]["body"]) == "EMPTY"), _no_part(F.lit(COLLECTION))
        ).otherwise(_shaped(t["member"])))
        return let(F.struct(folded.alias("state"), members.alias("members")), _united)

    return F.when(F.upper(body) == "EMPTY", _no_part(F.lit(COLLECTION))).otherwise(let(F.transform(pieces, token), judged))


_MEMBER = r"(?i)^(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION) ?(?:ZM|Z|M)? ?(EMPTY|\(.*\))$"


def _no_part(kind: Column) -> Column:
    return F.struct(kind.alias("kind"), F.array().cast(PARTS).alias("parts")).cast(GEOMETRY)


def _united(read: Column) -> Column:
    members, state = read["members"], read["state"]
    letter = lambda m: reduce(
        lambda other, k: F.when(m["kind"].isin(*_LETTERS[k]), k).otherwise(other), _LETTERS, F.lit("")
    )
    letters = F.array_join(F.transform(members, lambda m: F.repeat(letter(m), F.size(m["parts"]))), "")
    kind = F.concat_ws(" ", F.lit(COLLECTION), F.nullif(letters, F.lit("")))
    made = F.struct(kind.alias("kind"), F.flatten(F.transform(members, lambda m: m["parts"])).alias("parts")).cast(GEOMETRY)
    sound = state["sound"] & (state["depth"] == 0) & F.forall(members, lambda m: m.isNotNull())
    return F.when(sound, made)


def is_collection(geometry: Column) -> Column:
    return F.startswith(geometry["kind"], F.lit(COLLECTION))


def _letters_of(geometry: Column) -> Column:
    return F.regexp_extract(geometry["kind"], f"^{COLLECTION} ([PLA]+)$", 1)


def members(geometry: Column) -> Column:
    """Geometries of one kind that make up a geometry: a collection's parts by kind, any other as it is."""

    def lettered(g: Column, letter: str) -> Column:
        parts = F.filter(g["parts"], lambda _, i: F.substr(_letters_of(g), i + 1, F.lit(1)) == letter)
        return F.struct(F.lit(_WHOLE[letter]).alias("kind"), parts.alias("parts")).cast(GEOMETRY)

    def of(g: Column) -> Column:
        kept = [lettered(g, letter) for letter in _LETTERS]
        return F.when(is_collection(g), F.filter(F.array(*kept), lambda m: F.size(m["parts"]) > 0)).otherwise(F.array(g))

    return let(geometry, of)


def _shaped(tagged: Column) -> Column:
    """Geometry of a keyword and its tidied body."""
    kind, body = tagged["kind"], tagged["body"]
    empty = F.upper(body) == "EMPTY"
    single = F.array(F.array(_inside(body, 1)))
    rings = F.split(_inside(body, 2), r"\),\(")
    ring_texts = (
        F.when(kind.isin("POINT", "LINESTRING"), single)
        .when(kind == "POLYGON", F.array(rings))
        .when(kind == "MULTILINESTRING", F.transform(rings, lambda r: F.array(r)))
        .when(
            kind == "MULTIPOINT",
            F.transform(
                F.when(body.startswith("(("), rings).otherwise(F.split(_inside(body, 1), ",")),
                lambda r: F.array(r),
            ),
        )
        .when(
            kind == "MULTIPOLYGON",
            F.transform(
                F.split(_inside(body, 3), r"\)\),\(\("), lambda part: F.split(part, r"\),\(")
            ),
        )
    )
    parts = F.transform(
        ring_texts,
        lambda part: F.transform(part, lambda ring: F.transform(F.split(ring, ","), _vertex)),
    )
    return let(F.struct(kind.alias("kind"), parts.alias("parts"), empty.alias("empty")), _sound)


def _sound(read: Column) -> Column:
    """The read geometry when its rings and lines are complete."""
    kind, parts, empty = read["kind"], read["parts"], read["empty"]
    areal = kind.isin("POLYGON", "MULTIPOLYGON")
    linear = kind.isin("LINESTRING", "MULTILINESTRING")

    def sound_ring(ring: Column) -> Column:
        complete = F.forall(ring, lambda v: v.isNotNull())
        size = F.size(ring)
        closed = (F.get(ring, F.lit(0)) == F.get(ring, size - 1)) & (size >= 4)
        return complete & F.when(areal, closed).when(linear, size >= 2).otherwise(size == 1)

    sound = F.coalesce(
        F.forall(parts, lambda part: F.forall(part, sound_ring)), F.lit(False)
    )
    geometry = F.struct(kind.alias("kind"), parts.alias("parts")).cast(GEOMETRY)
    nothing = F.struct(kind.alias("kind"), F.array().cast(PARTS).alias("parts")).cast(GEOMETRY)
    return F.when((kind != "") & empty, nothing).when((kind != "") & sound, geometry)


def rings(geometry: Column) -> Column:
    return F.flatten(geometry["parts"])


def vertices(geometry: Column) -> Column:
    return F.flatten(rings(geometry))


def first_vertex(geometry: Column) -> Column:
    return F.get(F.get(F.get(geometry["parts"], F.lit(0)), F.lit(0)), F.lit(0))


def is_plain_point(geometry: Column) -> Column:
    return (geometry["kind"] == "POINT") & (F.size(geometry["parts"]) == 1)


def is_areal(geometry: Column) -> Column:
    return geometry["kind"].isin("POLYGON", "MULTIPOLYGON")


def map_vertices(geometry: Column, change: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Same geometry with every vertex moved by ``change(x, y)``."""
    head = first_vertex(geometry)
    x, y = change(head["x"], head["y"])
    # plain points and rows without a shape stay in generated code
    return F.when(is_plain_point(geometry), point(x, y)).when(geometry.isNotNull(), let(geometry, lambda g: _moved(g, change)))


def _moved(geometry: Column, change: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    def moved(vertex: Column) -> Column:
        x, y = change(vertex["x"], vertex["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    nested = F.struct(
        geometry["kind"].alias("kind"),
        F.transform(
            geometry["parts"],
            lambda part: F.transform(part, lambda ring: F.transform(ring, moved)),
        ).alias("parts"),
    ).cast(GEOMETRY)
    return F.when(geometry.isNotNull(), nested)


def _segments(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring or line."""
    n = F.size(ring)
    pairs = F.zip_with(
        F.slice(ring, F.lit(1), n - 1),
        F.slice(ring, F.lit(2), n - 1),
        lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")),
    )
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return F.when(n >= 2, pairs).otherwise(none)


def segments(geometry: Column) -> Column:
    return F.flatten(F.transform(rings(geometry), _segments))


def _weighted(items: Column, weight: Callable, at_x: Callable, at_y: Callable) -> Column:
    """Sums of weight, weight*x and weight*y over an array."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"))
    return F.aggregate(
        items,
        zero,
        lambda acc, item: F.struct(
            (acc["w"] + weight(item)).alias("w"),
            (acc["wx"] + weight(item) * at_x(item)).alias("wx"),
            (acc["wy"] + weight(item) * at_y(item)).alias("wy"),
        ),
    )


def centroid(geometry: Column) -> Column:
    """Centre of mass: mean of points, length-weighted for lines, area-weighted for polygons.

    Degenerate polygons fall back to their outline, degenerate lines to their vertices. Sums are
    taken relative to the first vertex to keep digits.
    """
    # of a collection the members of the highest dimension count
    return F.when(is_plain_point(geometry), geometry).when(
        geometry.isNotNull(),
        let(F.element_at(F.when(is_collection(geometry), F.nullif(members(geometry), F.array().cast(f"array<{GEOMETRY}>"))).otherwise(F.array(geometry)), -1), _centre),
    )


def _centre(geometry: Column) -> Column:
    origin = first_vertex(geometry)
    ox, oy = origin["x"], origin["y"]

    def cross(s: Column) -> Column:
        return (s["x0"] - ox) * (s["y1"] - oy) - (s["x1"] - ox) * (s["y0"] - oy)

    def ring_sums(ring: Column) -> Column:
        return _weighted(
            _segments(ring),
            cross,
            lambda s: (s["x0"] + s["x1"] - 2 * ox) / 3,
            lambda s: (s["y0"] + s["y1"] - 2 * oy) / 3,
        )

    # outer rings count positive and holes negative, whatever their drawing direction
    signed = F.flatten(
        F.transform(
            geometry["parts"],
            lambda part: F.transform(
                part,
                lambda ring, i: F.struct(
                    ring_sums(ring).alias("sums"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")
                ),
            ),
        )
    )

    def turn(item: Column) -> Column:
        return item["sign"] * F.signum(item["sums"]["w"])

    area = F.aggregate(
        signed,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy")),
        lambda acc, item: F.struct(
            (acc["w"] + turn(item) * item["sums"]["w"]).alias("w"),
            (acc["wx"] + turn(item) * item["sums"]["wx"]).alias("wx"),
            (acc["wy"] + turn(item) * item["sums"]["wy"]).alias("wy"),
        ),
    )
    length = _weighted(
        segments(geometry),
        lambda s: F.sqrt((s["x1"] - s["x0"]) * (s["x1"] - s["x0"]) + (s["y1"] - s["y0"]) * (s["y1"] - s["y0"])),
        lambda s: (s["x0"] + s["x1"]) / 2 - ox,
        lambda s: (s["y0"] + s["y1"]) / 2 - oy,
    )
    mean = _weighted(vertices(geometry), lambda v: F.lit(1.0), lambda v: v["x"] - ox, lambda v: v["y"] - oy)

    def at(sums: Column) -> Column:
        placed = point(ox + sums["wx"] / sums["w"], oy + sums["wy"] / sums["w"])
        return F.when(sums["w"] > 0, placed)

    kind = geometry["kind"]
    return F.when(
        geometry.isNotNull(),
        F.coalesce(
            F.when(is_areal(geometry), let(area, at)),
            F.when(kind != "MULTIPOINT", let(length, at)),
            let(mean, at),
        ),
    )


def within_convex(geometry: Column, corners: list[tuple[float, float]]) -> Column:
    """True when the geometry lies in a convex polygon and not wholly on its border.

    ``corners`` run counter-clockwise. A point on the border is outside; a line or polygon may
    touch it. Coordinates that are not finite are outside.
    """
    edges = list(zip(corners, corners[1:] + corners[:1], strict=True))

    def sides(x: Column, y: Column) -> list[Column]:
        return [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in edges]

    def every(x: Column, y: Column, strict: bool) -> Column:
        held = F.lit(True)
        for side in sides(x, y):
            held = held & ~F.isnan(side) & ((side > 0) if strict else (side >= 0))
        return held

    def shape_within(g: Column) -> Column:
        covered = F.forall(vertices(g), lambda v: every(v["x"], v["y"], False))
        enters = (
            is_areal(g)
            | F.contains(_letters_of(g), F.lit("A"))
            | F.exists(vertices(g), lambda v: every(v["x"], v["y"], True))
            | F.exists(
                segments(g),
                lambda s: every((s["x0"] + s["x1"]) / 2, (s["y0"] + s["y1"]) / 2, True),
            )
        )
        return F.when(g.isNotNull(), (F.size(g["parts"]) > 0) & covered & enters)

    head = first_vertex(geometry)
    return F.when(is_plain_point(geometry), every(head["x"], head["y"], True)).when(
        geometry.isNotNull(), let(geometry, shape_within)
    )


def in_rings(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test of a position against edges ``array<struct<x0,y0,x1,y1>>``."""

    def crosses(e: Column) -> Column:
        spans = (e["y0"] > y) != (e["y1"] > y)
        at = e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def on_edges(x: Column, y: Column, edges: Column) -> Column:
    """True when a position lies exactly on one of the edges."""

    def touches(e: Column) -> Column:
        flat = (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"]) == 0
        boxed = x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(
            F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])
        )
        return flat & boxed

    return F.exists(edges, touches)


def bounds(geometry: Column) -> Column:
    """Smallest box as ``STRUCT<xmin, ymin, xmax, ymax>``."""
    return let(geometry, _box)


def _box(geometry: Column) -> Column:
    xs = F.transform(vertices(geometry), lambda v: v["x"])
    ys = F.transform(vertices(geometry), lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def _plain(number: Column) -> Column:
    """Shortest text of a double, whole numbers without a decimal part."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def to_wkt(geometry: Column) -> Column:
    """WKT text of a geometry."""
    return let(geometry, _written)


def _written(geometry: Column) -> Column:

    def ring_text(ring: Column) -> Column:
        return F.array_join(F.transform(ring, lambda v: F.concat(_plain(v["x"]), F.lit(" "), _plain(v["y"]))), ", ")

    def wrapped(texts: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(texts, ", "), F.lit(")"))

    def ring_list(ring_array: Column) -> Column:
        return F.transform(ring_array, lambda r: F.concat(F.lit("("), ring_text(r), F.lit(")")))

    kind, parts = geometry["kind"], geometry["parts"]
    head = F.get(parts, F.lit(0))
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), F.concat(F.lit("("), ring_text(F.get(head, F.lit(0))), F.lit(")")))
        .when(kind == "POLYGON", wrapped(ring_list(head)))
        .when(kind == "MULTIPOLYGON", wrapped(F.transform(parts, lambda p: wrapped(ring_list(p)))))
        .otherwise(wrapped(ring_list(F.flatten(parts))))
    )
    letters = _letters_of(geometry)

    def member_text(part: Column, i: Column) -> Column:
        one = F.concat(F.lit("("), ring_text(F.get(part, F.lit(0))), F.lit(")"))
        letter = F.substr(letters, i + 1, F.lit(1))
        return F.when(letter == "P", F.concat(F.lit("POINT "), one)).when(letter == "L", F.concat(F.lit("LINESTRING "), one)).otherwise(
            F.concat(F.lit("POLYGON "), wrapped(ring_list(part)))
        )

    collected = F.concat(F.lit(f"{COLLECTION} "), wrapped(F.transform(parts, member_text)))
    body = F.when(letters != "", collected).otherwise(F.concat(kind, F.lit(" "), body))
    return F.when(F.size(parts) == 0, F.concat(kind, F.lit(" EMPTY"))).when(
        geometry.isNotNull(), body
    )


def box_wkt(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Polygon text of a box, counter-clockwise from its lower left corner upwards."""
    corners = [(xmin, ymin), (xmin, ymax), (xmax, ymax), (xmax, ymin), (xmin, ymin)]
    texts = [F.concat_ws(" ", _plain(x), _plain(y)) for x, y in corners]
    known = xmin.isNotNull() & ymin.isNotNull()
    return F.when(known, F.concat(F.lit("POLYGON(("), F.concat_ws(",", *texts), F.lit("))")))
