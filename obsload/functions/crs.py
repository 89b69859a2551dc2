"""Coordinate systems: WGS 84 longitude/latitude, the local conic projection, zones of the transverse Mercator
projection and the Mercator projection of web maps.

All are closed-form column expressions in both directions: the Lambert conformal conic projection with two standard
parallels on the GRS 80 ellipsoid, and the transverse Mercator projection by Krüger's series to the fourth power of
the third flattening, exact to well under a millimetre inside a zone. Longitudes and latitudes on WGS 84, ETRS 89 and
the systems derived from it count as the same, which they are to within a metre.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsload.functions.binding import let
from obsload.functions.geometry import map_vertices

GEOGRAPHIC = 4326
LOCAL = 2154

# Published parameters of EPSG:2154 and of the GRS 80 ellipsoid.
_SEMI_MAJOR = 6378137.0
_FLATTENING = 1 / 298.257222101
_PARALLELS = (44.0, 49.0)
_ORIGIN = (3.0, 46.5)
_FALSE = (700000.0, 6600000.0)

# Published areas of use (west, south, east, north), in degrees but for the web system.
AREA_OF_USE = {
    GEOGRAPHIC: (-180.0, -90.0, 180.0, 90.0),
    LOCAL: (-9.86, 41.15, 10.38, 51.56),
    3857: (-20037508.342789, -20048966.104015, 20037508.342789, 20048966.104015),
}

_E = math.sqrt(2 * _FLATTENING - _FLATTENING**2)


def _iso(phi: float) -> float:
    """Conformal ratio t of a latitude in radians."""
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _scale(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


_P1, _P2 = (math.radians(p) for p in _PARALLELS)
_N = math.log(_scale(_P1) / _scale(_P2)) / math.log(_iso(_P1) / _iso(_P2))
_F = _scale(_P1) / (_N * _iso(_P1) ** _N)
_R0 = _SEMI_MAJOR * _F * _iso(math.radians(_ORIGIN[1])) ** _N


def local_corner(lon: float, lat: float) -> tuple[float, float]:
    """One position projected on the driver (corners of the area of use)."""
    r = _SEMI_MAJOR * _F * _iso(math.radians(lat)) ** _N
    theta = _N * math.radians(lon - _ORIGIN[0])
    return _FALSE[0] + r * math.sin(theta), _FALSE[1] + _R0 - r * math.cos(theta)


def to_local(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    s = F.lit(_E) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    r = F.lit(_SEMI_MAJOR * _F) * F.pow(t, F.lit(_N))
    theta = F.lit(_N) * F.radians(lon - _ORIGIN[0])
    return F.lit(_FALSE[0]) + r * F.sin(theta), F.lit(_FALSE[1] + _R0) - r * F.cos(theta)


def to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    dx = x - _FALSE[0]
    dy = F.lit(_R0 + _FALSE[1]) - y
    r = F.sqrt(dx * dx + dy * dy)
    t = F.pow(r / F.lit(_SEMI_MAJOR * _F), F.lit(1 / _N))
    lon = F.degrees(F.atan2(dx, dy)) / F.lit(_N) + _ORIGIN[0]
    half = F.lit(math.pi / 2)
    # the latitude series in closed form: Fourier coefficients of the conformal latitude
    chi = half - 2 * F.atan(t)
    lat = chi
    for k, c in enumerate(_latitude_series(), start=1):
        lat = lat + F.lit(c) * F.sin(2 * k * chi)
    return lon, F.degrees(lat)


def _latitude_series() -> tuple[float, ...]:
    """Coefficients turning conformal into geographic latitude, powers of e up to the eighth."""
    e2 = _E**2
    e4, e6, e8 = e2**2, e2**3, e2**4
    return (
        e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360,
        7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520,
        7 * e6 / 120 + 81 * e8 / 1120,
        4279 * e8 / 161280,
    )


# Published parameters of the transverse Mercator zones.
WEB = 3857
_SCALE = 0.9996
_FALSE_EAST = 500000.0
_FALSE_NORTH_OF_SOUTH = 10000000.0
_WGS_FLATTENING = 1 / 298.257223563
_OVERSEAS = {5490: (20, False), 2972: (22, False), 2975: (40, True), 4471: (38, True)}


def _once(m, body: Callable, *values):
    """``body`` of values that are computed once each, be they columns or numbers."""
    if m is not F:
        return body(*values)
    names = [f"v{i}" for i in range(len(values))]
    held = F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    return let(held, lambda s: body(*[s[n] for n in names]))


@dataclass(frozen=True)
class Zone:
    """A zone of the transverse Mercator projection, six degrees wide."""

    meridian: float
    south: bool
    flattening: float

    @property
    def false_north(self) -> float:
        return _FALSE_NORTH_OF_SOUTH if self.south else 0.0

    @property
    def third(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        """Of the circle with the length of a meridian, scaled."""
        n = self.third
        return _SCALE * _SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def forward(self) -> tuple[float, ...]:
        n = self.third
        return (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )

    def backward(self) -> tuple[float, ...]:
        n = self.third
        return (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )

    def latitudes(self) -> tuple[float, ...]:
        n = self.third
        return (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )

    def project(self, lon, lat, m=F) -> tuple:
        """East and north of a position; ``m`` has the functions, of columns or of numbers."""
        k = 2 * math.sqrt(self.third) / (1 + self.third)
        t = _once(m, lambda sine: m.sinh(m.atanh(sine) - k * m.atanh(k * sine)), m.sin(m.radians(lat)))
        turn = m.radians(lon - self.meridian)

        def plane(body: Callable) -> Column | float:
            """``body`` of the position on the sphere that keeps the meridian's scale."""
            return _once(
                m, lambda t, d: _once(m, body, m.atan2(t, m.cos(d)), m.atanh(m.sin(d) / m.sqrt(1 + t * t))), t, turn
            )

        def series(start, circular, hyperbolic, xi, eta):
            for j, a in enumerate(self.forward(), start=1):
                start = start + a * circular(2 * j * xi) * hyperbolic(2 * j * eta)
            return start

        east = plane(lambda xi, eta: _FALSE_EAST + self.radius * series(eta, m.cos, m.sinh, xi, eta))
        north = plane(lambda xi, eta: self.false_north + self.radius * series(xi, m.sin, m.cosh, xi, eta))
        return east, north

    def position(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a projected position."""

        def sphere(body: Callable) -> Column:
            def turned(xi, eta):
                up, over = xi, eta
                for j, b in enumerate(self.backward(), start=1):
                    up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
                    over = over - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
                return _once(F, body, up, over)

            return _once(F, turned, (y - self.false_north) / self.radius, (x - _FALSE_EAST) / self.radius)

        def latitude(chi):
            lat = chi
            for j, d in enumerate(self.latitudes(), start=1):
                lat = lat + d * F.sin(2 * j * chi)
            return F.degrees(lat)

        lon = sphere(lambda up, over: F.degrees(F.atan2(F.sinh(over), F.cos(up))) + self.meridian)
        return lon, sphere(lambda up, over: _once(F, latitude, F.asin(F.sin(up) / F.cosh(over))))

    def outline(self) -> list[tuple[float, float]]:
        """Corners of the zone, counter-clockwise; its sides bend, so they have corners of their own."""
        far = [-80.0, 0.0] if self.south else [0.0, 84.0]
        lats = [far[0] + (far[1] - far[0]) * i / 12 for i in range(13)]
        right = [self.project(self.meridian + 3, lat, math) for lat in lats]
        left = [self.project(self.meridian - 3, lat, math) for lat in reversed(lats)]
        return right + left


def zone_of(srid: int) -> Zone | None:
    """The zone a code stands for: those of WGS 84, of ETRS 89, and of the overseas systems derived from it."""
    if srid in _OVERSEAS:
        number, south = _OVERSEAS[srid]
        return Zone(number * 6 - 183, south, _FLATTENING)
    if 25828 <= srid <= 25838:
        return Zone((srid - 25800) * 6 - 183, False, _FLATTENING)
    if 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        return Zone((srid % 100) * 6 - 183, srid >= 32700, _WGS_FLATTENING)
    return None


def to_web(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _SEMI_MAJOR, F.lit(_SEMI_MAJOR) * F.asinh(F.tan(F.radians(lat)))


def from_web(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _SEMI_MAJOR), F.degrees(F.atan(F.sinh(y / _SEMI_MAJOR)))


Move = Callable[[Column, Column], tuple[Column, Column]]


def _moves(srid: int) -> tuple[Move, Move]:
    """From longitude and latitude to a system, and back."""
    if srid == GEOGRAPHIC:
        return (lambda lon, lat: (lon, lat)), (lambda x, y: (x, y))
    if srid == LOCAL:
        return to_local, to_geographic
    if srid == WEB:
        return to_web, from_web
    zone = zone_of(srid)
    if zone is None:
        raise ValueError(f"the system {srid} is not known")
    return zone.project, zone.position


def reproject(geometry: Column, source: int, target: int) -> Column:
    """Geometry moved from one known system to another, by way of longitude and latitude."""
    if source == target:
        return geometry
    (there, _), (_, back) = _moves(target), _moves(source)
    if GEOGRAPHIC in (source, target):
        return map_vertices(geometry, there if source == GEOGRAPHIC else back)
    return map_vertices(map_vertices(geometry, back), there)


def area_of_use(srid: int) -> list[tuple[float, float]]:
    """Corners of the system's area of use in its own units, counter-clockwise."""
    zone = zone_of(srid)
    if zone is not None:
        return zone.outline()
    if srid not in AREA_OF_USE:
        raise ValueError(f"the system {srid} is not known")
    west, south, east, north = AREA_OF_USE[srid]
    corners = [(west, south), (east, south), (east, north), (west, north)]
    return [local_corner(*c) for c in corners] if srid == LOCAL else corners
