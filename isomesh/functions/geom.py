"""Plane geometry as Column expressions over ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def line(*xy: Column | str) -> Column:
    """A line through the given x, y, x, y, ... columns."""
    return F.array(*(point(col(a), col(b)) for a, b in zip(xy[::2], xy[1::2], strict=True)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def segments(points: Column) -> Column:
    """Consecutive pairs of points as array<struct<a, b>>."""
    n = F.size(points)
    return F.transform(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), points[i + 1].alias("b")))


def length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def along(a: Column, b: Column, p: Column) -> Column:
    """Where on the segment a-b, from 0 to 1, the nearest point to p lies."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / square
    return F.when(square > 0, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def to_segment(a: Column, b: Column, p: Column) -> Column:
    t = along(a, b, p)
    return F.sqrt(F.pow(a["x"] + t * (b["x"] - a["x"]) - p["x"], 2) + F.pow(a["y"] + t * (b["y"] - a["y"]) - p["y"], 2))


def nearest_on(points: Column, p: Column) -> Column:
    """struct<dist, pos, side>: of the first nearest segment the distance, the position along the line of the
    nearest point, and the cross product (negative: p is on the right)."""
    start = F.struct(F.lit(float("inf")).alias("dist"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("side"), F.lit(0.0).alias("run"))

    def step(acc: Column, s: Column) -> Column:
        d, n = to_segment(s["a"], s["b"], p), distance(s["a"], s["b"])
        cross = (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])
        run = acc["run"] + n
        best = F.struct(d.alias("dist"), (acc["run"] + along(s["a"], s["b"], p) * n).alias("pos"), cross.alias("side"), run.alias("run"))
        kept = F.struct(acc["dist"].alias("dist"), acc["pos"].alias("pos"), acc["side"].alias("side"), run.alias("run"))
        return F.when(d < acc["dist"], best).otherwise(kept)

    return F.aggregate(segments(points), start, step)


def point_at(points: Column, pos: Column) -> Column:
    """The point at that distance along the line; its ends beyond them."""
    start = F.struct(F.lit(0.0).alias("run"), points[0].alias("p"))

    def step(acc: Column, s: Column) -> Column:
        n = distance(s["a"], s["b"])
        t = F.when(n > 0, F.least(F.greatest((pos - acc["run"]) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        there = point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))
        return F.struct((acc["run"] + n).alias("run"), F.when(pos > acc["run"], there).otherwise(acc["p"]).alias("p"))

    return F.aggregate(segments(points), start, step)["p"]


def part(points: Column, begin: Column, end: Column) -> Column:
    """The part of a line between two distances along it."""
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast(POINTS).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        run = acc["run"] + distance(s["a"], s["b"])
        inside = (run > begin) & (run < end)
        return F.struct(run.alias("run"), F.when(inside, F.array_append(acc["out"], point(s["b"]["x"], s["b"]["y"]))).otherwise(acc["out"]).alias("out"))

    between = F.aggregate(segments(points), start, step)["out"]
    return F.concat(F.array(point_at(points, begin)), between, F.array(point_at(points, end)))


def vertex_distance(a: Column, b: Column) -> Column:
    """The largest distance of a vertex of either line to the other line."""
    far = lambda s, t: F.array_max(F.transform(s, lambda p: nearest_on(t, p)["dist"]))
    return F.greatest(far(a, b), far(b, a))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """True if the point lies in the ring, by ray casting; the ring may be open or closed."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = ring[F.pmod(i + 1, n)]
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1


def signed_area(ring: Column) -> Column:
    """Positive for rings against the clock."""
    n = F.size(ring)
    twice = F.transform(ring, lambda p, i: p["x"] * ring[F.pmod(i + 1, n)]["y"] - ring[F.pmod(i + 1, n)]["x"] * p["y"])
    return F.aggregate(twice, F.lit(0.0), lambda a, b: a + b) / 2


def centroid(points: Column, kind: Column) -> Column:
    """Of a POINT, LINESTRING (weighed by length) or POLYGON ring (weighed by area)."""
    n = F.size(points)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    ring = lambda k, area: total(F.transform(points, lambda p, i: (p[k] + points[F.pmod(i + 1, n)][k]) * cross(p, points[F.pmod(i + 1, n)]))) / (6 * area)
    way = lambda k: total(F.transform(segments(points), lambda s: (s["a"][k] + s["b"][k]) / 2 * distance(s["a"], s["b"]))) / length(points)
    mean = lambda k: total(F.transform(points, lambda p: p[k])) / n
    of = lambda k, area: F.when((kind == "POLYGON") & (area != 0), ring(k, area)).when((kind == "LINESTRING") & (length(points) > 0), way(k)).otherwise(mean(k))
    return let(F.when(kind == "POLYGON", signed_area(points)), lambda area: point(of("x", area), of("y", area)))


def parse_wkt(text: Column) -> Column:
    """struct<kind, parts, rings>: parts are the geometries of a MULTI kind (one for the others), each an array of rings
    (of a polygon the outer one and its holes; one line or point for the others); rings are those of all parts. Both are
    null where a coordinate cannot be read. Numbers behind x and y are passed over."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]+(\s+[A-Za-z]+)?\s*", ""), r"\s*([(),])\s*", "$1")
    pair = lambda s: F.filter(F.split(F.trim(s), r"\s+"), lambda v: v != "")
    points = lambda ring: F.transform(F.split(ring, ","), lambda s: F.struct(F.try_element_at(pair(s), F.lit(1)).try_cast("double").alias("x"), F.try_element_at(pair(s), F.lit(2)).try_cast("double").alias("y")))
    rings = lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"[^()]*[^(),][^()]*"), F.lit(0)), points)
    polygons = F.transform(F.split(body, r"\)\),\(\("), rings)
    single = F.transform(F.flatten(polygons), lambda r: F.array(r))
    places = F.transform(F.flatten(F.flatten(polygons)), lambda p: F.array(F.array(p)))
    parts = F.when(kind == "MULTIPOLYGON", polygons).when(kind == "MULTILINESTRING", single).when(kind == "MULTIPOINT", places).otherwise(F.array(F.flatten(polygons)))
    good = lambda flat: (F.size(flat) > 0) & ~F.exists(F.flatten(flat), lambda p: p["x"].isNull() | p["y"].isNull())
    checked = lambda parts: let(F.flatten(parts), lambda flat: let(good(flat), lambda g: F.struct(kind.alias("kind"), F.when(g, parts).alias("parts"), F.when(g, flat).alias("rings"))))
    return let(parts, checked)


def inside_parts(parts: Column, x: Column, y: Column) -> Column:
    """True if the point lies in a part and in none of its holes. The parts of a valid geometry don't overlap, so that
    it lies inside an odd number of rings then."""
    return F.aggregate(F.transform(F.flatten(parts), lambda ring: inside(ring, x, y).cast("int")), F.lit(0), lambda a, b: a + b) % 2 == 1


def centroid_of_parts(parts: Column, kind: Column) -> Column:
    """Of all parts of a geometry: polygons weighed by their areas without holes, lines by their lengths, points equally."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    # Weighted sums, holes against their outer rings.
    area = lambda ring, i: F.when(i == 0, F.abs(signed_area(ring))).otherwise(-F.abs(signed_area(ring)))
    areas = F.flatten(F.transform(parts, lambda p: F.transform(p, lambda r, i: F.struct(area(r, i).alias("w"), centroid(r, F.lit("POLYGON")).alias("c")))))
    lines = F.transform(F.flatten(parts), lambda r: F.struct(length(r).alias("w"), centroid(r, F.lit("LINESTRING")).alias("c")))
    points = F.transform(F.flatten(F.flatten(parts)), lambda p: F.struct(F.lit(1.0).alias("w"), point(p["x"], p["y"]).alias("c")))
    by = lambda a, k: total(F.transform(a, lambda s: s["w"] * s["c"][k])).alias(k)
    sums = lambda ws: let(ws, lambda a: F.struct(total(F.transform(a, lambda s: s["w"])).alias("w"), by(a, "x"), by(a, "y")))
    weighed = F.when(kind.endswith("POLYGON"), sums(areas)).when(kind.endswith("LINESTRING"), sums(lines))
    kept = lambda s: (kind.endswith("POLYGON") & (s["w"] != 0)) | (kind.endswith("LINESTRING") & (s["w"] > 0))
    used = let(weighed, lambda s: F.when(kept(s), s).otherwise(sums(points)))
    return let(used, lambda s: point(s["x"] / s["w"], s["y"] / s["w"]))


def to_wkt(points: Column, kind: str = "LINESTRING") -> Column:
    """Text of a line, point or ring, numbers as they are."""
    body = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind}((" if kind == "POLYGON" else f"{kind}("), body, F.lit("))" if kind == "POLYGON" else ")"))


class Datum(NamedTuple):
    """An ellipsoid (half axis in metres, flattening) and how coordinates of WGS84 get to it: shifts in metres, rotations
    in arc seconds, a scale in parts per million (a position vector transformation)."""

    a: float
    f: float
    shift: tuple[float, ...] = ()


class Mercator(NamedTuple):
    """A transverse Mercator projection: middle meridian, scale on it, false easting and northing."""

    lon: float
    scale: float
    east: float
    north: float
    datum: Datum


# Ellipsoids, the shift from WGS84 to the German main triangle net, and the numbers of projections.
WGS84 = Datum(6378137.0, 1 / 298.257223563)
GRS80 = Datum(6378137.0, 1 / 298.257222101)
DHDN = Datum(6377397.155, 1 / 299.1528128, (-598.1, -73.7, -418.2, -0.202, -0.045, 2.455, -6.7))


def projection(epsg: int) -> Mercator:
    """The projection of a number: UTM north and south, ETRS89 zones, Gauss-Krueger zones 2 to 5."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return Mercator(epsg % 100 * 6.0 - 183, 0.9996, 500000.0, 0.0 if epsg < 32700 else 1e7, WGS84)
    if 25828 <= epsg <= 25838:
        return Mercator((epsg - 25800) * 6.0 - 183, 0.9996, 500000.0, 0.0, GRS80)
    if 31466 <= epsg <= 31469:
        zone = epsg - 31464
        return Mercator(zone * 3.0, 1.0, zone * 1e6 + 500000, 0.0, DHDN)
    raise ValueError(f"the projection {epsg} is not known")


def shifted(lat: Column, lon: Column, to: Datum) -> tuple[Column, Column]:
    """Degrees of WGS84 as degrees on another datum, at height 0."""
    if not to.shift:
        return lat, lon
    dx, dy, dz, rx, ry, rz, ppm = to.shift
    rx, ry, rz, m = *(math.radians(r / 3600) for r in (rx, ry, rz)), 1 + ppm * 1e-6
    phi, lam = F.radians(lat), F.radians(lon)
    e2 = WGS84.f * (2 - WGS84.f)
    n = WGS84.a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    x, y, z = n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e2) * F.sin(phi)
    x, y, z = dx + m * (x - rz * y + ry * z), dy + m * (rz * x + y - rx * z), dz + m * (-ry * x + rx * y + z)
    e2 = to.f * (2 - to.f)
    # The latitude by Bowring's formula; at heights near 0 it is exact far below a millimetre.
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z, p * (1 - to.f))
    b = to.a * (1 - to.f)
    up = z + e2 / (1 - e2) * b * F.pow(F.sin(theta), 3)
    return F.degrees(F.atan2(up, p - e2 * to.a * F.pow(F.cos(theta), 3))), F.degrees(F.atan2(y, x))


def projected(lat: Column, lon: Column, to: Mercator) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees, by the series in the third flattening; exact to a millimetre within some
    degrees of the middle meridian."""
    lat, lon = shifted(lat, lon, to.datum)
    n = to.datum.f / (2 - to.datum.f)
    scale = to.scale * to.datum.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - to.lon)
    e = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return to.east + scale * east, to.north + scale * north


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) of WGS84 degrees in a UTM zone."""
    return projected(lat, lon, projection(32600 + zone))


def on_spheroid(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 12, datum: Datum = WGS84) -> Column:
    """Metres between two points in degrees along the ellipsoid, by Vincenty's iteration as one fold: below a tenth of a
    millimetre, but for points almost opposite each other on the globe, where the sphere's distance stands in."""
    a, f = datum.a, datum.f
    u = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    su1, cu1, su2, cu2 = F.sin(u(lat1)), F.cos(u(lat1)), F.sin(u(lat2)), F.cos(u(lat2))
    wide = F.radians(lon2 - lon1)
    names = ("lam", "sigma", "sin_s", "cos_s", "cos2", "mid", "last")
    start = F.struct(wide.alias("lam"), *(F.lit(0.0).alias(k) for k in names[1:]))

    def step(acc: Column, _: Column) -> Column:
        lam = acc["lam"]
        sin_s = F.sqrt(F.pow(cu2 * F.sin(lam), 2) + F.pow(cu1 * su2 - su1 * cu2 * F.cos(lam), 2))
        cos_s = su1 * su2 + cu1 * cu2 * F.cos(lam)
        one = F.struct(lam.alias("lam"), sin_s.alias("sin_s"), cos_s.alias("cos_s"), F.when(sin_s > 0, cu1 * cu2 * F.sin(lam) / sin_s).otherwise(0.0).alias("sin_a"))

        def turned(v: Column) -> Column:
            cos2 = 1 - v["sin_a"] * v["sin_a"]
            mid = F.when(cos2 > 1e-15, v["cos_s"] - 2 * su1 * su2 / cos2).otherwise(0.0)  # along the equator: 0
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            sigma = F.atan2(v["sin_s"], v["cos_s"])
            lam = wide + (1 - c) * f * v["sin_a"] * (sigma + c * v["sin_s"] * (mid + c * v["cos_s"] * (2 * mid * mid - 1)))
            return F.struct(*(x.alias(k) for k, x in zip(names, (lam, sigma, v["sin_s"], v["cos_s"], cos2, mid, v["lam"]), strict=True)))

        return F.transform(F.array(one), turned)[0]

    def metres(v: Column) -> Column:
        u2 = v["cos2"] * (1 / (1 - f) ** 2 - 1)
        big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
        small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
        m2 = 2 * v["mid"] * v["mid"] - 1
        third = small / 6 * v["mid"] * (4 * v["sin_s"] * v["sin_s"] - 3) * (4 * v["mid"] * v["mid"] - 3)
        less = small * v["sin_s"] * (v["mid"] + small / 4 * (v["cos_s"] * m2 - third))
        settled = F.abs(v["lam"] - v["last"]) < 1e-11
        return F.when(settled, a * (1 - f) * big * (v["sigma"] - less)).otherwise(haversine(lat1, lon1, lat2, lon2))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, metres)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees, on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * 6371008.8 * F.asin(F.sqrt(h))
