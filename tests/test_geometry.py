"""Geometries of several parts, projections and lengths on the ellipsoid, against numbers known from elsewhere."""

import math

import pytest
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.operators import aggregate, mapping
from isomesh.sources import text

SHAPES = [
    "1;MULTIPOLYGON(((0 0, 8 0, 8 8, 0 8, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2)), ((10 0,12 0,12 2,10 2,10 0)))", "2; MULTIPOINT((1 1), (3 5))", "3;MULTIPOINT(1 1, 3 5)", "4;MULTILINESTRING((0 0, 2 0), (0 0, 0 6))",
    "5;POLYGON((0 0, 0 4, 4 4, 4 0, 0 0),(1 1, 1 3, 3 3, 3 1, 1 1))", "6;POINT Z (7 8 9)", "7;LINESTRING(0 0, 4 0)", "8;POLYGON((0 0, x 4, 4 4))", "9;MULTIPOLYGON EMPTY",
]


def test_parts_and_their_centres(spark):
    good, errors = text.layer_wkt(spark.createDataFrame([(s,) for s in SHAPES], "value string"))
    rows = {r.object_id: r for r in good.collect()}
    assert sorted(r.value.split(";")[0] for r in errors.collect()) == ["8", "9"]
    assert [[len(ring) for ring in part] for part in rows[1].parts] == [[5, 5], [5]]
    assert [len(rows[i].parts) for i in range(2, 8)] == [2, 2, 2, 1, 1, 1]
    near = {1: ((64 * 4 - 4 * 3 + 4 * 11) / 64, (64 * 4 - 4 * 3 + 4 * 1) / 64), 2: (2, 3), 3: (2, 3), 4: (0.25, 2.25), 5: (2, 2), 6: (7, 8), 7: (2, 0)}
    for i, (x, y) in near.items():
        assert (rows[i].cx, rows[i].cy) == pytest.approx((x, y))


def test_points_in_parts_and_not_in_holes(spark):
    areas = text.layer_wkt(spark.createDataFrame([(SHAPES[0],), (SHAPES[4],)], "value string"))[0]
    at = [(1, 1.0, 1.0, 1), (2, 2.5, 2.5, -1), (3, 11.0, 1.0, 1), (4, 9.0, 1.0, -1), (5, 3.5, 0.5, 1), (6, 7.0, 7.0, 1)]
    objects = spark.createDataFrame([a[:3] for a in at], "object_id bigint, cx double, cy double")
    for cell in (1.0, 1000.0):
        got = {r.object_id: r.area_id for r in mapping.area_of(objects, areas.where("object_id = 1"), cell).collect()}
        assert got == {a[0]: a[3] for a in at}
    assert {r.object_id: r.area_id for r in mapping.area_of(objects, areas).collect()}[2] == -1


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arc(lat, a, f):
    """The length of the meridian from the equator, by Simpson's rule."""
    e2, n = f * (2 - f), 2000
    at = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    h = math.radians(lat) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * at(i * h) for i in range(n + 1))


@pytest.mark.parametrize("epsg,lat,lon", [(32633, 52.0, 15.0), (32733, -33.5, 15.0), (25832, 48.25, 9.0)])
def test_the_middle_meridian_is_as_long_as_it_is(spark, epsg, lat, lon):
    p = G.projection(epsg)
    r = one(spark, *(c.alias(n) for n, c in zip("xy", G.projected(F.lit(lat), F.lit(lon), p), strict=True)))
    assert r.x == pytest.approx(500000, abs=1e-6) and r.y == pytest.approx(p.north + 0.9996 * arc(lat, p.datum.a, p.datum.f), abs=1e-3)


def test_projections_keep_angles(spark):
    """Steps of equal length north and east are of equal length and at right angles on the map."""
    lat, lon, d = 50.0, 17.5, 1e-5
    p = G.projection(32633)
    e2 = p.datum.f * (2 - p.datum.f)
    w = 1 - e2 * math.sin(math.radians(lat)) ** 2
    ratio = (1 - e2) / w / math.cos(math.radians(lat))  # degrees of longitude as long as one of latitude
    points = [(lat, lon), (lat + d, lon), (lat, lon + d * ratio)]
    r = one(spark, *(c.alias(f"c{i}{k}") for i, q in enumerate(points) for k, c in zip("xy", G.projected(F.lit(q[0]), F.lit(q[1]), p), strict=True)))
    north, east = (r.c1x - r.c0x, r.c1y - r.c0y), (r.c2x - r.c0x, r.c2y - r.c0y)
    assert math.hypot(*north) == pytest.approx(math.hypot(*east), rel=1e-6)
    assert abs(north[0] * east[0] + north[1] * east[1]) < 1e-6 * math.hypot(*north) ** 2


def test_datum_shift_and_unknown_projections(spark):
    """The shift moves Berlin by some hundred metres, and back by the inverse rotation it comes home."""
    r = one(spark, *(c.alias(n) for n, c in zip("ab", G.shifted(F.lit(52.5), F.lit(13.4), G.DHDN), strict=True)))
    assert 0.0005 < abs(r.a - 52.5) < 0.003 and 0.0005 < abs(r.b - 13.4) < 0.003
    back = G.DHDN._replace(a=G.WGS84.a, f=G.WGS84.f, shift=tuple(-x for x in G.DHDN.shift))
    there = one(spark, *(c.alias(n) for n, c in zip("ab", G.shifted(F.lit(52.5), F.lit(13.4), G.DHDN._replace(a=G.WGS84.a, f=G.WGS84.f)), strict=True)))
    home = one(spark, *(c.alias(n) for n, c in zip("ab", G.shifted(F.lit(there.a), F.lit(there.b), back), strict=True)))
    assert home.a == pytest.approx(52.5, abs=1e-5) and home.b == pytest.approx(13.4, abs=1e-5)
    for unknown in (31465, 32661, 2056, 3857):
        with pytest.raises(ValueError):
            G.projection(unknown)


def test_lengths_on_the_ellipsoid(spark):
    """Flinders Peak to Buninyong, a published pair on GRS80; a meridian's arc; the equator; the same place."""
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    peak, hill = (dms(-37, 57, 3.72030), dms(144, 25, 29.52440)), (dms(-37, 39, 10.15610), dms(143, 55, 35.38390))
    of = lambda a, b, datum=G.WGS84: G.on_spheroid(*map(F.lit, (*a, *b)), datum=datum)
    r = one(spark, of(peak, hill, G.GRS80).alias("p"), of((10.0, 5.0), (47.0, 5.0)).alias("m"), of((0.0, 3.0), (0.0, 13.0)).alias("e"), of(peak, peak).alias("s"), of((0.0, 0.0), (0.5, 179.7)).alias("far"))
    assert r.p == pytest.approx(54972.271, abs=1e-3)
    assert r.m == pytest.approx(arc(47.0, G.WGS84.a, G.WGS84.f) - arc(10.0, G.WGS84.a, G.WGS84.f), abs=1e-3)
    assert r.e == pytest.approx(math.radians(10) * G.WGS84.a, abs=1e-3) and r.s == 0.0
    assert 1.98e7 < r.far < 2.01e7


def test_percentiles_of_one_large_key(spark, monkeypatch):
    values = [(i % 7, i, float(i * 37 % 101), float(i % 3)) for i in range(700)]
    od = spark.createDataFrame(values, "origin bigint, destination bigint, tt double, dist double")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = aggregate.statistics(od, ["tt", "dist"], "all", "all").first()
        plain = aggregate.statistics(od, ["tt"], None, "all").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for name, i in (("tt", 2), ("dist", 3)):
        ranked = sorted(v[i] for v in values)
        for c, q in (("med", 0.5), ("p15", 0.15), ("p85", 0.85)):
            assert got[f"{c}_{name}"] == ranked[int(700 * q)]
        assert (got[f"min_{name}"], got[f"max_{name}"]) == (ranked[0], ranked[-1]) and got[f"avg_{name}"] == pytest.approx(sum(ranked) / 700)
    assert got.num == 700
    for r in plain:
        ranked = sorted(v[2] for v in values if v[0] == r.fid)
        assert (r.num, r.med_tt, r.p85_tt) == (len(ranked), ranked[len(ranked) // 2], ranked[int(len(ranked) * 0.85)])


def test_statistics_of_nothing(spark):
    assert aggregate.statistics(spark.createDataFrame([], "origin bigint, destination bigint, tt double"), ["tt"]).count() == 0


def test_cells_grow_with_the_length_of_a_segment(spark):
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    r = one(spark, F.size(mapping.passed(at(5, 5), at(100005, 60005), 240.0)).alias("n"), mapping.passed(at(10, 10), at(10, 250), 100.0).alias("up"), mapping.passed(at(7, 7), at(7, 7), 10.0).alias("dot"), mapping.passed(at(100, 50), at(0, 50), 100.0).alias("edge"))
    assert 660 < r.n < 680
    assert {tuple(c) for c in r.up} == {(0, 0), (0, 1), (0, 2)} and {tuple(c) for c in r.dot} == {(0, 0)} and {tuple(c) for c in r.edge} == {(0, 0), (1, 0)}
