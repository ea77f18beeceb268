"""Tables of databases, with the one that Spark brings along, and geometry in binary form."""

import struct

import pytest
from pyspark.sql import functions as F

from isomesh.functions.wkb import float64, parse_geometry, parse_wkb
from isomesh.operators import sinks
from isomesh.sources import database, tables


def run(kind, points, order="<", count=True):
    body = b"".join(struct.pack(f"{order}{len(p)}d", *p) for p in points)
    return (struct.pack(f"{order}I", len(points)) if count else b"") + body


def head(code, order="<"):
    return struct.pack(f"{order}BI", order == "<", code)


SQUARE, HOLE, FAR = [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)], [(10, 10), (12, 10), (12, 12), (10, 10)]
polygon = lambda rings, code=3, order="<": head(code, order) + struct.pack(f"{order}I", len(rings)) + b"".join(run(3, r, order) for r in rings)
line = lambda points, code=2, order="<": head(code, order) + run(2, points, order)
point = lambda p, code=1, order="<": head(code, order) + run(1, [p], order, False)
many = lambda code, parts, order="<": head(code, order) + struct.pack(f"{order}I", len(parts)) + b"".join(parts)

GOOD = {
    "point": (point((1.5, -2.25)), "POINT", [[[(1.5, -2.25)]]]),
    "big end first": (point((1e-3, 1e300), order=">"), "POINT", [[[(1e-3, 1e300)]]]),
    "line with heights": (line([(1, 2, 9), (3, 4, 9)], 1002), "LINESTRING", [[[(1, 2), (3, 4)]]]),
    "heights and measures, extended": (line([(1, 2, 9, 8), (3, 4, 9, 8)], 0xC0000002), "LINESTRING", [[[(1, 2), (3, 4)]]]),
    "projection": (struct.pack("<BII", 1, 0x20000001, 25833) + struct.pack("<2d", 4, 5), "POINT", [[[(4, 5)]]]),
    "hole": (polygon([SQUARE, HOLE]), "POLYGON", [[SQUARE, HOLE]]),
    "polygons": (many(6, [polygon([SQUARE, HOLE]), polygon([FAR], order=">")]), "MULTIPOLYGON", [[SQUARE, HOLE], [FAR]]),
    "lines": (many(5, [line([(0, 0), (1, 1)]), line([(2, 2), (3, 3), (4, 4)])], ">"), "MULTILINESTRING", [[[(0, 0), (1, 1)]], [[(2, 2), (3, 3), (4, 4)]]]),
    "points": (many(4, [point((0, 0)), point((1, 1))]), "MULTIPOINT", [[[(0, 0)]], [[(1, 1)]]]),
}
BAD = {
    "empty": b"", "one byte": b"\x01", "no count": head(2), "cut off": line([(0, 0), (1, 1)])[:-1], "more behind": point((0, 0)) + b"\x00", "byte order": b"\x07" + point((0, 0))[1:],
    "collection": many(7, [point((0, 0))]), "unknown kind": head(9) + bytes(16), "point among lines": many(5, [point((0, 0))]), "no number": point((float("nan"), 0.0)), "infinite": point((float("inf"), 0.0)),
    "no point": line([]), "count too large": head(2) + struct.pack("<I", 2**32 - 1) + bytes(32), "no part": many(6, []),
}


def shape(parts):
    return None if parts is None else [[[(p.x, p.y) for p in ring] for ring in part] for part in parts]


def test_geometry_in_binary_form(spark):
    rows = [(k, bytearray(v[0])) for k, v in GOOD.items()] + [(k, bytearray(v)) for k, v in BAD.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "name string, data binary")
    got = {r["name"]: r for r in df.select("name", parse_wkb(F.col("data")).alias("g")).collect()}
    for name, (_, kind, parts) in GOOD.items():
        assert got[name].g.kind == kind and shape(got[name].g.parts) == parts, name
        assert [[(p.x, p.y) for p in ring] for ring in got[name].g.rings] == [ring for part in parts for ring in part], name
    for name in [*BAD, "null"]:
        assert got[name].g is None or (got[name].g.parts is None and got[name].g.rings is None), name
    # As databases print it, and beside plain text.
    texts = df.select("name", F.hex("data").alias("t")).union(spark.createDataFrame([("plain", "POINT(1 2)"), ("escaped", "\\x" + point((3, 4)).hex()), ("nothing", "")], "name string, t string"))
    got = {r["name"]: shape(r.parts) for r in texts.select("name", parse_geometry(F.col("t"), texts.schema["t"].dataType)["parts"].alias("parts")).collect()}
    assert all(got[k] == v[2] for k, v in GOOD.items()) and got["plain"] == [[[(1, 2)]]] and got["escaped"] == [[[(3, 4)]]] and got["nothing"] is None


def test_doubles_are_exact(spark):
    values = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, -13.405, 2.0**53 + 2, 1 / 3]
    df = spark.createDataFrame([(bytearray(struct.pack(">d", v)), bytearray(struct.pack("<d", v)), v) for v in values], "b binary, l binary, v double")
    for r in df.select("v", float64(F.col("b"), F.lit(1), F.lit(False)).alias("x"), float64(F.col("l"), F.lit(1), F.lit(True)).alias("y")).collect():
        assert struct.pack("<d", r.x) == struct.pack("<d", r.y) == struct.pack("<d", r.v)


def counter(ids):
    asked = []

    def count(low, high, width):
        asked.append((low, high, width))
        found = {}
        for i in ids:
            if low <= i <= high:
                first = i - (i - low) % width
                found[first] = found.get(first, 0) + 1
        return list(found.items())

    return count, asked


@pytest.mark.parametrize("ids", [list(range(1000)), [0] * 400 + [10**12] * 3 + list(range(5, 300)), [7] * 900, list(range(0, 10**9, 10**7)) + list(range(10**9, 10**9 + 500)), [-(10**6), -3, 4]])
def test_ranges_hold_all_rows_and_none_too_many(ids):
    count, asked = counter(ids)
    found = database.ranges(count, min(ids), max(ids), len(ids), 50)
    assert all(a <= b for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
    held = [sum(a <= i <= b for i in ids) for a, b in found]
    assert sum(held) == len(ids) and all(n <= 50 or a == b for n, (a, b) in zip(held, found, strict=True))
    assert len(found) <= 2 * len(ids) // 50 + 2 + len(set(ids)) // 50 and len(asked) < 20


URL = "jdbc:derby:memory:places;create=true"


def test_tables_of_a_database(spark):
    rows = [(i, float(i % 7), point((i, 2 * i)).hex() if i % 2 else f"POINT({i} {2 * i})") for i in [*range(500), 10**9, 10**12]]
    df = spark.createDataFrame(rows, "id bigint, jobs double, geom string")
    database.write(df.union(spark.createDataFrame([(None, 1.0, "POINT(0 0)")], df.schema)), f"{URL}|objects", comment="jobs")
    source = f"{URL},objects"
    scan = database.read(spark, source, "id", rows=60)
    parts = [n for n in scan.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert scan.count() == 503 and len(parts) >= 9 and max(r["count"] for r in parts) <= 60
    assert database.read(spark, source, "geom", rows=60).rdd.getNumPartitions() == 1
    # The database filters, and gives the columns that are asked for alone.
    some = database.read(spark, source, "id", '"jobs" > 2 AND "id" IS NOT NULL', rows=60)
    assert some.count() == sum(r[1] > 2 for r in rows) and some.rdd.getNumPartitions() > 3
    plan = some.select("id").where("id < 5")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "LessThan(id,5)" in plan
    got = {r.object_id: (r["var"], r.cx, r.cy) for r in tables.layer(spark, source, '"id" IS NOT NULL', var="jobs").collect()}
    assert got == {i: (float(i % 7), float(i), 2.0 * i) for i, _, _ in rows}
    with pytest.raises(ValueError, match="bad id"):
        tables.layer(spark, source)
    # Without rows.
    assert database.read(spark, source, "id", '"id" < -5', rows=60).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        database.write(df, f"{URL}|objects", replace=False)


def test_networks_and_results_in_a_database(spark):
    edges = [("a", 1, 2, True, False, False, 36.0, 50.0, None, line([(0, 0), (50, 0)]).hex()), ("b", 2, 3, True, True, True, 36.0, 50.0, 2.0, many(5, [line([(50, 0), (99, 0)])]).hex())]
    schema = "oid string, nodefrom bigint, nodeto bigint, mode_walk boolean, mode_bike boolean, mode_mit boolean, vmax double, length double, incline double, geom string"
    database.write(spark.createDataFrame(edges, schema), f"{URL}|net")
    got = {r.edge_id: r for r in tables.network(spark, f"db;{URL},net,app,secret", incline=True).collect()}
    assert (got["a"].modes, got["a"].incline, got["b"].modes, got["b"].incline) == (2, 0.0, 14, 2.0) and [(p.x, p.y) for p in got["b"].geom] == [(50, 0), (99, 0)]
    two = [("c", 1, 2, True, False, False, 36.0, 50.0, None, many(5, [line([(0, 0), (5, 0)]), line([(6, 0), (9, 0)])]).hex()), ("d", 1, 2, True, False, False, 36.0, 50.0, None, point((0, 0)).hex())]
    good, errors = tables.net_table(spark.createDataFrame(two, schema))
    assert not good.count() and sorted(r.problem for r in errors.collect()) == ["bad geometry", "several lines"]
    sinks.write(spark.createDataFrame([(1, 2.5)], "fid bigint, avg_tt float"), f"{URL},results", comment="password=x")
    assert [tuple(r) for r in tables.table(spark, f"{URL},results").collect()] == [(1, 2.5)]


def test_names_of_databases():
    assert database.place("jdbc:postgresql://h/d,s.t,me,pw") == ("jdbc:postgresql://h/d", "s.t", {"user": "me", "password": "pw"})
    assert database.place("db;jdbc:sqlite:a.db;t") == ("jdbc:sqlite:a.db", "t", {})
    assert database.is_database("db,jdbc:x,t") and not database.is_database("a.csv") and tables.is_table("db;jdbc:postgresql://h/d;t;u;p")
    for wrong in ("jdbc:sqlite:a.db", "jdbc:postgresql://h/d,t,me", "a,b"):
        with pytest.raises(ValueError, match="named by"):
            database.place(wrong)
    at = database.place("jdbc:postgresql://h/d,s.t,me,pw")
    assert database.selection(at) == "s.t" and database.selection(at, "a > 1") == "(SELECT t.* FROM s.t t WHERE a > 1) s"
    assert database.selection(at, "a > 1", "the_geom", 25833) == "(SELECT t.*, ST_AsBinary(ST_Transform(t.the_geom, 25833)) AS geom_binary FROM s.t t WHERE a > 1) s"
