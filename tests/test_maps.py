"""Maps, simulation files and tables as sources."""

import pytest
from pyspark.sql import functions as F

from isomesh.operators.state import settled
from isomesh.sources import gtfs, osm, sumo, tables

MAP = """<osm>
 <node id="1" lat="0.0" lon="0.0"/> <node id="2" lat="0.0" lon="0.001"/> <node id="3" lat="0.001" lon="0.001"/> <node id="4" lat="0.001" lon="0.0"><tag k="shop" v="yes"/></node>
 <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="oneway" v="yes"/><tag k="oneway:bicycle" v="no"/><tag k="maxspeed" v="30"/></way>
 <way id="11"><nd ref="1"/><nd ref="4"/><nd ref="3"/><nd ref="2"/><tag k="highway" v="footway"/></way>
 <way id="12"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way>
 <way id="13"><nd ref="1"/><nd ref="4"/><nd ref="3"/></way>
 <relation id="20"><member type="way" ref="12" role="outer"/><member type="way" ref="13" role="outer"/><tag k="landuse" v="park"/></relation>
</osm>"""
NET = """<net><location netOffset="10,20"/>
 <edge id="e" from="u" to="v"><lane id="e_0" speed="10" length="100" shape="10,20 110,20" allow="pedestrian bicycle"/><lane id="e_1" speed="20" length="102" shape="10,22 110,22" disallow="pedestrian"/></edge>
 <edge id=":j" from="u" to="v" type="internal"><lane id="j_0" speed="10" length="1" shape="0,0 1,1"/></edge>
</net>"""


def test_roads_and_areas_of_a_map(spark, tmp_path):
    (tmp_path / "map.osm").write_text(MAP)
    nodes, ways, relations = osm.read(spark, f"{tmp_path}/map.osm")
    edges = {r.edge_id: r for r in osm.road_edges(ways, nodes).collect()}
    # All of 1, 2 and 3 are met twice; 4 is not.
    assert {k: (r.from_node, r.to_node, r.modes) for k, r in edges.items()} == {
        "f10#0": (1, 2, 30), "f10#1": (2, 3, 30), "b10#0": (2, 1, 6), "b10#1": (3, 2, 6),
        "f11#0": (1, 3, 2), "f11#1": (3, 2, 2), "b11#0": (3, 1, 2), "b11#1": (2, 3, 2),
    }
    assert edges["f10#0"].vmax == 30.0 and edges["f10#0"].length == pytest.approx(111.3195, abs=1e-3) and edges["f10#0"].opposite_id == "b10#0"
    found = osm.structures("[node]\nshop=*\n[rel]\nlanduse=park", nodes, ways, relations).collect()
    assert sorted((r.kind, r.id) for r in found) == [("node", 4), ("rel", 20)]
    areas = osm.areas(osm.members_of(relations, relations.select("relation_id")), ways, nodes).collect()
    assert len(areas) == 1 and areas[0].closed and len(areas[0].ring) == 5


def test_loops_are_cut_and_odd_tags_read(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 1], {"highway": "service", "incline": "10°", "maxspeed": "DE:urban"}), (2, [7], {"highway": "service"}), (3, [1, 2], {"highway": "nothing"}), (4, [], {})], "way_id bigint, refs array<bigint>, tags map<string,string>")
    nodes = spark.createDataFrame([(i, 0.0, i / 1000.0) for i in (1, 2, 3, 7)], "node_id bigint, lat double, lon double")
    edges = {r.edge_id: r for r in osm.road_edges(ways, nodes).collect()}
    assert {k: (r.from_node, r.to_node) for k, r in edges.items()} == {"f1#0": (1, 3), "f1#1": (3, 1), "b1#0": (3, 1), "b1#1": (1, 3)}
    assert edges["f1#0"].vmax == 50.0 and edges["b1#0"].incline == pytest.approx(-17.63, abs=0.01)


def test_simulation_files(spark, tmp_path):
    (tmp_path / "a.net.xml").write_text(NET)
    (tmp_path / "a.poi.xml").write_text('<additional><poi id="1" x="3" y="4"/><poi id="z" x="3" y="4"/><poly id="2" shape="0,0 4,0 4,4 0,4"/></additional>')
    (tmp_path / "a.dump.xml").write_text('<meandata><interval begin="0" end="60"><edge id="e" speed="5"/><edge id="f" speed="6"/></interval></meandata>')
    edges = tables.network(spark, f"{tmp_path}/a.net.xml")
    e = edges.collect()
    assert len(e) == 1 and (e[0].edge_id, e[0].modes, e[0].vmax, e[0].length) == ("e", 14, 20.0, 101.0)
    assert [(p.x, p.y) for p in e[0].geom] == [(0.0, 1.0), (100.0, 1.0)]
    good, errors = sumo.layer(spark, f"{tmp_path}/a.poi.xml")
    assert sorted((r.object_id, r.cx, r.cy) for r in good.collect()) == [(1, 3.0, 4.0), (2, 2.0, 2.0)] and [r.problem for r in errors.collect()] == ["bad id"]
    assert [(r.edge_id, r.speed) for r in tables.speeds(spark, f"{tmp_path}/a.dump.xml", edges).collect()] == [("e", 5.0)]


def test_tables_and_feeds(spark):
    spark.createDataFrame([(1, "POINT(1 2)", 5.0), (2, "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", 1.0)], "id bigint, geom string, jobs double").createOrReplaceTempView("places")
    assert [(r.object_id, r["var"]) for r in tables.layer(spark, "places", "jobs > 2", var="jobs").collect()] == [(1, 5.0)]
    inside = tables.boundary(spark, "places")
    assert [r[0] for r in spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)], "x double, y double").select(inside(F.col("x"), F.col("y"))).collect()] == [True, False]
    spark.createDataFrame([("n", 1, 2, "t", "f", "f", 36.0, 50.0, 3.0, "LINESTRING(0 0, 50 0)"), ("m", 1, 2, "f", "f", "f", 36.0, 50.0, 3.0, "LINESTRING(0 0, 50 0)")], "oid string, nodefrom bigint, nodeto bigint, mode_walk string, mode_bike string, mode_mit string, vmax double, length double, incline double, geom string").createOrReplaceTempView("streets")
    assert [(r.edge_id, r.modes, r.vmax, r.incline) for r in tables.network(spark, "streets", incline=True).collect()] == [("n", 2, 10.0, 3.0)]
    raw = spark.createDataFrame([("s", "", "4")], "stop_id string, stop_lat string, stop_lon string")
    assert tuple(gtfs.typed(raw, "stops").first()) == ("s", -1.0, 4.0)
    with pytest.raises(ValueError, match="trip_id"):
        gtfs.typed(raw, "stop_times")


def test_copies_of_rings_are_compared_once(spark, monkeypatch):
    written = {}

    def counted(df, tag):
        out = settled(df, tag)
        written.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(osm, "settled", counted)
    square = lambda x, w: [(x, 0.0), (x + w, 0.0), (x + w, w), (x, w), (x, 0.0)]
    kind = "id bigint, ring array<struct<x:double,y:double>>"
    inner = spark.createDataFrame([(i, square(1.0 + i % 2, 1.0)) for i in range(20)] + [(40, square(90.0, 1.0))], kind)
    outer = spark.createDataFrame([(i, square(0.0, 9.0)) for i in range(15, 30)] + [(41, square(70.0, 9.0))], kind)
    found = sorted(map(tuple, osm.within(inner, outer, 5.0).collect()))
    assert found == [(a, b) for a in range(20) for b in range(15, 30) if a != b]
    assert written == {"shapes": [3, 2], "within": [2]}
