"""Small networks with known results, from text lines to aggregated measures."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.functions import modes as M
from isomesh.operators import aggregate, limits, mapping, measures, network, routing, sinks
from isomesh.sources import gtfs, text

BOTH_WAYS = ["w;7;9;true;true;true;50;800;100;40;900;40", "x;9;7;true;true;true;50;800;900;40;100;40"]
THREE = ["q;4;5;true;true;true;50;300;0;10;300;10", "p;5;6;true;true;true;50;120;300;10;420;10", "r;6;7;true;true;true;50;240;420;10;660;10"]


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def net(spark, rows, mode=M.FOOT):
    edges = network.with_opposites(text.strict(*text.net_csv(lines(spark, *rows), used=mode.bit)), foot_used=mode is M.FOOT)
    return edges.withColumn("tt", F.col("length") / F.least("vmax", F.lit(mode.vmax))).cache()


def layer(spark, *rows):
    return text.strict(*text.layer_csv(lines(spark, *rows)))


def mapped(objects, edges):
    return mapping.nearest_edge(objects, edges).cache()


def near(rows, expected, tolerance=0.0101):
    got, want = sorted(map(tuple, rows)), sorted(expected)
    assert len(got) == len(want), (got, want)
    for g, w in zip(got, want, strict=True):
        assert all(abs(a - b) <= tolerance if isinstance(b, float) else a == b for a, b in zip(g, w, strict=True)), (g, w)


def test_side_of_the_road(spark):
    objects = layer(spark, "11;100;10", "12;300;52", "13;500;40", "14;640;33", "15;880;61")
    got = mapped(objects, net(spark, BOTH_WAYS)).select("object_id", "edge_id", "pos", "dist").collect()
    near(got, [(11, "w", 0.0, 30.0), (12, "x", 600.0, 12.0), (13, "x", 400.0, 0.0), (14, "w", 540.0, 7.0), (15, "x", 20.0, 21.0)])


def test_far_objects_are_mapped_too(spark):
    got = mapped(layer(spark, "1;40000;7", "2;0;-90000", "3;500;41"), net(spark, BOTH_WAYS)).select("object_id", "dist").collect()
    near(got, [(1, 39100.014), (2, 90040.056), (3, 1.0)], 0.02)


@pytest.fixture(scope="module")
def three(spark):
    e = net(spark, THREE)
    sources, goals = layer(spark, "50;360;10"), layer(spark, "61;300;-10;1", "62;420;20;1", "63;500;-20;2", "64;220;60;2", "65;600;-30;2", "66;120;70;2")
    o, d = mapped(sources, e), mapped(goals, e)
    labels = routing.search(routing.starts(o, e), e, 3600.0)
    od = routing.od_values(labels, o, d, e, 3600.0).join(goals.select(F.col("object_id").alias("destination"), F.col("var").alias("value")), "destination").withColumn("weight", F.lit(1.0))
    return e, sources, goals, o, d, labels, od.cache()


def test_ways_and_limits(three):
    od = three[-1]
    show = lambda df: df.select("origin", "destination", "dist", "tt").collect()
    everything = [(50, 61, 60.0, 60.0), (50, 62, 60.0, 60.0), (50, 63, 140.0, 140.0), (50, 64, 140.0, 140.0), (50, 65, 240.0, 240.0), (50, 66, 240.0, 240.0)]
    near(show(od), everything)
    near(show(limits.limited(od, max_value=4)), everything[:3])
    near(show(limits.limited(od, max_number=2)), everything[:2])
    near(show(limits.limited(od, shortest=True)), everything[:1])
    near(show(limits.limited(od, max_tt=60.0)), everything[:2])
    near(show(limits.limited(od, max_distance=10.0)), [])
    near(show(limits.limited(od, max_value=1)), everything[:1])


def test_ordered_search_agrees_and_honours_distance(three):
    e, _, _, o, _, labels, _ = three
    ordered = routing.search_ordered(routing.starts(o, e), e, 3600.0)
    key = lambda df: sorted(map(tuple, df.select("origin", "node", F.round("tt", 6), F.round("dist", 6)).collect()))
    assert key(ordered) == key(labels)
    assert max(r.dist for r in routing.search_ordered(routing.starts(o, e), e, max_dist=70.0).collect()) <= 70.0


def settle_one(first, out, delay, max_tt, max_dist):
    """Labels of one origin by a heap: node, tt, dist, edge, previous node."""
    best, queue = {}, []

    def offer(node, tt, dist, edge, before):
        if node not in best or tt < best[node][0]:
            best[node] = (tt, dist, edge, before)
            heapq.heappush(queue, (tt, dist, edge, node))

    for x in first:
        offer(*x, None)
    while queue:
        tt, dist, edge, node = heapq.heappop(queue)
        if best[node][0] != tt or best[node][2] != edge or tt > max_tt or dist > max_dist:
            continue
        for next_, e, length, e_tt in out.get(node, ()):
            offer(next_, tt + e_tt + delay.get((edge, e), 0.0), dist + length, e, node)
    return {(node, *x) for node, x in best.items() if x[0] <= max_tt and x[1] <= max_dist}


def test_ordered_search_equals_a_heap_without_collecting_the_network(spark, monkeypatch):
    rng = random.Random(3)
    roads = sorted((f"e{i:03}", rng.randrange(30), rng.randrange(30), float(rng.randint(1, 9)), rng.choice([2.0, 2.5, 3.0, 4.0, 5.5])) for i in range(110))
    e = spark.createDataFrame(roads, "edge_id string, from_node bigint, to_node bigint, length double, tt double")
    delay = {(a[0], b[0]): float(rng.randint(1, 4)) for a in roads for b in roads if a[2] == b[1] and rng.random() < 0.5}
    turns = spark.createDataFrame([(*k, v) for k, v in delay.items()], "from_edge string, to_edge string, delay double")
    first = {1: [(0, 0.5, 1.0, "e000"), (7, 1.0, 2.0, "e001")], 2: [(11, 0.0, 0.0, "e002")]}
    begin = spark.createDataFrame([(o, *x) for o, xs in first.items() for x in xs], "origin bigint, node bigint, tt double, dist double, first string")
    out = {}
    for edge, a, b, length, tt in roads:
        out.setdefault(a, []).append((b, edge, length, tt))
    expected = {(o, *x) for o, xs in first.items() for x in settle_one(xs, out, delay, 12.0, 18.0)}
    monkeypatch.setattr(type(e), "toLocalIterator", None)
    got = routing.search_ordered(begin, e, 12.0, 18.0, turns)
    assert set(map(tuple, got.select("origin", "node", "tt", "dist", "edge", "before").collect())) == expected and len(expected) > 20


def test_paths_and_their_rows(three):
    e, _, _, o, d, labels, od = three
    ends = od.where("destination = 65").join(d.select(F.col("object_id").alias("destination"), "edge_id"), "destination").join(e.select("edge_id", F.col("from_node").alias("node")), "edge_id")
    steps = routing.paths(labels, ends.select("origin", "node")).select("origin", F.lit(65).cast("bigint").alias("destination"), "idx", "edge", "tt")
    steps = steps.union(ends.select("origin", "destination", F.lit(9), "edge_id", "tt"))
    rows = measures.path_rows(steps, e, o, d).orderBy("idx").collect()
    assert [r.edge for r in rows] == ["p", "r"]
    assert [[(p.x, p.y) for p in r.geom] for r in rows] == [[(360, 10), (420, 10)], [(420, 10), (600, 10)]]


def test_ways_end_from_either_side(spark):
    """The origin stands before the loop's far node: the quicker way enters the destination's edge against it."""
    e = spark.createDataFrame(
        [("a", "a_", 1, 2, 100.0, 100.0), ("a_", "a", 2, 1, 100.0, 100.0), ("b", "b_", 3, 2, 100.0, 100.0), ("b_", "b", 2, 3, 100.0, 100.0)],
        "edge_id string, opposite_id string, from_node bigint, to_node bigint, length double, tt double",
    )
    at = "object_id bigint, edge_id string, pos double"
    o = spark.createDataFrame([(1, "a", 40.0)], at)
    d = spark.createDataFrame([(5, "b", 70.0), (6, "a", 90.0), (7, "a", 10.0)], at)
    labels = routing.search(routing.starts(o, e), e, 900.0)
    od = routing.od_values(labels, o, d, e, 900.0)
    got = routing.last_edges(od, labels, o, d, e).select("destination", "edge", "node", "tt").collect()
    assert sorted(map(tuple, got)) == [(5, "b_", 2, 90.0), (6, "a", None, 50.0), (7, "a_", None, 30.0)]
    assert {r.destination: r.tt for r in od.collect()} == {5: 90.0, 6: 50.0, 7: 30.0}
    assert routing.last_edges(od.limit(0), labels, o, d, e).count() == 0


def test_other_modes(spark):
    for mode, seconds in ((M.FOOT, 100.0), (M.BIKE, 27.69), (M.CAR, 7.2)):
        e = net(spark, BOTH_WAYS, mode)
        o, d = mapped(layer(spark, "1;300;39"), e), mapped(layer(spark, "2;400;39"), e)
        near(routing.od_values(routing.search(routing.starts(o, e), e, 900.0), o, d, e, 900.0).select("dist", "tt").collect(), [(100.0, seconds)])


def test_backwards_on_a_one_way_road_is_dropped(spark):
    e = net(spark, ["z;1;2;false;false;true;50;800;100;40;900;40"], M.CAR)
    o, d = mapped(layer(spark, "1;400;40"), e), mapped(layer(spark, "2;350;40", "3;470;40"), e)
    near(routing.od_values(routing.search(routing.starts(o, e), e, 900.0), o, d, e, 900.0).select("destination", "dist").collect(), [(3, 70.0)])


AREAS = ["701;POLYGON((90 39, 499 39, 499 -60, 90 -60, 90 39))", "702;POLYGON((501 39, 910 39, 910 -60, 501 -60, 501 39))", "703;POLYGON((90 140, 499 140, 499 41, 90 41, 90 140))", "704;POLYGON((501 140, 910 140, 910 41, 501 41, 501 140))"]


def test_aggregation_by_areas(spark):
    e = net(spark, BOTH_WAYS)
    begin = {1: (100, 20), 2: (300, 30), 3: (400, 10), 4: (300, 50), 5: (360, 60), 6: (600, 60), 7: (700, 70)}
    end = {21: (200, 30), 22: (400, 50), 23: (200, 60), 24: (800, 50), 25: (700, 60), 26: (600, 70)}
    sources, goals = (layer(spark, *(f"{i};{x};{y}" for i, (x, y) in p.items())) for p in (begin, end))
    sources = sources.withColumn("weight", F.lit(1.0))
    o, d = mapped(sources, e), mapped(goals, e)
    od = routing.od_values(routing.search(routing.starts(o, e), e, 3600.0), o, d, e, 3600.0).withColumns({"value": F.lit(1.0), "weight": F.lit(1.0)}).cache()
    apart = sorted(float(abs(a[0] - b[0])) for a in begin.values() for b in end.values())
    near(aggregate.od_measures(od, sources, "all", "all").collect(), [(-1, -1, sum(apart) / 42, sum(apart) / 42, 6.0, 6.0)])
    areas = text.strict(*text.layer_wkt(lines(spark, *AREAS)))
    oa, da = mapping.area_of(sources, areas), mapping.area_of(goals, areas)
    got = aggregate.od_measures(od, sources, oa, da).collect()
    near([r for r in got if r.fid == 701], [(701, 704, 433.33, 433.33, 3.0, 3.0), (701, 703, 133.33, 133.33, 2.0, 2.0), (701, 701, 133.33, 133.33, 1.0, 1.0)])
    assert len(aggregate.dense(aggregate.od_measures(od, sources, oa, da), oa.selectExpr("area_id as fid"), da.selectExpr("area_id as sid")).collect()) == oa.select("area_id").distinct().count() * da.select("area_id").distinct().count()
    s = aggregate.statistics(od, ["dist"], "all", "all").first()
    near([(s.num, s.med_dist, s.p15_dist, s.p85_dist)], [(42, apart[21], apart[6], apart[35])])


def test_crossing_delays(spark):
    four = ["in;1;0;true;true;true;50;400;420;30;20;30", "we;0;2;true;true;true;50;400;20;30;-380;30", "no;0;3;true;true;true;50;400;20;30;20;430", "so;0;4;true;true;true;50;400;20;30;20;-370"]
    got = {(r.from_edge, r.to_edge): r.delay for r in network.crossing_delays(net(spark, four)).collect()}
    assert [got["in", x] for x in ("so", "we", "no")] == [0, 10, 20]
    assert [got["opp_no", x] for x in ("opp_in", "so", "we")] == [0, 10, 20]
    assert [got["opp_we", x] for x in ("no", "opp_in", "so")] == [0, 10, 20]
    assert got["in", "opp_in"] == 10


def test_dead_ends_and_chains(spark):
    roads = [(0, 1, 320, "0;0;320;0"), (1, 2, 380, "320;0;700;0"), (1, 3, 90, "320;0;320;90"), (3, 4, 110, "320;90;320;200"), (4, 5, 100, "320;200;320;300")]
    t = [f"e{i};{a};{b};true;true;true;50;{n};{xy}" for i, (a, b, n, xy) in enumerate(roads)]
    back = [f"f{i};{b};{a};true;true;true;50;{n};{';'.join([*xy.split(';')[2:], *xy.split(';')[:2]])}" for i, (a, b, n, xy) in enumerate(roads)]
    e = net(spark, t + back)
    used = mapped(layer(spark, "1;50;-5", "2;600;5"), e)
    assert {r.edge_id for r in network.without_dead_ends(e, used).collect()} == {"e0", "f0", "e1", "f1"}
    assert network.without_dead_ends(e, used.where("false")).count() == 0
    joined = sorted((r.edge_id, r.length, r.parts) for r in network.join_similar(e).collect())
    assert joined == [("e0", 320, 1), ("e1", 380, 1), ("e2", 300, 3), ("f0", 320, 1), ("f1", 380, 1), ("f4", 300, 3)]


def peeled(edges, held):
    """Edges left when dead ends are taken away one round after the other."""
    now = dict(edges)
    while True:
        dead = {e for e, (_, b, o) in now.items() if e not in held and not any(x[0] == b and n != o for n, x in now.items())}
        gone = dead | {now[e][2] for e in dead}
        if not dead:
            return set(now)
        now = {e: x for e, x in now.items() if e not in gone}


def test_dead_ends_equal_peeling(spark):
    rng = random.Random(5)
    for _ in range(3):
        edges = {}
        for i in range(60):
            a, b = rng.randrange(55), rng.randrange(55)
            both = rng.random() < 0.8
            edges[f"a{i}"] = (a, b, f"b{i}" if both else None)
            if both:
                edges[f"b{i}"] = (b, a, f"a{i}")
        used = rng.sample(sorted(edges), 5)
        held = set(used) | {e for e, x in edges.items() if x[2] in used}
        df = spark.createDataFrame([(e, *x) for e, x in edges.items()], "edge_id string, from_node bigint, to_node bigint, opposite_id string")
        got = network.without_dead_ends(df, spark.createDataFrame([(u,) for u in used], "edge_id string"))
        assert {r.edge_id for r in got.collect()} == peeled(edges, held)


def test_subnets_follow_the_direction_of_edges(spark):
    rows = [("a", 1, 2), ("b", 1, 3), ("c", 5, 6), ("d", 6, 7), ("e", 8, 7), ("f", 9, 9)]
    edges = spark.createDataFrame(rows, "edge_id string, from_node bigint, to_node bigint")
    got = {r.edge_id: (r.cell_id, r.cell_size) for r in network.subnets(edges).collect()}
    assert got == {"c": (0, 2), "d": (0, 2), "a": (1, 1), "b": (2, 1), "e": (3, 1), "f": (4, 1)}


def test_network_errors_and_duplicates(spark):
    rows = ["1;0;1;1;1;1;50;0;0;0;9;0", "2;1;2;1;1;1;0;5;0;0;9;0", "3;2;3;1;0;0;50;5;0;0;9;0", "3;2;3;0;1;0;80;5;0;0;9;0.1"]
    e = text.net_csv(lines(spark, *rows))[0]
    assert sorted((r.description, r.edge1) for r in network.net_errors(e).collect()) == [("duplicate id", "3"), ("length<=0", "1"), ("speed<=0", "2")]
    assert network.net_errors(network.patched(e)).count() == 1
    two = text.net_csv(lines(spark, rows[2], rows[3].replace("3;2", "4;2", 1)))[0]
    merged, gone = network.merge_duplicates(two)
    assert [tuple(r) for r in gone.collect()] == [("3", "4")]
    assert {r.edge_id: r.modes for r in merged.collect()}["3"] == M.FOOT.bit | M.BIKE.bit


def test_broken_lines_are_reported(spark):
    good, errors = text.layer_csv(lines(spark, "# note", "", "1;2;3", "x;1;2", "2;1", "3;1;z", "4;0;0;4;0;4;4;7", "5;1;2;q", "6;1;1", "6;2;2"))
    assert [(r.object_id, r.var, r.geom_type) for r in good.orderBy("object_id").collect()] == [(1, 1.0, "POINT"), (4, 7.0, "POLYGON")]
    assert sorted(r.problem for r in errors.collect()) == ["bad geometry", "bad id", "bad value", "duplicate id", "duplicate id", "no geometry"]
    with pytest.raises(ValueError):
        text.strict(good, errors)
    assert text.escorts(lines(spark, "pt;400;bike", "pt;400;foot", "pt;2;xxx"))[0].collect()[0].modes == 6
    assert [text.source_format(s) for s in ("a.csv", "wkt;x", "file;y.net.xml", "jdbc:postgresql:h,t,u,p", "db;jdbc:x,t,u,p")] == ["csv", "wkt", "sumo", "postgres", "postgres"]
    assert M.mode_bits("foot;bicycle,car") == 14


def test_geometry(spark):
    one = spark.range(1).withColumn("l", G.line(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)))
    p = G.point(F.lit(12.0), F.lit(5.0))
    r = one.select(G.length(F.col("l")).alias("n"), G.nearest_on(F.col("l"), p).alias("at"), G.part(F.col("l"), F.lit(5.0), F.lit(12.0)).alias("part"), G.point_at(F.col("l"), F.lit(99.0)).alias("end"), G.to_wkt(F.col("l")).alias("wkt")).first()
    assert (r.n, r.at.dist, r.at.pos, r.at.side < 0) == (20.0, 2.0, 15.0, True)
    assert [(q.x, q.y) for q in r.part] == [(5, 0), (10, 0), (10, 2)] and (r.end.x, r.end.y) == (10, 10)
    square = one.select(G.parse_wkt(F.lit("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")).alias("g")).select(F.col("g.rings")[0].alias("r"), "g.kind")
    s = square.select(G.signed_area(F.col("r")).alias("a"), G.centroid(F.col("r"), F.col("kind")).alias("c"), G.inside(F.col("r"), F.lit(1.0), F.lit(3.9)).alias("i"), G.inside(F.col("r"), F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (s.a, s.c.x, s.c.y, s.i, s.o) == (16.0, 2.0, 2.0, True, False)
    # On the central meridian northing is the arc of the meridian times 0.9996.
    east, north = G.utm(F.lit(45.0), F.lit(15.0), 33)
    u = one.select(east.alias("e"), north.alias("n")).first()
    assert abs(u.e - 500000) < 1e-3 and abs(u.n - 0.9996 * 4984944.378) < 1e-2


def test_timetable(spark):
    calendar = spark.createDataFrame([("a", "20240101", "20241231", *"1000000"), ("b", "20240101", "20241231", *"0111111"), ("c", "20250101", "20251231", *"1111111")], ["service_id", "start_date", "end_date", *gtfs.WEEKDAYS])
    changes = spark.createDataFrame([("c", "20240205", "1"), ("a", "20240205", "2")], ["service_id", "date", "exception_type"])
    ids = lambda df: sorted(r.service_id for r in df.collect())
    assert ids(gtfs.services(calendar, None, 20240205)) == ["a"] and ids(gtfs.services(calendar, changes, 20240205)) == ["c"]
    assert ids(gtfs.services(calendar, None, 20240205, compat=True)) == ["b"]
    trips = {"a": [(100, 200), (200, 200), (200, 250), (300, 400)], "b": [(100, 100)], "c": [(100, 100), (160, 200)], "d": [(0, 50), (50, 50), (50, 100)], "e": [(0, 9), (12, 20)]}
    rows = [(t, "r", f"s{i}", f"s{i + 1}", i, *h) for t, hops in trips.items() for i, h in enumerate(hops)]
    got = {}
    for r in gtfs.repaired(spark.createDataFrame(rows, "trip_id string, route_id string, from_stop string, to_stop string, place bigint, dep int, arr int")).orderBy("place").collect():
        got.setdefault(r.trip_id, []).append((r.dep, r.arr))
    assert got == {"a": [(100, 150), (150, 200), (200, 250), (300, 400)], "b": [(85, 115)], "c": [(100, 150), (150, 200)], "d": [(0, 33), (33, 66), (66, 99)], "e": [(0, 9), (12, 20)]}


STEP = "line string, is_pt boolean, trip string, tt double, ttt double, length double, kcal_h double, co2_km double, price_km double, share double, interchange double, departure double, node bigint"


def test_legs_of_a_ride(spark):
    ride = [("foot", False, None, 60.0, 60.0, 60.0, 280.0, 0.0, 0.0, 1.0, 0.0, None, 1), ("L1", True, "t1", 300.0, 240.0, 2000.0, 85.0, 75.0, 0.0, 1.0, 0.0, 100.0, 2), ("L1", True, "t1", 400.0, 100.0, 900.0, 85.0, 75.0, 0.0, 1.0, 0.0, 300.0, 3), ("L2", True, "t2", 700.0, 300.0, 3000.0, 85.0, 75.0, 0.0, 1.0, 20.0, 450.0, 4), ("foot", False, None, 740.0, 40.0, 40.0, 280.0, 0.0, 0.0, 0.5, 0.0, None, 5)]
    df = spark.createDataFrame([(ride,), (ride[:1],)], f"path array<struct<{STEP.replace(' ', ':').replace(',:', ',')}>>")
    got, walk = (r.l for r in df.select(measures.legs(F.col("path"), 0.0).alias("l")).collect())
    assert (got.access, got.egress, got.interchanges, got.num_rides, got.price) == (60.0, 20.0, 1.0, 2.0, M.FARE)
    assert (got.waiting, got.initial_waiting, got.pt_tt, got.interchange_time) == (40.0 + 50.0, 40.0, 640.0 - 90.0, 20.0)
    assert got.lines == ["L1", "L2", "foot"] and abs(got.co2 - 75 / 1000 * 5900) < 1e-9
    assert (walk.access, walk.egress, walk.num_rides, walk.price) == (0.0, 0.0, 0.0, 0.0)
    change = df.select(measures.interchanges(F.col("path")).alias("i")).first().i
    assert [(c.halt, c.line_from, c.line_to, c.tt) for c in change] == [(3, "L1", "L2", 20.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 50.0, 50.0, 1.0, 0.125)], "fid bigint, sid bigint, avg_distance double, avg_tt double, avg_num double, avg_value double")
    sinks.write(df, f"{tmp_path}/od.csv")
    assert [r.value for r in spark.read.text(f"{tmp_path}/od.csv").collect()] == ["1;2;50.00;50.00;1.00;0.13"]
    assert dict(sinks.shaped(df, "od").dtypes)["avg_tt"] == "float"
    with pytest.raises(ValueError, match="avg_kcal"):
        sinks.shaped(df, "ext_od")
    named = spark.createDataFrame([(1, "e", 2.0, 3.0, "x")], "object_id bigint, edge_id string, pos double, dist double, conn string")
    assert sinks.shaped(named, "mapping").columns == sinks.RELATIONS["mapping"]
    assert sinks.shaped(spark.createDataFrame([("length<=0", "e")], "description string, edge1 string"), "net_errors").first().edge2 is None
    assert "secret" not in sinks.masked("--from db;jdbc:x,table,user,secret")


def test_components_write_few_times_their_links(spark, monkeypatch):
    from isomesh.operators import components as C
    from isomesh.operators.state import settled

    written = []

    def counted(df, tag):
        out = settled(df, tag)
        written.append(out.count())
        return out

    monkeypatch.setattr(C, "settled", counted)
    n = 300
    path = [(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)] + [(1000, 1001), (1002, 1002), (5, 5)]
    found = dict(map(tuple, C.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()))
    assert found == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000, 1002: 1002}
    assert sum(written) < 8 * n


@pytest.mark.parametrize("few", [0, 40, 200_000])
def test_components_take_few_rounds_for_few_links(spark, monkeypatch, few):
    from isomesh.operators import components as C
    from isomesh.operators.state import settled

    tables = []
    monkeypatch.setattr(C, "FEW", few, raising=False)
    monkeypatch.setattr(C, "settled", lambda df, tag: tables.append(tag) or settled(df, tag))
    rng = random.Random(22)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(500, 500)] + [(600, n) for n in range(601, 640)]
    least = {n: n for p in pairs for n in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    found = C.components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == sorted(least.items())
    # The links, where they go, and back.
    assert few < 200_000 or len(tables) == 3
    names = [(f"n{a}", f"n{b}") for a, b in pairs]
    named = C.components(spark.createDataFrame(names, "a string, b string")).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in named) == sorted(list(least.values()).count(x) for x in set(least.values()))


def test_subnets_work_the_network_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("a", 1, 2), ("b", 2, 3), ("c", 3, 1), ("d", 4, 2), ("e", 8, 9), ("f", None, 9), ("g", 2, None), ("h", 8, None), ("i", 5, 6), ("j", 6, 7)]
    made = spark.sparkContext.parallelize(rows).map(lambda r: seen.add(1) or r)
    got = {r.edge_id: (r.cell_id, r.cell_size) for r in network.subnets(spark.createDataFrame(made, "edge_id string, from_node bigint, to_node bigint")).collect()}
    assert got == {e: (0, 5) for e in "abcdg"} | {"i": (1, 2), "j": (1, 2), "e": (2, 1), "f": (3, 1), "h": (4, 1)}
    assert seen.value == len(rows)


def test_lines_of_geometry_are_dealt_out(spark):
    rows = spark.range(1).selectExpr("'1;POLYGON((0 0, 2 0, 2 4, 0 4, 0 0))' AS value")
    edge = spark.range(1).selectExpr("'e;1;2;1;1;1;36;100;0;0;60;80' AS value")
    for good in (text.layer_wkt(rows)[0], text.net_csv(edge)[0]):
        plan = good._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 2, true" in plan and "explode" in plan and good.count() == 1
