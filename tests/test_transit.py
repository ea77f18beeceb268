"""Ways over several modes and rides, and whole computations from files, against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from isomesh import app
from isomesh.functions import modes as M
from isomesh.functions.geom import POINTS
from isomesh.operators import transit

ROADS = f"edge_id string, opposite_id string, from_node string, to_node string, modes bigint, vmax double, length double, geom {POINTS}"
START = "origin bigint, node string, mode int, tt double, dist double, edge string"


def one(df, **key):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in key.items())]
    assert len(rows) == 1, rows
    return rows[0]


@pytest.fixture(scope="module")
def town(spark):
    line = [(0.0, 0.0), (100.0, 0.0)]
    roads = spark.createDataFrame([("xy", None, "x", "y", 14, 20.0, 100.0, line), ("xs", None, "x", "stop S1", 2, 1.0, 10.0, line)], ROADS)
    rides = spark.createDataFrame([("e1", "stop S1", "stop S2", 2, 22.0, 500.0, "L1"), ("e2", "stop S2", "stop S3", 2, 22.0, 400.0, "L2"), ("e3", "stop S1", "stop S3", 2, 22.0, 800.0, "L3")], "edge_id string, from_node string, to_node string, modes bigint, vmax double, length double, line string")
    hops = spark.createDataFrame([("e1", 100, 200, "A"), ("e1", 90, 210, "slow"), ("e1", 3, 5, "gone"), ("e2", 205, 300, "B"), ("e2", 4000, 4100, "late"), ("e3", 100, 350, "C")], "edge_id string, dep int, arr int, trip_id string")
    waits = spark.createDataFrame([("S2", "A", "B", 20), ("S2", "B", "A", 99)], "stop_id string, from_trip string, to_trip string, seconds int")
    start = spark.createDataFrame([(1, "x", 2, 0.0, 0.0, "in")], START)
    return roads, rides, hops, waits, start


def test_rides_transfers_and_measures(spark, town):
    roads, rides, hops, waits, start = town
    by = lambda measure, *p: transit.search(start, roads, [M.FOOT], 5000.0, rides, hops, waits, None, None, None, 0.0, measure, *p).cache()
    quick = by("tt")
    at = one(quick, node="stop S3")
    assert (at.tt, at.dist, at.interchanges, at.price, at.line, at.interchange) == (320.0, 910.0, 2, 95.0, "L2", 20.0)
    assert one(quick, node="stop S2").trip == "A"
    few = one(by("maxinterchanges_tt", 1.0), node="stop S3")
    assert (few.tt, few.interchanges, few.line) == (350.0, 1, "L3")
    assert one(by("interchanges_tt", 1.0, 20.0), node="stop S3").line == "L3"
    od = spark.createDataFrame([(1, 9, 320.0, 910.0, "stop S3", 2, "z", 0.0, 0.0, 3.0, 2.0)], "origin bigint, destination bigint, tt double, dist double, node string, mode int, end_edge string, run double, ride double, value double, weight double")
    way = transit.steps(quick, od).cache()
    assert [(r.edge, r.trip, r.wait) for r in way.orderBy("idx").collect()] == [("in", None, 0.0), ("xs", None, 0.0), ("e1", "A", 90.0), ("e2", "B", 5.0), ("z", None, 0.0)]
    counts = transit.interchange_counts(od, way, rides).collect()
    assert [(r.halt, r.line_from, r.line_to, r.num, r.tt) for r in counts] == [("S2", "L1", "L2", 1, 20.0)]
    legs = one(transit.legs(way))
    assert (legs.access_tt, legs.pt_tt, legs.waiting_time, legs.init_waiting_time, legs.num_interchanges) == (10.0, 215.0, 95.0, 90.0, 1.0)


def test_change_of_mode_and_speeds_by_time(spark, town):
    roads, _, _, _, start = town
    changes = spark.createDataFrame([(1, 2, 4, 5.0, 7.0)], "node_id bigint, from_mode int, to_mode int, duration double, price double").withColumn("node_id", F.lit("x"))
    ride = 100 / M.BIKE.vmax
    for compat, extra in ((False, 5.0), (True, 0.0)):
        labels = transit.search(start, roads, [M.FOOT, M.BIKE], 5000.0, changes=changes, compat=compat)
        assert one(labels, node="y", mode=4).tt == pytest.approx(extra + ride) and one(labels, node="y", mode=2).tt == 100.0
    spells = spark.createDataFrame([("xy", 0.0, 50.0, 4.0)], "edge_id string, ibegin double, iend double, speed double")
    car = start.withColumn("mode", F.lit(8))
    for time, tt in ((0.0, 25.0), (60.0, 5.0)):
        assert one(transit.search(car, roads, [M.CAR], 5000.0, speeds=spells, time=time), node="y").tt == tt
    with pytest.raises(ValueError):
        transit.search(start, roads, [M.FOOT], 1.0, measure="beauty")


def test_a_computation_from_files(spark, tmp_path):
    (tmp_path / "net.csv").write_text("a;1;2;true;true;true;50;1000;0;0;1000;0\nb;2;1;true;true;true;50;1000;1000;0;0;0\n")
    (tmp_path / "from.csv").write_text("1;50;-5;4\n")
    (tmp_path / "to.csv").write_text("7;950;-5;3\n")
    feed = tmp_path / "feed"
    feed.mkdir()
    for name, text in {
        "stops": "stop_id,stop_lat,stop_lon\nS1,10,100\nS2,10,900\n", "routes": "route_id,route_short_name,route_type\nR1,One,3\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nw,1,1,1,1,1,1,1,20240101,20241231\n",
        "trips": "route_id,service_id,trip_id\nR1,w,t1\n", "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,8:01:40,8:01:40,S1,1\nt1,8:03:20,8:03:20,S2,2\n",
    }.items():
        (feed / f"{name}.txt").write_text(text)
    outputs = ("od", "ext-od", "pt", "interchanges", "edges", "direct", "process")
    given = {"from": f"{tmp_path}/from.csv", "to": f"{tmp_path}/to.csv", "net": f"{tmp_path}/net.csv", "mode": "foot", "epsg": "0", "time": "28800", "pt": str(feed), "date": "20240205", "max-tt": "3600", "requirespt": "true"}
    app.write_options(str(tmp_path / "options.xml"), given | {f"{o}-output": str(tmp_path / f"{o}.csv") for o in outputs})
    results = app.compute(spark, {"config": str(tmp_path / "options.xml")})
    assert set(results) == {f"{o}-output" for o in outputs}
    near = lambda row, want: [round(float(x), 3) for x in row] == want
    assert near(one(results["od-output"]), [1, 7, 920.0, 260.0, 1.0, 3.0])
    assert near(one(results["pt-output"]), [1, 7, 920, 260, 60, 60, 60, 60, 0, 0, 800, 100, 0, 40, 40, 1, 3])
    ext = one(results["ext-od-output"])
    assert (ext.modes, ext.avg_price, ext.avg_co2, ext.beeline_distance) == (["R1", "foot"], 95.0, 60.0, 900.0) and ext.avg_kcal == pytest.approx(280 * 120 / 3600 + 85 * 140 / 3600, abs=1e-4)
    assert results["interchanges-output"].count() == 0 and results["edges-output"].count() == 5 == results["direct-output"].count()
    with pytest.raises(ValueError, match="needed"):
        app.compute(spark, {"from": "x.csv"})
    with pytest.raises(ValueError, match="unknown option"):
        app.options_of({"form": "x"})


@pytest.fixture(scope="module")
def street(spark):
    """One road there and back, and a side road that leads back to its begin; 900 m of it lie between the objects."""
    roads = spark.createDataFrame([("ab", "ba", "a", "b", 14, 20.0, 1000.0, [(0.0, 0.0), (1000.0, 0.0)]), ("ba", "ab", "b", "a", 14, 20.0, 1000.0, [(1000.0, 0.0), (0.0, 0.0)]), ("bc", None, "b", "c", 14, 10.0, 400.0, [(1000.0, 0.0), (1000.0, 400.0)])], ROADS)
    at = "object_id bigint, edge_id string, pos double"
    return roads, spark.createDataFrame([(1, "ab", 50.0)], at), spark.createDataFrame([(7, "ab", 950.0), (8, "bc", 100.0)], at)


def od_of(street, time=0.0, speeds=None, delays=None, modes=(M.CAR,)):
    roads, o, d = street
    labels = transit.search(transit.starts(o, roads, list(modes), speeds, time), roads, list(modes), 5000.0, delays=delays, speeds=speeds, time=time)
    return {r.destination: r for r in transit.od_values(labels, o, d, roads, list(modes), 5000.0, speeds=speeds, delays=delays, time=time).collect()}


def test_measured_speeds_hold_on_first_and_last_edges(spark, street):
    speeds = spark.createDataFrame([("ab", 0.0, 86400.0, 5.0), ("bc", 0.0, 100.0, 2.0), ("bc", 100.0, 86400.0, 4.0)], "edge_id string, ibegin double, iend double, speed double")
    plain, slow = od_of(street), od_of(street, speeds=speeds)
    assert plain[7].tt == pytest.approx(45.0) and slow[7].tt == pytest.approx(180.0)
    # 950 m at 5 m/s; then the last edge is entered at 190 s and passed at 4 m/s.
    assert plain[8].tt == pytest.approx(57.5) and slow[8].tt == pytest.approx(190.0 + 25.0) and slow[8].ride == pytest.approx(25.0)
    assert od_of(street, time=90000.0, speeds=speeds)[8].tt == pytest.approx(57.5)


def test_a_turn_onto_the_last_edge_takes_its_share(spark, street):
    delays = spark.createDataFrame([("ab", "bc", 8.0), ("bc", "ab", 99.0)], "from_edge string, to_edge string, delay double")
    assert od_of(street, delays=delays)[8].tt == pytest.approx(57.5 + 8.0 * 100 / 400)


def test_negative_prices_are_refused(spark, street):
    roads, o, _ = street
    mode = M.custom(10.0)
    begin = transit.starts(o, roads.withColumn("modes", F.lit(1).cast("bigint")), [mode])
    with pytest.raises(ValueError, match="price"):
        transit.search(begin, roads, [mode], 60.0, measure="price_tt")
    priced = transit.search(begin, roads.withColumn("modes", F.lit(1).cast("bigint")), [M.custom(10.0, price=30.0)], 500.0, measure="price_tt")
    assert one(priced, node="b").price == pytest.approx(0.03 * 950)
    changes = spark.createDataFrame([("b", 8, 2, 1.0, -1.0)], "node_id string, from_mode int, to_mode int, duration double, price double")
    with pytest.raises(ValueError, match="price"):
        transit.search(transit.starts(o, roads, [M.CAR]), roads, [M.CAR, M.FOOT], 60.0, changes=changes, measure="price_tt")


def test_grades_have_no_effect_on_speeds(spark, street):
    roads, o, _ = street
    steep = roads.withColumn("incline", F.lit(9.0))
    tt = lambda net: sorted(r.tt for r in transit.search(transit.starts(o, net, [M.BIKE]), net, [M.BIKE], 5000.0).collect())
    assert tt(steep) == tt(roads)


def test_searches_over_modes_end_early(spark, street):
    from isomesh.operators.ways import Enough

    roads, o, d = street
    bounds, arrive = transit.ending(Enough(1), o, d, roads, [M.FOOT, M.CAR])
    some = transit.search(transit.starts(o, roads, [M.FOOT, M.CAR]), roads, [M.FOOT, M.CAR], float("inf"), bounds=bounds, arrive=arrive)
    assert some.where("node = 'c'").count() == 0 and transit.search(transit.starts(o, roads, [M.CAR]), roads, [M.CAR], float("inf")).where("node = 'c'").count() == 1
    od = transit.od_values(some, o, d, roads, [M.FOOT, M.CAR], float("inf")).where("destination = 7").first()
    assert od.tt == pytest.approx(45.0)
    with pytest.raises(ValueError, match="early"):
        transit.search(transit.starts(o, roads, [M.CAR]), roads, [M.CAR], 9.0, measure="price_tt", bounds=bounds, arrive=arrive)


def test_broken_networks_are_refused_and_their_errors_written(spark, tmp_path):
    (tmp_path / "net.csv").write_text("a;1;2;true;true;true;0;1000;0;0;1000;0\nb;2;1;true;true;true;50;1000;1000;0;0;0\nc;2;3;true;true;true;0;10;1000;0;1010;0\n")
    (tmp_path / "from.csv").write_text("1;50;-5;4\n")
    (tmp_path / "to.csv").write_text("7;950;-5;3\n")
    given = {"from": f"{tmp_path}/from.csv", "to": f"{tmp_path}/to.csv", "net": f"{tmp_path}/net.csv", "mode": "foot", "epsg": "0", "time": "0", "od-output": f"{tmp_path}/od.csv", "net-errors-output": f"{tmp_path}/errors.csv"}
    with pytest.raises(app.NetworkError, match="speed<=0: a and 1 more"):
        app.run(spark, given)
    assert any(tmp_path.glob("errors.csv*"))
    with pytest.raises(app.NetworkError, match="speed<=0: a; speed<=0: c"):
        app.compute(spark, given | {"net.report-all-errors": "true"})


def test_an_unknown_projection_is_an_error(spark, tmp_path):
    from isomesh.sources import gtfs

    stops = spark.createDataFrame([("S", "52.0", "13.0")], "stop_id string, stop_lat string, stop_lon string")
    with pytest.raises(ValueError, match="2056"):
        gtfs.stops(stops, 2056)
    r = gtfs.stops(stops, 32633).first()
    assert 300000 < r.x < 400000 and 5.7e6 < r.y < 5.8e6
    assert tuple(gtfs.stops(stops, 0).first()) == ("S", 13.0, 52.0)
    assert gtfs.stops(stops, 32633, lambda x, y: x > 4e5).count() == 0


def test_only_departures_in_time_are_kept(spark):
    hops = spark.createDataFrame([("e", 3599, 3700, "a"), ("e", 3600, 4200, "b"), ("e", 3700, 4201, "c"), ("f", 90000, 90100, "d")], "edge_id string, dep int, arr int, trip_id string")
    kept = transit.in_time(hops, 3600.0, 600.0)
    assert [r.trip_id for r in kept.collect()] == ["b"]
    assert [(r.d_edge, r.hour) for r in transit.departures(kept, 1).collect()] == [("e", 1)]
    # A transfer that takes less than no time brings a later arrival back within the bound.
    early = spark.createDataFrame([("s", "a", "c", -60)], "stop_id string, from_trip string, to_trip string, seconds int")
    assert [r.trip_id for r in transit.in_time(hops, 3600.0, 600.0, early).orderBy("dep").collect()] == ["b", "c"]
