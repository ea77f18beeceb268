"""Result relations of whole computations: aggregated, by type, in order, on joined edges."""

import pytest

from isomesh import app
from isomesh.operators import aggregate, sinks


@pytest.fixture(scope="module")
def given(tmp_path_factory):
    """Four edges there and back on a line, two origins and three destinations, of which one can't be reached in time."""
    at = tmp_path_factory.mktemp("line")
    rows = []
    for i in range(4):
        x, y = 100 * i, 100 * i + 100
        rows += [f"f{i};{i};{i + 1};true;true;true;50;100;{x};0;{y};0", f"b{i};{i + 1};{i};true;true;true;50;100;{y};0;{x};0"]
    (at / "net.csv").write_text("\n".join(rows) + "\n")
    (at / "from.csv").write_text("2;50;-5;3\n1;10;-5;1\n")
    (at / "to.csv").write_text("9;60;-5;2\n7;150;-5;4\n8;390;-5;5\n")
    (at / "types.csv").write_text("7;shop\n9;shop\n9;park\n8;zoo\n")
    (at / "areas.csv").write_text("100;0;-10;200;-10;200;10;0;10\n200;200;-10;400;-10;400;10;200;10\n")
    return {"from": f"{at}/from.csv", "to": f"{at}/to.csv", "net": f"{at}/net.csv", "mode": "foot", "epsg": "0", "time": "0", "max-tt": "200", "foot.vmax": "3.6", "weight": "weight", "variable": "var"}, at


@pytest.fixture(scope="module")
def plain(spark, given):
    """What is found without aggregation."""
    return app.compute(spark, given[0] | {"od-output": "x"})["od-output"]


def rows(df, *names):
    return sorted(tuple(round(r[n], 3) if isinstance(r[n], float) else r[n] for n in names) for r in df.collect())


def test_frames_of_aggregated_results(spark, given):
    options, at = given
    out = app.compute(spark, options | {"to-agg": f"{at}/areas.csv", "od-output": "x", "ext-od-output": "x", "stat-od-output": "x", "edges-output": "x"})
    # From 1 at 10 m: 50 m and 140 m; from 2 at 50 m: 10 m and 100 m; 8 is too far for both.
    assert rows(out["od-output"], "fid", "sid", "avg_distance", "avg_num", "avg_value") == [(1, 100, 95.0, 2.0, 6.0), (1, 200, 0.0, 0.0, 0.0), (2, 100, 55.0, 2.0, 6.0), (2, 200, 0.0, 0.0, 0.0)]
    assert [(r.fid, r.sid, r.modes) for r in out["ext-od-output"].orderBy("fid", "sid").collect()] == [(1, 100, ["foot"]), (1, 200, []), (2, 100, ["foot"]), (2, 200, [])]
    assert rows(out["stat-od-output"], "fid", "sid", "num", "min_distance", "max_distance") == [(1, 100, 2, 50.0, 140.0), (2, 100, 2, 10.0, 100.0)]


def test_results_by_type(spark, given):
    options, at = given
    out = app.compute(spark, options | {"to-types": f"{at}/types.csv", "from-agg": "all", "to-agg": "all", "od-output": "x", "stat-od-output": "x", "edges-output": "x", "pt-output": "x"})
    # Means by the weights 1 and 3; of all weights, 4.
    want = {"park": (20.0, 1.0, 2.0), "shop": ((50 + 140 + 3 * 110) / 8, 2.0, 6.0), "zoo": (0.0, 0.0, 0.0)}
    assert rows(out["od-output"], "dest_type", "fid", "sid", "avg_distance", "avg_num", "avg_value") == [(k, -1, -1, *v) for k, v in sorted(want.items())]
    assert rows(out["stat-od-output"], "dest_type", "num", "med_distance") == [("park", 2, 50.0), ("shop", 4, 100.0)]
    assert rows(out["edges-output"], "dest_type", "eid", "num") == [("park", "f0", 8.0), ("shop", "f0", 24.0), ("shop", "f1", 16.0)]
    assert rows(out["pt-output"], "dest_type", "avg_num") == [("park", 1.0), ("shop", 2.0), ("zoo", 0.0)]


def test_the_nearest_of_areas_are_not_told_apart(spark, given):
    options, at = given
    out = app.compute(spark, options | {"from-agg": f"{at}/areas.csv", "shortest": "true", "od-output": "x", "ext-od-output": "x", "edges-output": "x"})
    assert rows(out["od-output"], "fid", "sid", "avg_distance", "avg_num") == [(100, -1, 20.0, 1.0)]
    assert rows(out["ext-od-output"], "fid", "sid", "avg_distance") == [(100, -1, 20.0)] and rows(out["edges-output"], "fid", "sid", "eid") == [(100, -1, "f0")]


def test_lines_of_text_are_in_order(plain, tmp_path):
    target = tmp_path / "od.csv"
    sinks.write(plain, str(target), 1)
    lines = [line for f in sorted(target.glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["1;7;140.0;140.0;1.0;4.0", "1;9;50.0;50.0;1.0;2.0", "2;7;100.0;100.0;1.0;4.0", "2;9;10.0;10.0;1.0;2.0"]


def test_joined_edges_change_no_way(spark, given, plain):
    options, _ = given
    joined = app.compute(spark, options | {"od-output": "x", "destinations-to-road-output": "x", "prunning.join-similar": "true"})
    what = ("fid", "sid", "avg_distance", "avg_tt", "avg_value")
    assert rows(joined["od-output"], *what) == rows(plain, *what)
    assert rows(joined["destinations-to-road-output"], "id", "rid", "rpos") == [(7, "f0", 150.0), (8, "f0", 390.0), (9, "f0", 60.0)]
    with pytest.raises(ValueError, match="one mode"):
        app.compute(spark, options | {"mode": "foot;car", "od-output": "x", "prunning.join-similar": "true"})


def test_empty_frames(spark):
    measures = spark.createDataFrame([], "fid bigint, sid bigint, avg_num double, modes array<string>, num bigint")
    objects, areas = spark.createDataFrame([(1,), (2,)], "object_id bigint"), spark.createDataFrame([(1, 5)], "object_id bigint, area_id bigint")
    got = aggregate.framed(measures, objects, objects, areas, "all")
    assert sorted(map(tuple, got.collect())) == [(-1, -1, 0.0, [], 0), (5, -1, 0.0, [], 0)] and got.dtypes == measures.dtypes
    assert aggregate.framed(measures, objects, objects).count() == 0
