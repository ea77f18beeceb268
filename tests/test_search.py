"""The bucketed search, its early end, and chains of predecessors, against plain heaps and walks."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from isomesh.operators import limits, routing, state, ways

EDGES = "edge_id string, from_node bigint, to_node bigint, length double, tt double, opposite_id string"
AT = "object_id bigint, edge_id string, pos double"


def roads(seed, nodes=40, n=70, slow=0.05):
    """Two-way and one-way edges of very different times, some far slower than the rest."""
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b = rng.sample(range(nodes), 2)
        length = float(rng.randint(5, 60))
        tt = length * rng.choice([0.25, 0.5, 1.0]) * (25 if rng.random() < slow else 1)
        both = rng.random() < 0.6
        out.append((f"e{i:03}", a, b, length, tt, f"r{i:03}" if both else None))
        if both:
            out.append((f"r{i:03}", b, a, length, tt * rng.choice([1, 2, 0.5]), f"e{i:03}"))
    return out


def placed(rows, seed, n):
    rng = random.Random(seed)
    return [(i, e[0], round(rng.uniform(0.1, 0.9) * e[3], 3)) for i, e in enumerate(rng.choices(rows, k=n))]


def heap(rows, first, max_tt=math.inf):
    """node -> (tt, dist, edge, before): the least of all offers."""
    out, best, queue = {}, {}, []
    for e, a, b, length, tt, _ in rows:
        out.setdefault(a, []).append((b, e, length, tt))

    def offer(node, label):
        if label[0] <= max_tt and (node not in best or label < best[node]):
            best[node] = label
            heapq.heappush(queue, (*label[:2], node))

    for node, tt, dist, edge in first:
        offer(node, (tt, dist, edge, -1))
    while queue:
        tt, dist, node = heapq.heappop(queue)
        if best[node][:2] == (tt, dist):
            for b, e, length, took in out.get(node, ()):
                offer(b, (tt + took, dist + length, e, node))
    return best


@pytest.mark.parametrize("seed,max_tt", [(1, math.inf), (2, 90.0), (3, math.inf)])
def test_search_equals_a_heap(spark, seed, max_tt):
    rows = roads(seed, slow=0.0 if seed == 3 else 0.05)
    e, o = spark.createDataFrame(rows, EDGES), spark.createDataFrame(placed(rows, seed, 5), AT)
    start = routing.starts(o, e)
    got = {(r.origin, r.node): (r.tt, r.dist, r.edge, -1 if r.before is None else r.before) for r in routing.search(start, e, max_tt).collect()}
    first = {}
    for r in start.collect():
        first.setdefault(r.origin, []).append((r.node, r.tt, r.dist, r.first))
    expected = {(origin, node): x for origin, f in first.items() for node, x in heap(rows, f, max_tt).items()}
    assert got == expected and len(got) > 20


def test_no_label_is_written_twice_but_within_a_bucket(spark, monkeypatch):
    rows = roads(5, slow=0.0)
    e, o = spark.createDataFrame(rows, EDGES), spark.createDataFrame(placed(rows, 5, 8), AT)
    written = {}
    put = state.Shelf.put

    def counted(self, number, df):
        out = put(self, number, df)
        kind = self.path.rsplit("/", 1)[1].split("-")[0]
        written[kind] = written.get(kind, 0) + out.count()
        return out

    monkeypatch.setattr(state.Shelf, "put", counted)
    labels = routing.search(routing.starts(o, e), e)
    n = labels.count()
    assert written.get("labels", 0) <= n and labels.select("origin", "node").distinct().count() == n
    # Offers within a bucket correct each other a few times at most; the search before wrote all labels in all rounds.
    assert n <= written["bucket"] <= 2 * n


def complete(spark, rows, o, d, values):
    e = spark.createDataFrame(rows, EDGES)
    od = routing.od_values(routing.search(routing.starts(o, e), e), o, d, e, math.inf)
    return e, od.join(values, "destination")


@pytest.mark.parametrize("seed", [7])
def test_an_early_end_changes_no_result(spark, seed):
    rows = roads(seed, nodes=60, n=110, slow=0.02)
    o, d = spark.createDataFrame(placed(rows, seed, 6), AT), spark.createDataFrame(placed(rows, seed + 50, 30), AT)
    values = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "destination bigint, value double")
    types = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)] + [(4, "b"), (6, "b")], "destination bigint, type string")
    e, od = complete(spark, rows, o, d, values)
    od = od.cache()
    every = routing.search(routing.starts(o, e), e).count()
    key = lambda df: sorted((r.origin, r.destination, round(r.tt, 6), round(r.dist, 6)) for r in df.collect())
    typed = lambda df: df.join(types, "destination")
    for enough, limit in (
        (ways.Enough(1), limits.nearest), (ways.Enough(None, 5.0, values), lambda df: limits.until_value(df, 5.0)),
        (ways.Enough(2, types=types), lambda df: limits.first_n(typed(df), 2, ["type"])),
    ):
        labels = routing.search_until(enough, o, d, e)
        found = routing.od_values(labels, o, d, e, math.inf).join(values, "destination")
        n = labels.count()
        assert key(limit(found)) == key(limit(od)) and n <= every and (n < every or enough.number != 1)


def test_negative_values_bound_nothing(spark):
    values = spark.createDataFrame([(1, -1.0)], "destination bigint, value double")
    with pytest.raises(ValueError):
        ways.Bounds(ways.Enough(None, 1.0, values), values.selectExpr("1L origin", "destination", "1e0 tt"))


def test_empty_tables_of_the_search(spark):
    e, none = spark.createDataFrame([], EDGES), spark.createDataFrame([], AT)
    assert routing.search(routing.starts(none, e), e).count() == 0
    assert routing.search_until(ways.Enough(1), none, none, e).count() == 0
    assert routing.paths(routing.search(routing.starts(none, e), e), spark.createDataFrame([], "origin bigint, node bigint")).count() == 0


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    n = 5000
    labels = spark.range(n).select(F.lit(1).cast("bigint").alias("origin"), F.col("id").alias("node"), F.col("id").cast("double").alias("tt"), F.concat(F.lit("e"), "id").alias("edge"), F.when(F.col("id") > 0, F.col("id") - 1).alias("before"))
    goals = spark.createDataFrame([(1, n - 1), (1, 10), (1, 0), (1, n + 5), (2, 3)], "origin bigint, node bigint")
    rounds, plans = [], []

    def watched(df, tag):
        if tag == "chain":
            rounds.append(1)
            plans.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return state.settled(df, tag)

    monkeypatch.setattr(ways, "settled", watched)
    got = routing.paths(labels, goals).collect()
    assert sorted((r.goal, r.idx, r.node, r.edge) for r in got) == sorted((g, i, i, f"e{i}") for g in (n - 1, 10, 0) for i in range(g + 1))
    assert len(rounds) <= 15 and max(plans[2:]) <= 1.1 * plans[2]


def test_objects_at_one_place_share_a_search(spark):
    edges = spark.createDataFrame([("a", 1, 2, 10.0, 10.0, "b"), ("b", 2, 1, 10.0, 10.0, "a"), ("c", 2, 3, 10.0, 10.0, "d"), ("d", 3, 2, 10.0, 10.0, "c")], "edge_id string, from_node bigint, to_node bigint, length double, tt double, opposite_id string")
    o = spark.createDataFrame([(i, "a", 4.0) for i in range(20)] + [(30, "a", 6.0), (31, "c", 4.0)], "object_id bigint, edge_id string, pos double")
    d = spark.createDataFrame([(100, "c", 5.0), (101, "a", 1.0)], "object_id bigint, edge_id string, pos double")
    places, members = routing.places(o)
    assert sorted(r.object_id for r in places.collect()) == [0, 30, 31] and members.count() == 22
    labels = routing.search(routing.starts(places, edges), edges, 30.0)
    assert labels.select("origin").distinct().count() == 3
    alone = routing.od_values(routing.search(routing.starts(o, edges), edges, 30.0), o, d, edges, 30.0)
    shared = routing.for_all(routing.od_values(labels, places, d, edges, 30.0), members)
    assert shared.columns == alone.columns and sorted(shared.collect()) == sorted(alone.collect()) and alone.count() == 44


def test_nearest_of_types_equals_a_search_from_the_origins(spark):
    seed, max_tt = 7, 60.0
    rows = roads(seed, nodes=24, n=40, slow=0.0)
    alone = next(r for r in rows if r[5] is None)
    # On a one-way edge: 100 has 41 behind it, 101 has it ahead.
    o = spark.createDataFrame([*placed(rows, seed, 25), (100, alone[0], alone[3] * 0.7), (101, alone[0], alone[3] * 0.2)], AT)
    d = spark.createDataFrame([*placed(rows, seed + 50, 20), (40, *placed(rows, 1, 1)[0][1:]), (41, alone[0], alone[3] * 0.6)], AT)
    types = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(20)] + [(4, "a"), (6, "b"), (41, "d"), (41, "a"), (99, "e")], "destination bigint, type string")
    e = spark.createDataFrame(rows, EDGES)
    assert ("100", "41") in {(str(r.origin), str(r.destination)) for r in routing.along(o, d, e).where("behind").collect()}
    od = routing.od_values(routing.search(routing.starts(o, e), e, max_tt), o, d, e, max_tt).withColumn("tt", F.round("tt", 7)).join(types, "destination")
    key = lambda df: sorted((r.origin, r.type, r.destination, round(r.tt, 6)) for r in df.collect())
    got = key(routing.nearest_of_types(types, o, d, e, max_tt))
    assert got == key(limits.nearest(od, ["type"])) and len(got) > 20


def test_labels_of_nearest_of_types_grow_with_nodes_only(spark, monkeypatch):
    rows = [r for r in roads(9, nodes=16, n=30, slow=0.0) if r[5]]
    e, d = spark.createDataFrame(rows, EDGES), spark.createDataFrame(placed(rows, 3, 12), AT)
    types = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(12)], "destination bigint, type string")
    nodes = len({x for r in rows for x in r[1:3]})
    put, written = state.Shelf.put, {}

    def counted(self, number, df):
        out = put(self, number, df)
        written[self.path] = written.get(self.path, 0) + out.count()
        return out

    monkeypatch.setattr(state.Shelf, "put", counted)
    sums = []
    for n in (3, 60):
        written.clear()
        assert routing.nearest_of_types(types, spark.createDataFrame(placed(rows, 4, n), AT), d, e).count() <= 2 * n
        sums.append(sum(written.values()))
    assert sums[0] == sums[1] <= 2 * 2 * 2 * nodes


def test_equal_times_by_other_sums(spark):
    # 1 -> 2 -> 3 takes 0.1 + 0.2, which is more than 0.3 by rounding alone.
    e = spark.createDataFrame([("o", 0, 1, 1.0, 1.0, None), ("a", 1, 2, 1.0, 0.1, None), ("b", 2, 3, 1.0, 0.2, None), ("c", 1, 3, 1.0, 0.3, None), ("g", 3, 4, 1.0, 0.0, None), ("h", 2, 5, 1.0, 0.2, None)], EDGES)
    o = spark.createDataFrame([(1, "o", 1.0)], AT)
    types = spark.createDataFrame([(i, "t") for i in (5, 7)], "destination bigint, type string")
    for five, seven in (("h", "c"), ("c", "h")):
        d = spark.createDataFrame([(5, five, 1.0), (7, seven, 1.0)], AT)
        assert [(r.destination, round(r.tt, 9)) for r in routing.nearest_of_types(types, o, d, e).collect()] == [(5, 0.3)]
    none = spark.createDataFrame([], AT)
    assert routing.nearest_of_types(types, o, none, e).count() == routing.nearest_of_types(types, none, none, e).count() == 0
