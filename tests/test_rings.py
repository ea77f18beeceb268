"""Rings from ways: joins without a choice, and a search where ways branch."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isomesh.sources import osm, rings
from isomesh.sources.rings import crosses_itself, hull_centre, rings_of, searched

AT = {1: (0, 0), 2: (10, 0), 3: (10, 10), 4: (0, 10), 5: (20, 10), 6: (20, 0), 7: (5, 5), 8: (5, -5)}


def line(*nodes):
    return [(n, float(AT[n][0]), float(AT[n][1])) for n in nodes]


def sides(lines):
    return sorted(tuple(sorted((a[0], b[0]))) for one in lines for a, b in zip(one, one[1:], strict=False))


def nodes_of(ring):
    return frozenset(p[0] for p in ring)


def test_crossings():
    assert not crosses_itself(line(1, 2, 3, 4, 1)) and crosses_itself(line(1, 3, 2, 4, 1)) and crosses_itself(line(1, 2, 1)) and not crosses_itself(line(1, 2, 7, 3, 4, 1))
    # Against all pairs.
    rnd = random.Random(3)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for _ in range(200):
        p = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(rnd.randrange(3, 7))]
        p.append(p[0])
        s = list(zip(p, p[1:], strict=False))
        brute = any(turn(*s[i], s[j][0]) * turn(*s[i], s[j][1]) < 0 and turn(*s[j], s[i][0]) * turn(*s[j], s[i][1]) < 0 for i in range(len(s)) for j in range(i))
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in s)
        assert crosses_itself([(k, float(x), float(y)) for k, (x, y) in enumerate(p)]) == (brute or area == 0)


def test_ways_without_a_choice():
    closed, rest = rings_of([line(3, 4), line(2, 1), line(3, 2), line(1, 4), line(5, 6), line(7)])
    assert len(closed) == 1 and nodes_of(closed[0]) == {1, 2, 3, 4} and rest == [line(5, 6)]
    closed, rest = rings_of([line(1, 2, 3, 1)])
    assert closed == [line(1, 2, 3, 1)] and rest == [] and rings_of([]) == ([], [])
    # A ring of two ways, and a long one.
    assert [nodes_of(r) for r in rings_of([line(1, 2, 3), line(3, 4, 1)])[0]] == [{1, 2, 3, 4}]
    n = 3000
    AT.update({100 + i: (i, i * i) for i in range(n)})
    ways = [line(100 + i, 100 + (i + 1) % n) for i in range(n)]
    random.Random(1).shuffle(ways)
    closed, rest = rings_of(ways)
    assert len(closed) == 1 and len(closed[0]) == n + 1 and not rest


def test_rings_that_touch():
    # Two squares share the node 2; walked as one ring, 2 would be passed twice.
    closed, rest = rings_of([line(1, 2), line(2, 3, 4, 1), line(2, 6), line(6, 5, 2)])
    assert sorted(map(sorted, map(nodes_of, closed))) == [[1, 2, 3, 4], [2, 5, 6]] and not rest


def test_wrong_orders_are_taken_back():
    # Between 1 and 3, and between 2 and 4, there are two ways each: diagonals (by way of 7 and straight) and sides.
    ways = [line(1, 7), line(7, 3), line(1, 2), line(2, 3), line(3, 4), line(4, 1)]
    closed, rest = rings_of(ways)
    assert sides(closed + rest) == sides(ways) and all(not crosses_itself(r) and r[0][0] == r[-1][0] for r in closed)
    # 1-3 and 2-4 cross each other: a ring may have one of them only. The smallest numbers lead into the crossing first.
    AT.update({21: (0, 0), 22: (10, 10), 23: (10, 0), 24: (0, 10)})
    ways = [line(21, 22), line(22, 23), line(23, 24), line(24, 21), line(22, 24), line(21, 23)]
    closed, rest = searched(ways)
    assert sides(closed + rest) == sides(ways) and all(not crosses_itself(r) for r in closed) and sum(len(r) - 1 for r in closed) == 4 and len(rest) == 2


def test_the_search_leaves_least(spark):
    """Against all partitions: on random small networks no fewer lines can be left over."""
    from itertools import combinations

    rnd = random.Random(7)
    for _ in range(60):
        n = rnd.randrange(4, 6)
        AT.update({50 + i: (rnd.randrange(30), rnd.randrange(30)) for i in range(n)})
        pairs = rnd.sample(list(combinations(range(50, 50 + n), 2)), min(rnd.randrange(4, 8), n * (n - 1) // 2))
        ways = [line(*p) for p in pairs]

        def cycles(free):
            """Simple rings over the smallest free line."""
            first = min(free)
            todo = [([first], pairs[first][1])]
            while todo:
                path, here = todo.pop()
                if here == pairs[first][0]:
                    yield path
                    continue
                seen = {pairs[first][0]} | {v for i in path for v in pairs[i]}
                for i in free:
                    if i not in path and here in pairs[i]:
                        there = sum(pairs[i]) - here
                        if there == pairs[first][0] or there not in seen:
                            todo.append(([*path, i], there))

        def good(path):
            out, here = [], pairs[path[0]][0]
            for i in path:
                there = sum(pairs[i]) - here
                out += line(here, there)[1:] if out else line(here, there)
                here = there
            return not crosses_itself(out)

        def least(free):
            if not free:
                return 0
            return min([1 + least(free - {min(free)})] + [least(free - set(c)) for c in cycles(free) if good(c)])

        closed, rest = searched(ways)
        assert sides(closed + rest) == sides(ways) and all(not crosses_itself(r) and len(nodes_of(r)) == len(r) - 1 for r in closed)
        assert len(rest) == least(frozenset(range(len(ways))))


def test_hulls():
    assert hull_centre([(0, 0), (4, 0), (4, 4), (0, 4), (1, 1), (4, 2)]) == (2, 2) and hull_centre([(1, 1)]) == (1, 1) and hull_centre([(0, 0), (2, 2), (1, 1)]) == (1, 1)


@pytest.mark.parametrize("roles", [("outer", "inner"), (None, "inner")])
def test_shapes_of_relations(spark, roles):
    at = {1: (0, 0), 2: (8, 0), 3: (8, 8), 4: (0, 8), 5: (1, 1), 6: (3, 1), 7: (3, 3), 8: (20, 0), 9: (24, 0), 10: (24, 4), 11: (50, 50), 12: (51, 50), 13: (51, 51)}
    nodes = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in at.items()], "node_id bigint, lat double, lon double")
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 4, 3]), (3, [5, 6, 7, 5]), (4, [8, 9, 10, 8]), (5, [11, 12, 13, 11]), (6, [1, 2])], "way_id bigint, refs array<bigint>")
    outer, inner = roles
    members = spark.createDataFrame([(9, "way", 1, outer), (9, "way", 2, outer), (9, "way", 3, inner), (9, "way", 4, outer), (9, "way", 5, inner), (8, "way", 6, outer)], "root bigint, type string, ref bigint, role string")
    areas = osm.areas(members, ways, nodes)
    got = {r.root: r for r in osm.shapes(areas).collect()}
    assert set(got) == {9} and areas.where("not closed").select("root").collect()[0][0] == 8
    parts = [[{(p.x, p.y) for p in ring} for ring in part] for part in got[9].parts]
    assert parts == [[{at[1], at[2], at[3], at[4]}, {at[5], at[6], at[7]}], [{at[8], at[9], at[10]}]]
    # The hull of both outer rings; a hole outside them is none.
    assert (got[9].cx, got[9].cy) == pytest.approx(hull_centre([at[i] for i in (1, 2, 3, 4, 8, 9, 10)]))
    assert osm.shapes(areas.where("root = 0")).select(F.size("parts")).collect() == []


def test_crossings_by_blocks(monkeypatch):
    n = 400
    star = lambda k: [(i, *(math.cos(6.28 * k * i / n) * 9 + 1e-3 * i, math.sin(6.28 * k * i / n) * 9)) for i in range(n)] + [(0, 9.0, 0.0)]
    for pairs in (1, 50, 10**6):
        monkeypatch.setattr(rings, "PAIRS", pairs)
        monkeypatch.setattr(rings, "FEW", 0 if pairs > 1 else 16)
        test_crossings()
        assert crosses_itself(star(7)) and not crosses_itself([(i, x, i % n * 1.0) for i, x, _ in star(0)[:-1]] + [(n, -9.0, 5.0), (0, 9.0, 0.0)])


@pytest.mark.parametrize("rows", [1, 2, 3, 50])
def test_areas_over_several_batches(rows):
    """However the ways are cut into batches, each area is put together once, from all of its ways."""
    kind = pa.schema([("root", pa.int64()), ("role", pa.string()), ("line", pa.list_(pa.struct([("node", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])))])
    as_dicts = lambda one: [dict(zip(("node", "x", "y"), p, strict=True)) for p in one]
    ways = [(1, "", line(1, 2)), (1, "", line(2, 3)), (1, "", line(3, 1)), (1, "inner", line(4, 3, 2, 4)), (2, "", line(5, 6)), (3, "", line(7)), (4, "", line(1, 2, 3)), (4, "", line(3, 1))]
    table = pa.Table.from_pylist([dict(zip(kind.names, (root, role, as_dicts(one)), strict=True)) for root, role, one in ways], kind)
    found = [r for b in rings.joined(iter(table.to_batches(max_chunksize=rows))) for r in b.to_pylist()]
    assert [(r["root"], r["role"], r["closed"], len(r["ring"])) for r in found] == [(1, "", True, 4), (1, "inner", True, 4), (2, "", False, 2), (4, "", True, 4)]
    assert found[2]["ring"] == [{"x": 20.0, "y": 10.0}, {"x": 20.0, "y": 0.0}]
    assert [b.num_rows for b in rings.joined(iter([]))] == [0]


def test_shapes_read_areas_once(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rows = [(i, role, True, ring) for i in range(5) for role, ring in (("outer", square), ("inner", [(x / 2 + 1, y / 2 + 1) for x, y in square[::-1]]))]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    kind = "root bigint, role string, closed boolean, ring array<struct<x:double,y:double>>"
    found = spark.createDataFrame(rows, kind).mapInArrow(counted, kind)
    assert sorted((r.root, len(r.parts), len(r.parts[0]), r.cx, r.cy) for r in osm.shapes(found).collect()) == [(i, 1, 2, 2.0, 2.0) for i in range(5)]
    assert read.value == len(rows)
