"""Spatial joins: objects to their nearest edge, and points to the area that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.operators.state import settled

#: Rows of areas up to which they are sent to all executors.
SMALL = 20_000


def cells(x1: Column, x2: Column, y1: Column, y2: Column, size: float) -> Column:
    """All grid cells of a box, as an array of struct<cx, cy>."""
    axis = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(axis(x1, x2), lambda i: F.transform(axis(y1, y2), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def passed(a: Column, b: Column, size: float) -> Column:
    """The grid cells that a segment passes, as an array of struct<cx, cy>: the segment is cut where it crosses a line of
    the grid, so their number grows with its length. Cells that it only touches count too."""

    def crossings(k: str) -> Column:
        low, high = F.least(a[k], b[k]), F.greatest(a[k], b[k])
        first, last = F.floor(low / size) + 1, F.floor(high / size)
        at = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: (i * size - a[k]) / (b[k] - a[k]))
        return F.when((last >= first) & (high > low), at).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("x"), crossings("y")))
    # Every cut, and a place between it and the one before.
    places = F.transform(F.array(cuts), lambda c: F.concat(c, F.transform(c, lambda t, i: F.when(i > 0, (t + c[i - 1]) / 2).otherwise(t))))[0]
    cell = lambda t, k: F.floor((a[k] + t * (b[k] - a[k])) / size)
    return F.array_distinct(F.transform(places, lambda t: F.struct(cell(t, "x").alias("cx"), cell(t, "y").alias("cy"))))


def side_rule(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Between an edge and its opposite, the one that has the object on its right; else the greater id."""
    o = edges.select(F.col("edge_id").alias("o_id"), F.col("geom").alias("o_geom"), F.col("length").alias("o_length"))
    both = found.join(o, F.col("opposite_id") == F.col("o_id"), "left")
    there = G.nearest_on(F.col("o_geom"), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))
    both = both.withColumn("o", F.when(F.col("o_id").isNotNull(), there))
    right, o_right = F.col("side") < 0, F.col("o.side") < 0
    near = F.col("o.dist") - F.col("dist") < 0.1
    switch = F.coalesce(near & ((o_right & ~right) | ((o_right == right) & (F.col("o_id") > F.col("edge_id")))), F.lit(False))
    # Exactly on the line, a made opposite gives way to its original.
    switch = F.when((F.col("dist") == 0) & F.col("edge_id").startswith("opp_"), True).when((F.col("dist") == 0) & F.coalesce(F.col("o_id"), F.lit("")).startswith("opp_"), False).otherwise(switch)
    pick = lambda a, b: F.when(switch, a).otherwise(b)
    pos = F.least(F.greatest(pick(F.col("o.pos"), F.col("pos")), F.lit(0.0)), pick(F.col("o_length"), F.col("length")))
    return both.select("object_id", pick(F.col("o_id"), F.col("edge_id")).alias("edge_id"), pick(F.col("o.dist"), F.col("dist")).alias("dist"), pos.alias("pos"))


def nearest_edge(objects: DataFrame, edges: DataFrame, cell: float | None = None, widest: float = 1e7) -> DataFrame:
    """object_id, edge_id, dist, pos: the nearest edge of each object (object_id, cx, cy), ties by edge id, then
    the side rule. Needs opposite_id.

    Segments lie in the grid cells that they pass, objects look into their own cell and the eight around it; cells are
    as wide as a segment is long on average, unless given. What lies within one cell size is sure to be the nearest;
    objects that find nothing so near are tried again with cells four times as wide, and only they.
    """
    segs = edges.select("edge_id", F.explode(G.segments(F.col("geom"))).alias("s"))
    if cell is None:
        cell = min(max(segs.agg(F.avg(G.distance(F.col("s.a"), F.col("s.b")))).first()[0] or 100.0, 10.0), 1000.0)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left, out, size = objects.select("object_id", "cx", "cy"), None, cell
    while True:
        there = segs.select("edge_id", "s", F.explode(passed(F.col("s.a"), F.col("s.b"), size)).alias("c")).select("edge_id", "s", F.col("c.cx").alias("gx"), F.col("c.cy").alias("gy"))
        here = left.select("object_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.explode(around).alias("n"))
        here = here.select("object_id", "x", "y", (F.floor(F.col("x") / size) + F.col("n.i")).alias("gx"), (F.floor(F.col("y") / size) + F.col("n.j")).alias("gy"))
        met = here.join(there, ["gx", "gy"]).withColumn("d", G.to_segment(F.col("s.a"), F.col("s.b"), F.struct("x", "y")))
        best = met.groupBy("object_id").agg(F.min(F.struct("d", "edge_id")).alias("m")).where(F.col("m.d") <= size).select("object_id", F.col("m.edge_id").alias("edge_id"))
        best = settled(best, "nearest")
        out = best if out is None else out.union(best)
        left = left.join(best, "object_id", "left_anti")
        size *= 4
        if size > widest or not left.limit(1).count():
            break
        left = settled(left, "far")
    got = objects.select("object_id", "cx", "cy").join(out, "object_id").join(edges.select("edge_id", "geom", "length", "opposite_id"), "edge_id")
    at = G.nearest_on(F.col("geom"), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))
    got = got.withColumn("at", at).select("object_id", "cx", "cy", "edge_id", "length", "opposite_id", "at.dist", "at.pos", "at.side")
    return side_rule(got, edges)


def area_of(objects: DataFrame, areas: DataFrame, cell: float = 1000.0) -> DataFrame:
    """object_id, area_id: of the areas that hold an object's point the one with the smallest id, -1 if there is none.

    areas: object_id and parts, or points where an area is one ring. Areas meet objects in the grid cells of the boxes of
    their parts.
    """
    parts = F.col("parts") if "parts" in areas.columns else F.array(F.array("points"))
    each = areas.select(F.col("object_id").alias("area_id"), F.explode(parts).alias("part"))
    ends = lambda k, f: f(F.transform(F.col("part")[0], lambda p: p[k]))
    boxed = each.select("area_id", "part", F.explode(cells(ends("x", F.array_min), ends("x", F.array_max), ends("y", F.array_min), ends("y", F.array_max), cell)).alias("c")).select("area_id", "part", F.col("c.cx").alias("gx"), F.col("c.cy").alias("gy"))
    here = objects.select("object_id", "cx", "cy", F.floor(F.col("cx") / cell).alias("gx"), F.floor(F.col("cy") / cell).alias("gy"))
    held = here.join(boxed, ["gx", "gy"]).where(G.inside_parts(F.array("part"), F.col("cx"), F.col("cy"))).groupBy("object_id").agg(F.min("area_id").alias("area_id"))
    return objects.select("object_id").join(held, "object_id", "left").select("object_id", F.coalesce("area_id", F.lit(-1).cast("bigint")).alias("area_id"))
