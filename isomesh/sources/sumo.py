"""Networks, objects and speeds from the XML files of a traffic simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.functions.modes import BIKE, CAR, FOOT
from isomesh.sources.text import layer_columns, paired, unique_problem

CLASSES = {"pedestrian": FOOT.bit, "bicycle": BIKE.bit, "passenger": CAR.bit}


def rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def shape(text: Column) -> Column:
    """``x,y x,y ...`` as points."""
    return paired(F.transform(F.split(F.trim(text), r"[\s,]+"), lambda v: v.try_cast("double")))


def bits(classes: Column) -> Column:
    names = F.split(F.trim(classes), r"\s+")
    return sum((F.when(F.array_contains(names, n), b).otherwise(0) for n, b in CLASSES.items()), F.lit(0))


def network(spark: SparkSession, path: str, used: int = 14, custom_at: int = 0) -> DataFrame:
    """edge_id, from_node, to_node (texts), modes, vmax, length, geom: normal edges that a used mode may pass.

    Speed is that of the fastest lane, length the mean of the lanes, modes what any lane allows; the shape is the
    edge's own or else that of the middle lane (of the two middle ones, between them). The file's offset is taken off.
    """
    lane = "lane array<struct<_speed:double,_length:double,_shape:string,_allow:string,_allowed:string,_disallow:string,_disallowed:string>>"
    edges = rows(spark, path, "edge", f"_id string, _from string, _to string, _type string, _shape string, {lane}").where((F.col("_type").isNull() | (F.col("_type") == "normal")) & (F.size("lane") > 0))
    offset = rows(spark, path, "location", "_netOffset string").select(shape(F.col("_netOffset"))[0].alias("offset")).limit(1)
    lanes, n = F.col("lane"), F.size("lane")
    every = F.lit(sum(CLASSES.values()))

    def may(x: Column) -> Column:
        yes, no = F.coalesce(x["_allow"], x["_allowed"]), F.coalesce(x["_disallow"], x["_disallowed"])
        return F.when(yes.isNull(), every).otherwise(bits(yes)).bitwiseAND(F.bitwise_not(bits(F.coalesce(no, F.lit("")))))

    modes = F.aggregate(lanes, F.lit(0), lambda a, x: a.bitwiseOR(may(x)))
    modes = F.when(modes.bitwiseAND(F.lit(custom_at)) != 0, modes.bitwiseOR(F.lit(1))).otherwise(modes)
    half = F.floor(n / 2).cast("int")
    one, two = shape(lanes[half]["_shape"]), shape(lanes[F.greatest(half - 1, F.lit(0))]["_shape"])
    between = F.zip_with(one, two, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(G.point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)))
    points = F.when(F.col("_shape").isNotNull(), shape(F.col("_shape"))).when(n % 2 == 1, one).otherwise(between)
    out = edges.select(F.col("_id").alias("edge_id"), F.col("_from").alias("from_node"), F.col("_to").alias("to_node"), modes.cast("bigint").alias("modes"), F.array_max(F.transform(lanes, lambda x: x["_speed"])).alias("vmax"), (F.aggregate(lanes, F.lit(0.0), lambda a, x: a + x["_length"]) / n).alias("length"), points.alias("points"))
    # One row: the file's offset.
    out = out.where(F.col("modes").bitwiseAND(F.lit(used)) != 0).join(F.broadcast(offset), F.lit(True), "left")
    moved = F.transform("points", lambda p: G.point(p["x"] - F.coalesce("offset.x", F.lit(0.0)), p["y"] - F.coalesce("offset.y", F.lit(0.0))))
    return out.select("edge_id", "from_node", "to_node", "modes", "vmax", "length", moved.alias("geom"))


def layer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points (poi) and polygons (poly) as a layer, each of value 1, and errors (value, problem)."""
    points = rows(spark, path, "poi", "_id string, _x double, _y double").select("_id", F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), F.array(G.point(F.col("_x"), F.col("_y")))).alias("open"), F.lit("POINT").alias("kind"))
    ring = shape(F.col("_shape"))
    closed = F.when(ring[0] != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    polygons = rows(spark, path, "poly", "_id string, _shape string").select("_id", closed.alias("open"), F.lit("POLYGON").alias("kind"))
    both = points.union(polygons).withColumns({"object_id": F.col("_id").try_cast("bigint"), "var": F.lit(1.0)})
    both = unique_problem(both, "object_id")
    bad = F.col("open").isNull() | (F.size("open") < 1) | F.exists("open", lambda p: p["x"].isNull() | p["y"].isNull())
    problem = F.when(F.col("object_id").isNull(), "bad id").when(F.col("times") > 1, "duplicate id").when(F.coalesce(bad, F.lit(True)), "bad geometry")
    both = both.withColumn("problem", problem)
    return both.where("problem is null").select(*layer_columns(F.array(F.array("open")), F.col("kind"))), both.where("problem is not null").select(F.col("_id").alias("value"), "problem")


def speeds(spark: SparkSession, path: str) -> DataFrame:
    """edge_id, ibegin, iend, speed of a dump of intervals; edges without a speed are left out."""
    spells = rows(spark, path, "interval", "_begin double, _end double, edge array<struct<_id:string,_speed:double>>")
    return spells.select(F.col("_begin").alias("ibegin"), F.col("_end").alias("iend"), F.explode("edge").alias("e")).where("e._speed is not null").select(F.col("e._id").alias("edge_id"), "ibegin", "iend", F.col("e._speed").alias("speed"))
