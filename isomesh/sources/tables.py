"""Tables as sources, and sources by their text: a file, a JDBC url with its table, or a table of the catalog.

Geometry in tables is text (WKT), binary form (WKB, also with a projection's number), or that in hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isomesh.functions.geom import inside_parts
from isomesh.functions.modes import BIKE, CAR, FOOT
from isomesh.functions.wkb import parse_geometry
from isomesh.sources import database, sumo, text


def table(spark: SparkSession, source: str, by: str | None = None, where: str | None = None, geom: str | None = None, epsg: int | None = None) -> DataFrame:
    """A table of a database (``jdbc:...,table,user,password``), in tasks by ranges of the whole numbers ``by``, or of the
    catalog. ``where`` is SQL over its columns."""
    if database.is_database(source):
        return database.read(spark, source, by, where, geom, epsg)
    rows = spark.table(source)
    return rows.where(where) if where else rows


def is_table(source: str) -> bool:
    if database.is_database(source):
        return True
    try:
        return text.source_format(source) in ("postgres", "sqlite")
    except ValueError:
        return True


def path_of(source: str) -> str:
    return text.source_parts(source)[0]


def geometry(df: DataFrame, geom: str) -> list[Column]:
    """value, as text for messages, and g, the geometry; one that the database has projected goes first."""
    name = "geom_binary" if "geom_binary" in df.columns else geom
    kind = df.select(name).schema[0].dataType
    return [(F.hex(name) if isinstance(kind, T.BinaryType) else F.col(name).cast("string")).alias("value"), parse_geometry(F.col(name), kind).alias("g")]


def layer_table(df: DataFrame, id: str = "id", geom: str = "geom", var: str | None = None, where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A layer from columns of a table; ``where`` is SQL over its columns."""
    df = df.where(where) if where else df
    df = text.dealt(df)
    value, g = geometry(df, geom)
    rows = df.select(F.col(id).cast("bigint").alias("object_id"), value, F.explode(F.array(g)).alias("g"), (F.col(var).cast("double") if var else F.lit(1.0)).alias("var"))
    rows = text.unique_problem(rows, "object_id")
    problem = F.when(F.col("object_id").isNull(), "bad id").when(F.col("times") > 1, "duplicate id").when(F.col("g.rings").isNull(), "bad geometry").when(F.col("var").isNull(), "bad value")
    return text.divided(rows, problem, *text.layer_columns(F.col("g.parts"), F.col("g.kind")))


def net_table(df: DataFrame, vmax: str = "vmax", geom: str = "geom", incline: bool = False, used: int = 14, custom_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges from a table with oid, nodefrom, nodeto, mode_walk, mode_bike, mode_mit, length, and speeds in km/h. A line of
    several parts is an error; an incline that is null is 0."""
    yes = lambda c: F.lower(F.col(c).cast("string")).isin("true", "t", "1")
    bits = sum((F.when(yes(c), m.bit).otherwise(0) for c, m in (("mode_walk", FOOT), ("mode_bike", BIKE), ("mode_mit", CAR))), F.lit(0))
    bits = bits + F.when(bits.bitwiseAND(F.lit(custom_at)) != 0, 1).otherwise(0)
    slope = [F.coalesce(F.col("incline").cast("double"), F.lit(0.0)).alias("incline")] if incline else []
    rows = df.select(F.col("oid").cast("string").alias("edge_id"), F.col("nodefrom").cast("bigint").alias("from_node"), F.col("nodeto").cast("bigint").alias("to_node"), bits.cast("bigint").alias("modes"), (F.col(vmax).cast("double") / 3.6).alias("vmax"), F.col("length").cast("double").alias("length"), *geometry(df, geom), *slope)
    rows = rows.withColumn("geom", F.col("g.rings")[0])
    broken = F.col("from_node").isNull() | F.col("to_node").isNull() | F.col("vmax").isNull() | F.col("length").isNull()
    good, errors = text.divided(rows, F.when(broken, "bad number").when(F.size("g.rings") > 1, "several lines").when(F.col("geom").isNull() | (F.size("geom") < 2) | ~F.col("g.kind").endswith("LINESTRING"), "bad geometry"), "edge_id", "from_node", "to_node", "modes", "vmax", "length", "geom", *(["incline"] if incline else []))
    return good.where(F.col("modes").bitwiseAND(F.lit(used)) != 0), errors


def layer(spark: SparkSession, source: str, where: str | None = None, id: str = "id", geom: str = "geom", var: str | None = None, area: Column | None = None, epsg: int | None = None) -> DataFrame:
    """The objects that a source names: a table, or a csv, wkt or simulation file; any error ends it. ``area`` keeps
    what lies in it, as ``within`` makes it; ``where`` is SQL over a table's columns, or over those of a file's layer."""
    if is_table(source):
        out = text.strict(*layer_table(table(spark, source, id, where, geom, epsg), id, geom, var))
    else:
        kind, path = text.source_format(source), path_of(source)
        if kind not in ("csv", "wkt", "sumo"):
            raise ValueError(f"layers cannot be read from {kind}")
        rows = sumo.layer(spark, path) if kind == "sumo" else {"csv": text.layer_csv, "wkt": text.layer_wkt}[kind](text.read_lines(spark, path))
        out = text.strict(*rows)
        out = out.where(where) if where else out
    return out if area is None else out.where(area)


def network(spark: SparkSession, source: str, used: int = 14, custom_at: int = 0, vmax: str = "vmax", geom: str = "geom", incline: bool = False, epsg: int | None = None) -> DataFrame:
    """The edges that a source names; any error ends it. Nodes of simulation files are texts."""
    if is_table(source):
        return text.strict(*net_table(table(spark, source, "nodefrom", geom=geom, epsg=epsg), vmax, geom, incline, used, custom_at))
    kind, path = text.source_format(source), path_of(source)
    if kind == "sumo":
        return sumo.network(spark, path, used, custom_at)
    if kind not in ("csv", "wkt"):
        raise ValueError(f"networks cannot be read from {kind}")
    return text.strict(*{"csv": text.net_csv, "wkt": text.net_wkt}[kind](text.read_lines(spark, path), used, custom_at))


def speeds(spark: SparkSession, source: str, edges: DataFrame) -> DataFrame:
    """edge_id, ibegin, iend, speed for edges of the network: a table (eid), lines, or a simulation's dump."""
    if is_table(source):
        rows = table(spark, source, "ibegin").select(F.col("eid").cast("string").alias("edge_id"), *(F.col(c).cast("double").alias(c) for c in ("ibegin", "iend", "speed")))
    elif text.source_format(source) == "sumo":
        rows = sumo.speeds(spark, path_of(source))
    else:
        rows = text.speeds(text.read_lines(spark, path_of(source)), edges)[0]
    return rows.join(edges.select("edge_id").distinct(), "edge_id", "left_semi")


def od_pairs(spark: SparkSession, source: str) -> DataFrame:
    """origin, destination; lines that cannot be read are passed over."""
    if is_table(source):
        return table(spark, source, "origin").select(*(F.col(c).cast("bigint").alias(c) for c in ("origin", "destination")))
    return text.od_pairs(text.read_lines(spark, path_of(source)))[0]


def types(spark: SparkSession, source: str) -> DataFrame:
    """id, type."""
    if is_table(source):
        return table(spark, source, "id").select(F.col("id").cast("bigint").alias("id"), F.col("type").cast("string").alias("type")).distinct()
    return text.strict(*text.types(text.read_lines(spark, path_of(source))))


def escorts(spark: SparkSession, source: str) -> DataFrame:
    """carrier, subtype, modes; unknown modes are passed over."""
    if is_table(source):
        rows = table(spark, source).select(F.col("carrier").cast("string").alias("carrier"), F.col("carrier_subtype").cast("int").alias("subtype"), text.named_bits(F.trim("carried")).alias("bit"))
        return rows.where("bit is not null").groupBy("carrier", "subtype").agg(F.bit_or("bit").cast("bigint").alias("modes"))
    return text.escorts(text.read_lines(spark, path_of(source)))[0]


def mode_changes(spark: SparkSession, source: str, nodes: DataFrame) -> DataFrame:
    """node_id, from_mode, to_mode, duration, price; modes of a table are bits already. Unknown nodes are an error."""
    if is_table(source):
        rows = table(spark, source, "node_id").select(F.col("node_id").cast(nodes.schema["node_id"].dataType).alias("node_id"), *(F.col(c).cast("int").alias(c) for c in ("from_mode", "to_mode")), *(F.col(c).cast("double").alias(c) for c in ("duration", "price")))
        if unknown := rows.join(nodes, "node_id", "left_anti").limit(5).collect():
            raise ValueError("; ".join(f"unknown node: {r.node_id}" for r in unknown))
        return rows
    return text.strict(*text.mode_changes(text.read_lines(spark, path_of(source)), nodes))


def boundary(spark: SparkSession, source: str):
    """A test (x, y) -> Column of lying in a box ``minx,miny,maxx,maxy`` or in the first geometry (by id) of a source."""
    try:
        box = text.boundary(source)
        return lambda x, y: text.within(x, y, box)
    except ValueError:
        first = layer(spark, source).where("geom_type like '%POLYGON'").orderBy("object_id").select("parts").first()
    if first is None:
        raise ValueError(f"{source!r} has no polygon")
    at = lambda p: F.struct(F.lit(p.x).alias("x"), F.lit(p.y).alias("y"))
    parts = F.array(*(F.array(*(F.array(*map(at, ring)) for ring in part)) for part in first.parts))
    return lambda x, y: inside_parts(parts, x, y)
