"""Readers of the line formats: layers, networks, speeds, pairs, types, escorts, mode changes, boundaries.

Every reader takes a DataFrame with a text column ``value``, one row a line, as ``spark.read.text`` gives it. Empty
lines and lines that begin with # are passed over. Readers return (good rows, errors), where errors is a DataFrame
(value, problem); a caller that wants all or nothing uses ``strict``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isomesh.functions.geom import centroid_of_parts, parse_wkt
from isomesh.functions.modes import BIKE, CAR, FOOT, MODES, SYNONYMS

#: Prefixes of sources and what file endings mean.
PREFIXES = ("db", "file", "csv", "wkt", "shp", "gpkg", "sumo")
ENDINGS = {".csv": "csv", ".txt": "csv", ".wkt": "wkt", ".shp": "shp", ".gpkg": "gpkg", ".net.xml": "sumo", ".poi.xml": "sumo", ".dump.xml": "sumo"}


def source_format(source: str) -> str:
    """What a source text names: postgres, sqlite, csv, wkt, shp, gpkg or sumo."""
    if m := re.match(rf"({'|'.join(PREFIXES)})[;,]", source):
        if m[1] == "db":
            return "postgres"
        if m[1] != "file":
            return m[1]
        source = source[m.end() :]
    if source.startswith("jdbc:"):
        return source.split(":")[1].replace("postgresql", "postgres")
    for ending, kind in ENDINGS.items():
        if source.lower().endswith(ending):
            return kind
    raise ValueError(f"cannot tell the format of {source!r}")


def source_parts(source: str) -> list[str]:
    """The parts of a source text; commas divide, semicolons still may."""
    source = re.sub(rf"^({'|'.join(PREFIXES)})[;,]", "", source)
    parts = re.split("[;,]", source)
    expected = {"postgres": 4, "sqlite": 2}.get(source_format(source) if source.startswith("jdbc:") else "", 1)
    if len(parts) != expected:
        raise ValueError(f"{source!r} has {len(parts)} parts, not {expected}")
    return parts


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def lines(df: DataFrame) -> DataFrame:
    return df.where((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("f", F.split("value", ";"))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out over as many tasks as shuffles have: few bytes of geometry take long to read, so the files alone
    don't divide the work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row, however often and in whatever conditions it is used."""
    return df.withColumn(name, F.explode(F.array(value)))


def strict(good: DataFrame, errors: DataFrame) -> DataFrame:
    """The rows, or an error that names the first broken lines."""
    if broken := errors.limit(5).collect():
        raise ValueError("; ".join(f"{r.problem}: {r.value}" for r in broken))
    return good


def divided(rows: DataFrame, problem: Column, *out: Column | str) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("problem", problem)
    return rows.where("problem is null").select(*out), rows.where("problem is not null").select("value", "problem")


def numbers(fields: Column) -> Column:
    return F.transform(fields, lambda v: F.trim(v).try_cast("double"))


def paired(values: Column) -> Column:
    """x, y, x, y, ... as points."""

    def of(v: Column) -> Column:
        n = F.floor(F.size(v) / 2).cast("int")
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.struct(v[2 * i].alias("x"), v[2 * i + 1].alias("y")))

    # All numbers are read once, not for each point again.
    return F.transform(F.array(values), of)[0]


def layer_columns(parts: Column, kind: Column) -> list[Column]:
    """object_id, var, geom_type, parts, points (the first ring), cx, cy."""
    c = centroid_of_parts(parts, kind)
    return [F.col("object_id"), F.col("var"), kind.alias("geom_type"), parts.alias("parts"), parts[0][0].alias("points"), c["x"].alias("cx"), c["y"].alias("cy")]


def unique_problem(rows: DataFrame, key: str) -> DataFrame:
    """Adds how many rows have the row's key."""
    times = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("times")).withColumnRenamed(key, "key_")
    return rows.join(times, F.col(key) == F.col("key_"), "left")


def layer_csv(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id;x;y[;x;y]*[;var]: one pair is a point, more are a polygon's ring, which is closed; var is 1 by default."""
    values = numbers(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))))
    rows = lines(df).withColumns({"object_id": F.trim(F.col("f")[0]).try_cast("bigint"), "v": values})
    odd = F.size("v") % 2 == 1
    rows = rows.withColumns({"var": F.when(odd, F.try_element_at("v", F.size("v"))).otherwise(1.0), "open": paired(F.col("v"))})
    kind = F.when(F.size("open") == 1, F.lit("POINT")).otherwise(F.lit("POLYGON"))
    closed = F.when((F.size("open") > 1) & (F.col("open")[0] != F.element_at("open", -1)), F.concat("open", F.slice("open", 1, 1))).otherwise(F.col("open"))
    rows = unique_problem(rows, "object_id")
    problem = (
        F.when(F.col("object_id").isNull(), "bad id").when(F.col("times") > 1, "duplicate id").when(F.size("open") < 1, "no geometry")
        .when(F.exists("open", lambda p: p["x"].isNull() | p["y"].isNull()), "bad geometry").when(F.col("var").isNull(), "bad value")
    )
    return divided(rows, problem, *layer_columns(F.array(F.array(closed)), kind))


def layer_wkt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id;WKT[;var]; all parts of a geometry, with holes."""
    rows = worked_out(lines(dealt(df)).withColumn("object_id", F.trim(F.col("f")[0]).try_cast("bigint")), "g", parse_wkt(F.try_element_at("f", F.lit(2))))
    rows = rows.withColumn("var", F.when(F.size("f") == 3, F.try_element_at("f", F.lit(3)).try_cast("double")).otherwise(1.0))
    rows = unique_problem(rows, "object_id")
    problem = F.when(F.col("object_id").isNull(), "bad id").when(F.col("times") > 1, "duplicate id").when(F.col("g.rings").isNull(), "bad geometry").when(F.col("var").isNull(), "bad value")
    return divided(rows, problem, *layer_columns(F.col("g.parts"), F.col("g.kind")))


def flag(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1")


def net_rows(df: DataFrame, geom: Column, used: int, custom_at: int) -> tuple[DataFrame, DataFrame]:
    f = F.col("f")
    bits = sum((F.when(flag(F.try_element_at(f, F.lit(i))), m.bit).otherwise(0) for i, m in ((4, FOOT), (5, BIKE), (6, CAR))), F.lit(0))
    bits = bits + F.when(bits.bitwiseAND(F.lit(custom_at)) != 0, 1).otherwise(0)
    rows = worked_out(lines(dealt(df)), "geom", geom).withColumns({
        "edge_id": F.trim(f[0]), "from_node": F.try_element_at(f, F.lit(2)).try_cast("bigint"), "to_node": F.try_element_at(f, F.lit(3)).try_cast("bigint"), "modes": bits.cast("bigint"),
        "vmax": F.try_element_at(f, F.lit(7)).try_cast("double") / 3.6, "length": F.try_element_at(f, F.lit(8)).try_cast("double"),
    })
    broken = F.col("from_node").isNull() | F.col("to_node").isNull() | F.col("vmax").isNull() | F.col("length").isNull()
    shape = F.col("geom").isNull() | (F.size("geom") < 2) | F.exists("geom", lambda p: p["x"].isNull() | p["y"].isNull())
    good, errors = divided(rows, F.when(broken, "bad number").when(shape, "bad geometry"), "edge_id", "from_node", "to_node", "modes", "vmax", "length", "geom")
    return good.where(F.col("modes").bitwiseAND(F.lit(used)) != 0), errors


def net_csv(df: DataFrame, used: int = 14, custom_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """id;from;to;foot;bike;car;vmax_kmh;length;x;y;...; rows that no used mode may pass are left out."""
    return net_rows(df, paired(numbers(F.slice("f", 9, F.greatest(F.size("f") - 8, F.lit(0))))), used, custom_at)


def net_wkt(df: DataFrame, used: int = 14, custom_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same with a LINESTRING in the last field."""
    return net_rows(df, parse_wkt(F.try_element_at("f", F.lit(9)))["rings"][0], used, custom_at)


def speeds(df: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edge;begin;end;speed: edge_id, and its intervals in order of their begin; unknown edges are errors."""
    f = F.col("f")
    rows = lines(df).select("value", F.trim(f[0]).alias("edge_id"), *(F.try_element_at(f, F.lit(i)).try_cast("float").alias(n) for i, n in ((2, "ibegin"), (3, "iend"), (4, "speed"))))
    known = rows.join(edges.select("edge_id").distinct(), "edge_id", "left_semi")
    unknown = rows.join(edges.select("edge_id").distinct(), "edge_id", "left_anti").select("value", F.lit("unknown edge").alias("problem"))
    return known.where("ibegin is not null and iend is not null and speed is not null").select("edge_id", "ibegin", "iend", "speed"), unknown


def od_pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """origin;destination."""
    rows = lines(df).withColumns({n: F.trim(F.try_element_at("f", F.lit(i))).try_cast("bigint") for i, n in ((1, "origin"), (2, "destination"))})
    return divided(rows, F.when(F.col("origin").isNull() | F.col("destination").isNull(), "bad pair"), "origin", "destination")


def types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id;type: the set of an object's types, one row each."""
    rows = lines(df).withColumns({"id": F.trim(F.col("f")[0]).try_cast("bigint"), "type": F.trim(F.try_element_at("f", F.lit(2)))})
    good, errors = divided(rows, F.when(F.col("id").isNull() | F.col("type").isNull(), "bad type"), "id", "type")
    return good.distinct(), errors


def named_bits(name: Column) -> Column:
    out = F.when(F.lower(name) == "custom", F.lit(1))
    for n, m in [*((m.name, m) for m in MODES.values()), *((s, MODES[n]) for s, n in SYNONYMS.items())]:
        out = out.when(F.lower(name) == n, F.lit(m.bit))
    return out


def escorts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """carrier;subtype;mode: which modes a carrier takes along, as bits."""
    rows = lines(df).withColumns({"carrier": F.trim(F.col("f")[0]), "subtype": F.try_element_at("f", F.lit(2)).try_cast("int"), "bit": named_bits(F.trim(F.try_element_at("f", F.lit(3))))})
    good, errors = divided(rows, F.when(F.col("subtype").isNull(), "bad subtype").when(F.col("bit").isNull(), "unknown mode"), "carrier", "subtype", "bit")
    return good.groupBy("carrier", "subtype").agg(F.bit_or("bit").cast("bigint").alias("modes")), errors


def mode_changes(df: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node;from_mode;to_mode;time;price; unknown nodes are errors. Nodes are texts or numbers, as those of the network."""
    f = lambda i: F.trim(F.try_element_at("f", F.lit(i)))
    rows = lines(df).withColumns({"node_id": f(1).try_cast(nodes.schema["node_id"].dataType), "from_mode": named_bits(f(2)), "to_mode": named_bits(f(3)), "duration": f(4).try_cast("double"), "price": f(5).try_cast("double")})
    rows = rows.join(nodes.select(F.col("node_id").alias("known")).distinct(), F.col("node_id") == F.col("known"), "left")
    problem = F.when(F.col("known").isNull(), "unknown node").when(F.col("from_mode").isNull() | F.col("to_mode").isNull(), "unknown mode").when(F.col("duration").isNull() | F.col("price").isNull(), "bad number")
    return divided(rows, problem, "node_id", "from_mode", "to_mode", "duration", "price")


def boundary(text: str) -> tuple[float, float, float, float]:
    """minx,miny,maxx,maxy."""
    x1, y1, x2, y2 = map(float, text.split(","))
    return x1, y1, x2, y2


def within(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])
