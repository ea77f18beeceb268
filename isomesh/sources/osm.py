"""OpenStreetMap: elements from XML, roads from ways, structures from tags, areas from relations.

Tables: nodes<node_id, lat, lon, tags>, ways<way_id, refs, tags>, relations<relation_id, members, tags>, where tags is
a map, refs an array of node ids in order, and members an array of struct<type, ref, role> in order.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.functions.modes import BIKE, BUS, CAR, FOOT
from isomesh.operators.state import settled
from isomesh.sources import rings as rings_

RAIL = 32
DRIVEN, SLOW, ROAD = CAR.bit | BUS.bit, FOOT.bit | BIKE.bit, FOOT.bit | BIKE.bit | CAR.bit | BUS.bit
#: Kinds of roads with modes, speed (km/h), lanes, and whether they are one-way unless tagged otherwise.
KINDS = [
    ("highway_motorway", DRIVEN, 160, 2, True), ("highway_motorway_link", DRIVEN, 80, 1, True), ("highway_trunk", ROAD, 100, 2, False), ("highway_trunk_link", ROAD, 80, 1, False),
    ("highway_primary", ROAD, 100, 2, False), ("highway_primary_link", ROAD, 80, 1, False), ("highway_secondary", ROAD, 100, 2, False), ("highway_secondary_link", ROAD, 80, 1, False),
    ("highway_tertiary", ROAD, 80, 1, False), ("highway_tertiary_link", ROAD, 80, 1, False), ("highway_unclassified", ROAD, 80, 1, False), ("highway_residential", ROAD, 50, 1, False),
    ("highway_living_street", ROAD, 10, 1, False), ("highway_road", ROAD, 30, 1, False), ("highway_service", ROAD, 20, 1, False), ("highway_track", ROAD, 20, 1, False),
    ("highway_services", ROAD, 20, 1, False), ("highway_unsurfaced", ROAD, 30, 1, False), ("highway_path", SLOW, 10, 1, False), ("highway_bridleway", FOOT.bit, 10, 1, False),
    ("highway_cycleway", BIKE.bit, 10, 1, False), ("highway_pedestrian", FOOT.bit, 10, 1, False), ("highway_footway", FOOT.bit, 10, 1, False), ("highway_step", SLOW, 10, 1, False),
    ("highway_steps", SLOW, 10, 1, False), ("highway_stairs", SLOW, 10, 1, False), ("highway_bus_guideway", BUS.bit, 50, 1, False), ("highway_raceway", 0, 160, 1, False),
    ("highway_ford", 0, 10, 1, False), ("railway_rail", RAIL, 300, 1, True), ("railway_tram", RAIL, 100, 1, True), ("railway_light_rail", RAIL, 100, 1, True),
    ("railway_subway", RAIL, 100, 1, True), ("railway_preserved", RAIL, 100, 1, True),
]
#: What the values of access tags allow and forbid.
ALLOWS = ("yes", "private", "permissive", "use_sidepath", "delivery", "designated", "dismount", "discouraged", "destination", "customers", "official", "service")
FORBIDS = ("no", "agricultural", "forestry", "emergency")
#: Tags of sidewalks and cycleways that open a road.
SIDEWALKS = ("sidewalk", "crossing", "left", "right", "both", "yes")
CYCLEWAYS = ("track", "opposite_track", "segregated", "lane", "shared_lane", "opposite_lane", "share_busway", "right", "opposite", "yes", "shared")
#: Access keys and the modes that they are about.
ACCESS = {"foot": FOOT.bit, "bicycle": BIKE.bit, "motorcar": CAR.bit, "bus": BUS.bit}
ONEWAY, REVERSE, BOTH = ("true", "yes", "1"), ("reverse", "-1"), ("false", "no", "0")

TAGS = "tag array<struct<_k:string,_v:string>>"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, ways and relations of XML files."""
    part = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    # Of a key that is given twice, the last value counts.
    tags = F.map_from_entries(F.coalesce(F.transform(F.array_distinct(F.transform("tag", lambda t: t["_k"])), lambda k: F.struct(k.alias("a"), F.element_at(F.filter("tag", lambda t: t["_k"] == k), -1)["_v"].alias("b"))), F.array().cast("array<struct<a:string,b:string>>"))).alias("tags")
    nodes = part("node", f"_id bigint, _lat double, _lon double, {TAGS}").select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags)
    ways = part("way", f"_id bigint, nd array<struct<_ref:bigint>>, {TAGS}").select(F.col("_id").alias("way_id"), F.coalesce(F.col("nd._ref"), F.array().cast("array<bigint>")).alias("refs"), tags)
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    relations = part("relation", f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {TAGS}").select(F.col("_id").alias("relation_id"), F.coalesce(members, F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members"), tags)
    return nodes, ways, relations


def tag(key: str) -> Column:
    return F.col("tags")[key]


# --- roads ---------------------------------------------------------------------------------------------------------
def roads(ways: DataFrame) -> DataFrame:
    """The ways of a known kind, with kind, modes, vmax, lanes and oneway of it. A highway tag goes before a railway."""
    spark = ways.sparkSession
    kinds = F.broadcast(spark.createDataFrame(KINDS, "kind string, k_modes int, k_vmax int, k_lanes int, k_oneway boolean"))
    named = F.when(tag("highway").isNotNull(), F.concat(F.lit("highway_"), tag("highway"))).otherwise(F.concat(F.lit("railway_"), tag("railway")))
    return ways.withColumn("kind", named).join(kinds, "kind")


def bits_where(found, keys: dict[str, int] = ACCESS) -> Column:
    """The bits of the modes for whose key ``found`` holds."""
    return reduce(lambda a, b: a + b, (F.when(found(key), bit).otherwise(0) for key, bit in keys.items()))


def changed(bits: Column, opened: Column | None = None, closed: Column | None = None) -> Column:
    """Bits with some set, then some cleared. Every change names the bits once, so that chains of them stay short."""
    bits = bits if opened is None else bits.bitwiseOR(opened)
    return bits if closed is None else bits.bitwiseAND(F.bitwise_not(closed))


def open_to(base: Column) -> Column:
    """The modes that may use a road at all: of its kind, opened by sidewalks and cycleways, then by access tags, those
    of single modes last."""
    put = lambda cond, mask: F.when(cond, mask).otherwise(0)
    bits = changed(base, closed=put(tag("motorroad") == "yes", SLOW))
    bits = changed(bits, put(tag("sidewalk").isin(*SIDEWALKS), FOOT.bit))
    bits = changed(bits, put(tag("cycleway").isin(*CYCLEWAYS), BIKE.bit), put(tag("access").isin(*FORBIDS), ROAD))
    return changed(bits, bits_where(lambda k: tag(k).isin(*ALLOWS)), bits_where(lambda k: tag(k).isin(*FORBIDS)))


def directed(bits: Column, oneway_kind: Column) -> tuple[Column, Column]:
    """The modes forward and backward. One-way roads are closed backward to all but walkers (reversed ones forward),
    but for modes that a tag of their own says it is not one-way for; so are roundabouts, unless tagged. One-way kinds
    with more than one track are open both ways."""
    wheels = DRIVEN | BIKE.bit | RAIL
    oneway = tag("oneway")
    is_in = lambda values: F.coalesce(oneway.isin(*values), F.lit(False))
    tracks = F.coalesce(tag("tracks").try_cast("int") > 1, F.lit(False)) | F.coalesce(tag("tracks").contains(";"), F.lit(False))
    ahead = is_in(ONEWAY) | (oneway_kind & ~is_in((*BOTH, *REVERSE)) & ~(tracks & oneway.isNull()))
    back = is_in(REVERSE)
    ring = oneway.isNull() & F.coalesce(tag("junction") == "roundabout", F.lit(False))
    free, bound = bits_where(lambda k: tag(f"oneway:{k}").isin(*FORBIDS)), bits_where(lambda k: tag(f"oneway:{k}").isin(*ALLOWS))

    def against(shut: Column, own: Column) -> Column:
        rest = changed(bits, closed=F.when(shut, wheels).otherwise(0))
        return changed(rest, F.when(own, free).otherwise(0), F.when(own, bound).otherwise(0))

    def by_way(b: Column, way: str) -> Column:
        return changed(b, bits_where(lambda k: tag(f"{k}:{way}") == "yes"), bits_where(lambda k: tag(f"{k}:{way}") == "no"))

    return by_way(against(back, back), "forward"), by_way(against(ahead | ring, ahead), "backward")


def allowed_speed(default: Column) -> Column:
    """km/h by the tag maxspeed: numbers with or without a unit, names of limits; the kind's where it cannot be read."""
    v = F.lower(F.trim(tag("maxspeed")))
    number = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)\s*(km/h|kmh|kph|mph)?$", 1).try_cast("double")
    named = F.when(v.isin("none", "no"), 300.0).when(v == "walk", 5.0).when(v.endswith(":rural"), 100.0).when(v.endswith(":urban"), 50.0).when(v.endswith(":living_street"), 10.0)
    return F.coalesce(F.when(v.endswith("mph"), number * 1.609344).otherwise(number), named, default.cast("double"))


def lane_numbers(default: Column) -> tuple[Column, Column]:
    """Lanes forward and backward: tags of a direction, else the kind's."""
    of = lambda way: F.coalesce(tag(f"lanes:{way}").try_cast("int"), default)
    return of("forward"), of("backward")


def slope() -> Column:
    """Incline in percent forward: up and down are 6 and -6, degrees become percent; null where it cannot be read."""
    v = F.lower(F.trim(tag("incline")))
    number = F.regexp_replace(F.regexp_extract(v, r"(-?[0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double")
    return (
        F.when(v == "up", 6.0).when(v == "down", -6.0).when(v.startswith("up"), number).when(v.startswith("down"), -F.abs(number))
        .when(v.endswith("°"), F.tan(F.radians(number)) * 100).when(v.endswith("%"), number)
    )


def node_use(ways: DataFrame) -> DataFrame:
    """node_id, n: how often ways refer to a node."""
    return ways.select(F.explode("refs").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))


def positions(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, points: array<struct<pos, node, lat, lon, n>> in order; n counts the references to the node by ``ways``.

    A way has 2,000 nodes at most in the source, which bounds the arrays. Nodes that are absent are left out.
    """
    at = ways.select("way_id", F.posexplode("refs").alias("pos", "node"))
    used = node_use(ways).join(nodes.select(F.col("node_id").alias("k"), "lat", "lon"), F.col("node_id") == F.col("k")).drop("k")
    met = at.join(used, F.col("node") == F.col("node_id"))
    return met.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "lat", "lon", "n"))).alias("points"))


def loop_cuts(nodes: Column) -> Column:
    """Places before which a way would meet a node of its own again: a road between two cuts has each node once."""
    none = F.struct(F.lit(0).alias("begin"), F.array().cast("array<int>").alias("cuts"))

    def step(a: Column, i: Column) -> Column:
        again = F.array_contains(F.slice(nodes, a["begin"] + 1, i - a["begin"]), F.get(nodes, i))
        return F.when(again, F.struct((i - 1).alias("begin"), F.array_append(a["cuts"], i - 1).alias("cuts"))).otherwise(a)

    # Consecutive repetitions of one node would be cut at their own begin: places are kept once and inside the way.
    places = F.when(F.size(nodes) > 1, F.sequence(F.lit(1), F.size(nodes) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, none, step)["cuts"]


def road_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the road network: ``f<way>#<i>`` along a way and ``b<way>#<i>`` against it, where any mode may go.

    Columns: edge_id, opposite_id, from_node, to_node, modes, vmax (km/h, at least 5), lanes, length (metres), kind,
    incline, name, nodes, geom (x: longitude, y: latitude). Ways are cut at nodes that known roads refer to more than
    once, and where they meet themselves. Ways with fewer than two known nodes give none.
    """
    known = roads(ways)
    forward, backward = directed(open_to(F.col("k_modes")), F.col("k_oneway"))
    lanes_f, lanes_b = lane_numbers(F.col("k_lanes"))
    attributes = known.select("way_id", "kind", forward.alias("f_modes"), backward.alias("b_modes"), allowed_speed(F.col("k_vmax")).alias("vmax"), lanes_f.alias("f_lanes"), lanes_b.alias("b_lanes"), slope().alias("incline"), tag("name").alias("name"))
    p = F.col("points")
    at = positions(known.select("way_id", "refs"), nodes).where(F.size("points") > 1)
    inner = F.filter(F.transform(p, lambda x, i: F.when((i > 0) & (i < F.size(p) - 1) & (x["n"] > 1), i)), lambda i: i.isNotNull())
    loops = F.filter(loop_cuts(F.transform(p, lambda x: x["node"])), lambda i: i > 0)
    at = at.withColumn("cuts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inner, loops, F.array(F.size(p) - 1)))))
    pieces = at.select("way_id", F.posexplode(F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda c, i: F.slice(p, c + 1, F.col("cuts")[i + 1] - c + 1))).alias("i", "piece"))
    e = pieces.join(attributes, "way_id")
    q = F.col("piece")
    steps = F.transform(F.slice(q, 1, F.size(q) - 1), lambda a, i: G.on_spheroid(a["lat"], a["lon"], q[i + 1]["lat"], q[i + 1]["lon"]))
    e = e.withColumns({"length": F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), "vmax": F.greatest("vmax", F.lit(5.0)), "number": F.concat(F.col("way_id").cast("string"), F.lit("#"), F.col("i").cast("string"))})
    e = settled(e.drop("way_id", "i"), "pieces")

    def way(letter: str, other: str, sign: int) -> DataFrame:
        line = q if sign > 0 else F.reverse(q)
        name = lambda x: F.concat(F.lit(x), "number")
        rows = e.where(F.col(f"{letter}_modes") != 0)
        return rows.select(name(letter).alias("edge_id"), F.when(F.col(f"{other}_modes") != 0, name(other)).alias("opposite_id"), line[0]["node"].alias("from_node"), F.element_at(line, -1)["node"].alias("to_node"), F.col(f"{letter}_modes").cast("bigint").alias("modes"), "vmax", F.col(f"{letter}_lanes").alias("lanes"), "length", "kind", (F.col("incline") * sign).alias("incline"), "name", F.transform(line, lambda x: x["node"]).alias("nodes"), F.transform(line, lambda x: G.point(x["lon"], x["lat"])).alias("geom"))

    return way("f", "b", 1).union(way("b", "f", -1))


# --- structures ----------------------------------------------------------------------------------------------------
def condition(text: str) -> Column:
    """A condition on tags: ``k=v``, ``k!=v``, ``k~pattern``, ``k!~pattern``, ``k=*``, ``*``, joined by ``&``.

    As negations are looked for among an element's own tags, they hold only if it has the key.
    """

    def one(part: str) -> Column:
        if part == "*":
            return F.size("tags") > 0
        found = re.match(r"(.*?)(!=|!~|=|~)(.*)", part)
        if not found:
            raise ValueError(f"cannot read the condition {part!r}")
        key, sign, value = (x.strip() for x in found.groups())
        has = tag(key).isNotNull()
        if sign in ("=", "!=") and value == "*":
            return has if sign == "=" else ~has
        return has & {"=": tag(key) == value, "!=": tag(key) != value, "~": tag(key).rlike(value), "!~": ~tag(key).rlike(value)}[sign]

    return reduce(lambda a, b: a & b, (one(p.strip()) for p in text.split("&")))


def definitions(text: str) -> list[tuple[str, str]]:
    """(kind, condition) for each line of a definition: sections [node], [way], [rel] and [*] name the kinds that the
    lines below them are about; lines that begin with # are passed over."""
    kinds, out = ["node", "way", "rel"], []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            kinds = ["node", "way", "rel"] if line == "[*]" else [line.strip("[]")]
            continue
        out += [(k, line) for k in kinds]
    return out


def structures(definition: str, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, id, type: the elements that meet a line of the definition; type is the line, a row for each that is met."""
    of = {"node": (nodes, "node_id"), "way": (ways, "way_id"), "rel": (relations, "relation_id")}
    parts = [of[k][0].where(F.coalesce(condition(c), F.lit(False))).select(F.lit(k).alias("kind"), F.col(of[k][1]).alias("id"), F.lit(c).alias("type")) for k, c in definitions(definition)]
    if not parts:
        raise ValueError("the definition has no line")
    return reduce(DataFrame.union, parts)


def members_of(relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """root, type, ref, role: nodes and ways that belong to the relations ``wanted`` (relation_id), directly or over
    relations in them; the role is that of the outermost member. Goes one level a round; rings of relations end."""
    parts = settled(relations.select("relation_id", F.explode("members").alias("m")).select("relation_id", "m.*"), "members")
    front = wanted.select(F.col("relation_id").alias("root"), "relation_id", F.lit(None).cast("string").alias("as_role")).distinct()
    seen = settled(front.select("root", "relation_id"), "seen")
    out = None
    while True:
        here = settled(front.join(parts, "relation_id").select("root", "type", "ref", F.coalesce("as_role", "role").alias("role")), "level")
        found = here.where("type <> 'relation'")
        out = found if out is None else out.union(found)
        front = here.where("type = 'relation'").groupBy("root", F.col("ref").alias("relation_id")).agg(F.min("role").alias("as_role")).join(seen, ["root", "relation_id"], "left_anti")
        front = settled(front, "front")
        if not front.limit(1).count():
            return out.distinct()
        seen = settled(seen.union(front.select("root", "relation_id")), "seen")


def areas(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, role, closed, ring: the ways of relations (root, type, ref, role) joined end to end, turned round where
    that is needed, so that rings pass a point once and don't cross themselves (see ``rings``). Outer rings run against
    the clock, inner ones with it; what does not close is told apart."""
    lines = members.where("type = 'way'").select("root", F.coalesce("role", F.lit("")).alias("role"), F.col("ref").alias("way_id"))
    at = positions(ways.join(lines.select("way_id").distinct(), "way_id", "left_semi"), nodes)
    line = F.transform("points", lambda p: F.struct(p["node"].alias("node"), p["lon"].alias("x"), p["lat"].alias("y")))
    # A relation has 32,000 members at most in the source. Areas are dealt out whole, many to a task, and come one after the
    # other in it.
    dealt = lines.join(at, "way_id").select("root", "role", "way_id", line.alias("line")).repartition(int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "role")
    found = dealt.sortWithinPartitions("root", "role", "way_id").select("root", "role", "line").mapInArrow(rings_.joined, f"root bigint, role string, closed boolean, ring {G.POINTS}")
    area = G.signed_area(F.col("ring"))
    turned = F.when(F.col("closed") & ((F.col("role") == "inner") == (area > 0)), F.reverse("ring")).otherwise(F.col("ring"))
    return found.select("root", "role", "closed", turned.alias("ring"))


def hull_centres(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rings_.hull_centre(list(zip(x.tolist(), y.tolist(), strict=True))) for x, y in zip(xs, ys, strict=True)], columns=["x", "y"])


def shapes(found: DataFrame) -> DataFrame:
    """root, parts, cx, cy: for each relation with closed rings (of ``areas``) a polygon of several parts, the largest
    first: each outer ring with the holes that lie in it, and the centroid of the convex hull of all outer rings. A hole
    belongs to the smallest ring that has half of its points or more; a hole in none is left out."""
    whole = found.where("closed").select("root", (F.col("role") == "inner").alias("hole"), "ring", F.sha2(F.to_json("ring"), 256).alias("ring_id"), F.abs(G.signed_area(F.col("ring"))).alias("area"))
    # Written once, as what follows reads it several times.
    whole = settled(whole.dropDuplicates(["root", "hole", "ring_id"]), "rings")
    outer = whole.where("not hole").drop("hole")
    # Rings of one relation meet in cells of a grid over it, about as many as it has outer rings.
    low, high = (lambda k: F.array_min(F.transform("ring", lambda p: p[k]))), (lambda k: F.array_max(F.transform("ring", lambda p: p[k])))
    frame = outer.groupBy("root").agg(F.min(low("x")).alias("x0"), F.min(low("y")).alias("y0"), F.greatest(F.max(high("x")) - F.min(low("x")), F.max(high("y")) - F.min(low("y"))).alias("extent"), F.count("*").alias("n"))
    frame = frame.select("root", "x0", "y0", (F.col("extent") / F.ceil(F.sqrt("n"))).alias("w"))
    cell = lambda v, k: F.floor((v - F.col(f"{k}0")) / F.col("w"))
    span = lambda k: F.sequence(cell(low(k), k), cell(high(k), k))
    boxes = outer.join(frame, "root").select("root", "ring_id", F.col("ring").alias("outer_ring"), F.col("area").alias("outer_area"), F.explode(span("x")).alias("cx"), span("y").alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")
    holes = whole.where("hole").withColumnRenamed("ring_id", "hole_id").join(frame, "root")
    # Points may lie on the outer ring itself, so one of them is not enough: a hole comes in all its points' cells.
    near = holes.withColumn("at", F.explode(F.array_distinct(F.transform("ring", lambda p: F.struct(cell(p["x"], "x").alias("cx"), cell(p["y"], "y").alias("cy")))))).select("root", "hole_id", F.col("ring").alias("hole"), "at.cx", "at.cy")
    met = near.join(boxes, ["root", "cx", "cy"]).dropDuplicates(["root", "hole_id", "ring_id"])
    inside = F.size(F.filter("hole", lambda p: G.inside(F.col("outer_ring"), p["x"], p["y"]))) * 2 >= F.size("hole")
    held = met.where(inside).groupBy("root", "hole_id").agg(F.min_by(F.struct("ring_id", "hole"), F.struct("outer_area", "ring_id")).alias("h")).groupBy("root", "h.ring_id").agg(F.array_sort(F.collect_list("h.hole")).alias("holes"))
    part = F.struct((-F.col("area")).alias("k"), F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(f"array<{G.POINTS}>"))).alias("rings"))
    out = outer.join(held, ["root", "ring_id"], "left").groupBy("root").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("root", F.transform("parts", lambda p: p["rings"]).alias("parts"))
    centre = F.pandas_udf(hull_centres, "struct<x:double,y:double>")
    corners = F.flatten(F.transform("parts", lambda p: p[0]))
    out = out.withColumn("c", centre(F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])))
    return out.select("root", "parts", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


def within(inner: DataFrame, outer: DataFrame, cell: float) -> DataFrame:
    """inner_id, outer_id: rings all of whose vertices lie in another ring. inner, outer: id, ring. First vertices meet
    the grid cells of the outer rings' boxes.

    Equal rings are one shape, and shapes are held against each other once; what lies in what is then told of all rings of
    a shape. The pairs themselves are as many as there are.
    """
    from isomesh.operators.mapping import cells

    ends = lambda k, f: f(F.transform("ring", lambda p: p[k]))
    small, large = (settled(df.groupBy("ring").agg(F.min("id").alias("shape")), "shapes") for df in (inner, outer))
    boxes = large.select(F.col("shape").alias("outer_shape"), F.col("ring").alias("outer_ring"), F.explode(cells(ends("x", F.array_min), ends("x", F.array_max), ends("y", F.array_min), ends("y", F.array_max), cell)).alias("c")).select("outer_shape", "outer_ring", "c.cx", "c.cy")
    here = small.select(F.col("shape").alias("inner_shape"), "ring", F.floor(F.col("ring")[0]["x"] / cell).alias("cx"), F.floor(F.col("ring")[0]["y"] / cell).alias("cy"))
    met = here.join(boxes, ["cx", "cy"]).where(F.forall("ring", lambda p: G.inside(F.col("outer_ring"), p["x"], p["y"])))
    pairs = settled(met.select("inner_shape", "outer_shape"), "within")
    of = lambda df, shapes, side: df.join(shapes, "ring").select(F.col("id").alias(f"{side}_id"), F.col("shape").alias(f"{side}_shape"))
    # Few rows become many in the last join, so they are dealt out first.
    dealt = pairs.join(of(inner, small, "inner"), "inner_shape").repartition(int(inner.sparkSession.conf.get("spark.sql.shuffle.partitions")), "inner_id")
    return dealt.join(of(outer, large, "outer"), "outer_shape").where(F.col("inner_id") != F.col("outer_id")).select("inner_id", "outer_id")
