"""Transforms of a road network: edges<edge_id, from_node, to_node, modes, vmax, length, [incline], geom>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.functions.modes import FOOT
from isomesh.operators.components import components, numbered
from isomesh.operators.state import settled


def net_errors(edges: DataFrame) -> DataFrame:
    """description, edge1: lengths and speeds that are not positive, and ids that occur more than once."""
    bad = lambda cond, what: edges.where(cond).select(F.lit(what).alias("description"), F.col("edge_id").alias("edge1"))
    twice = edges.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id"), "edge_id")
    return bad(F.col("length") <= 0, "length<=0").union(bad(F.col("vmax") <= 0, "speed<=0")).union(twice)


def patched(edges: DataFrame, least: float = 0.1) -> DataFrame:
    """Lengths and speeds that are not positive become ``least``."""
    return edges.withColumns({c: F.when(F.col(c) <= 0, least).otherwise(F.col(c)) for c in ("length", "vmax")})


def inclined(edges: DataFrame) -> DataFrame:
    """Lengths along the slope."""
    rise = F.col("length") * F.col("incline") / 100
    return edges.withColumn("length", F.sqrt(F.col("length") * F.col("length") + rise * rise))


def merge_duplicates(edges: DataFrame, near: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Edges with the same nodes and nearly the same shape become the first of them, with all modes and the
    highest speed; also returns the replacements (edge_id, replaced)."""
    a, b = edges.alias("a"), edges.alias("b")
    same = (F.col("a.from_node") == F.col("b.from_node")) & (F.col("a.to_node") == F.col("b.to_node")) & (F.col("a.edge_id") < F.col("b.edge_id"))
    pairs = a.join(b, same & (G.vertex_distance(F.col("a.geom"), F.col("b.geom")) < near)).select(F.col("a.edge_id").alias("edge_id"), F.col("b.edge_id").alias("replaced"))
    first = pairs.groupBy("replaced").agg(F.min("edge_id").alias("edge_id"))
    keep = edges.join(first.select(F.col("replaced").alias("r"), F.col("edge_id").alias("head")), F.col("edge_id") == F.col("r"), "left").withColumn("head", F.coalesce("head", "edge_id"))
    sums = keep.groupBy("head").agg(F.bit_or("modes").alias("modes_"), F.max("vmax").alias("vmax_"))
    out = edges.join(sums, F.col("edge_id") == F.col("head")).withColumns({"modes": F.col("modes_"), "vmax": F.col("vmax_")}).drop("head", "modes_", "vmax_")
    return out, first.select("edge_id", "replaced")


def opposites(edges: DataFrame, near: float = 0.5) -> DataFrame:
    """edge_id, opposite_id: the edge back between the same nodes, of about the same length and shape."""
    a, b = edges.alias("a"), edges.alias("b")
    back = (F.col("a.from_node") == F.col("b.to_node")) & (F.col("a.to_node") == F.col("b.from_node"))
    alike = (F.abs(F.col("a.length") - F.col("b.length")) < 1) & (G.vertex_distance(F.col("a.geom"), F.col("b.geom")) < near)
    return a.join(b, back & alike & (F.col("a.edge_id") != F.col("b.edge_id"))).groupBy(F.col("a.edge_id").alias("edge_id")).agg(F.min("b.edge_id").alias("opposite_id"))


def with_opposites(edges: DataFrame, foot_used: bool = True) -> DataFrame:
    """Adds opposite_id. Who walks one way may walk back: an existing opposite gets the foot bit, a missing one is
    made for feet alone, named opp_<id>."""
    found = edges.join(opposites(edges), "edge_id", "left")
    walk = F.col("modes").bitwiseAND(F.lit(FOOT.bit)) != 0
    of = edges.select(F.col("edge_id").alias("o_id"), F.col("modes").alias("o_modes"))
    found = found.join(of, F.col("opposite_id") == F.col("o_id"), "left")
    if not foot_used:
        return found.drop("o_id", "o_modes")
    extended = F.when(F.col("o_modes").bitwiseAND(F.lit(FOOT.bit)) != 0, F.col("modes").bitwiseOR(F.lit(FOOT.bit))).otherwise(F.col("modes"))
    name = F.concat(F.lit("opp_"), "edge_id")
    lone = F.col("o_id").isNull() & walk
    kept = found.withColumns({"opposite_id": F.when(lone, name).otherwise(F.col("opposite_id")), "modes": extended}).drop("o_id", "o_modes")
    own = {"edge_id": name, "from_node": F.col("to_node"), "to_node": F.col("from_node"), "modes": F.lit(FOOT.bit).cast("bigint"), "geom": F.reverse("geom"), "incline": -F.col("incline"), "opposite_id": F.col("edge_id")}
    made = found.where(lone)
    return kept.unionByName(made.select(*((own[c] if c in own else F.col(c)).alias(c) for c in kept.columns)))


def subnets(edges: DataFrame) -> DataFrame:
    """edge_id, cell_id, cell_size: edges that hang together, the largest set first (then by its first edge).

    Two edges hang together if one ends where the other begins; edges that only begin, or only end, at the same node
    don't. So nodes with edges in and out are the links, and edges take the component of such a node.
    """
    # Written once, as they are read several times and a network may be dear to make.
    ends = settled(edges.select("edge_id", "from_node", "to_node"), "ends")
    sides = ends.select(F.col("from_node").alias("node"), F.lit(1).alias("out")).union(ends.select("to_node", F.lit(0)))
    # Nodes that are no links are few as a rule, and then edges need no shuffle to be told of them.
    tips = settled(sides.groupBy("node").agg(F.min("out").alias("least"), F.max("out").alias("most")).where("least = most").select("node"), "tips")
    of = lambda c: tips.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_tip"))
    is_hub = lambda c: F.col(c).isNotNull() & F.col(f"{c}_tip").isNull()
    told = ends.join(of("from_node"), "from_node", "left").join(of("to_node"), "to_node", "left").select("*", is_hub("from_node").alias("by_from"), is_hub("to_node").alias("by_to"))
    labelled = components(told.where("by_from and by_to").select(F.col("from_node").alias("a"), F.col("to_node").alias("b")))
    # The links at both ends of an edge are of one component, so one of them is looked up; a link without an edge to
    # another is its own component.
    at = told.select("edge_id", F.when(F.col("by_from"), F.col("from_node")).otherwise(F.col("to_node")).alias("node"), (F.col("by_from") | F.col("by_to")).alias("held"))
    own = F.when(F.col("held"), F.coalesce("label", "node").cast("string")).otherwise(F.concat(F.lit("alone "), "edge_id"))
    labels = settled(at.join(labelled, "node", "left").select("edge_id", own.alias("label")), "labels")
    sizes = labels.groupBy("label").agg(F.count("*").alias("cell_size"), F.min("edge_id").alias("first"))
    cells = numbered(sizes, "cell_id", F.desc("cell_size"), F.col("first")).select("label", "cell_id", "cell_size")
    return labels.join(cells, "label").select("edge_id", "cell_id", "cell_size")


def largest_subnet(edges: DataFrame) -> DataFrame:
    return edges.join(subnets(edges).where("cell_id = 0").select("edge_id"), "edge_id", "left_semi")


def crossing_delays(edges: DataFrame, seconds: float = 10.0) -> DataFrame:
    """from_edge, to_edge, delay: each arm passed before turning costs ``seconds``, a turn back costs it once.

    Around the end of an edge the other arms are ordered by their angle to it; an arm passed is an incoming edge
    that directly follows its own opposite. Needs opposite_id.
    """
    last = lambda g: (F.element_at(g, -1), F.element_at(g, -2))
    bearing = lambda p, q: F.atan2(p["x"] - q["x"], p["y"] - q["y"])
    came = edges.select(F.col("to_node").alias("node"), F.col("edge_id").alias("from_edge"), F.col("opposite_id").alias("back"), bearing(*last(F.col("geom"))).alias("angle"))
    arms_in = edges.select(F.col("to_node").alias("a_node"), F.col("edge_id").alias("arm"), F.col("opposite_id").alias("arm_opp"), F.lit(False).alias("is_out"), bearing(F.element_at("geom", -1), F.element_at("geom", -2)).alias("a_angle"))
    arms_out = edges.select(F.col("from_node").alias("a_node"), F.col("edge_id").alias("arm"), F.col("opposite_id").alias("arm_opp"), F.lit(True).alias("is_out"), bearing(F.col("geom")[0], F.col("geom")[1]).alias("a_angle"))
    met = came.join(arms_in.union(arms_out), F.col("node") == F.col("a_node"))
    others = met.where((F.col("arm") != F.col("from_edge")) & ~F.col("arm").eqNullSafe(F.col("back")))
    turned = F.col("a_angle") - F.col("angle")
    others = others.withColumn("relative", F.when(turned < 0, turned + 2 * F.acos(F.lit(-1.0))).otherwise(turned))
    order = Window.partitionBy("from_edge").orderBy("relative", "is_out", "arm")
    before = F.coalesce(F.lag("arm_opp").over(order), F.when(F.lag("arm").over(order).isNull(), F.col("back")))
    passed = others.withColumn("crossed", F.coalesce((before == F.col("arm")).cast("int"), F.lit(0)))
    so_far = F.coalesce(F.sum("crossed").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    delays = passed.withColumn("delay", so_far * seconds).where("is_out").select("from_edge", F.col("arm").alias("to_edge"), "delay")
    return delays.union(edges.where("opposite_id is not null").select("edge_id", "opposite_id", F.lit(seconds)))


def without_dead_ends(edges: DataFrame, used: DataFrame) -> DataFrame:
    """Takes away edges that lead nowhere and that no object (edge_id in ``used``, or on the opposite) needs, until
    none is left. Needs opposite_id.

    A chain is a set of roads, each both ways and not needed, joined at nodes where nothing else meets. Once one edge of
    a chain leads nowhere, all of it goes: so it goes in one round, and a network of n edges takes about log n rounds.
    """
    held = used.select("edge_id").distinct()
    held = settled(held.union(edges.join(held.select(F.col("edge_id").alias("h")), F.col("opposite_id") == F.col("h"), "left_semi").select("edge_id")).distinct(), "held")
    now = settled(edges.select("edge_id", "from_node", "to_node", "opposite_id").join(held.select("edge_id", F.lit(True).alias("kept")), "edge_id", "left").fillna(False, ["kept"]), "now")
    while True:
        onward = now.select(F.col("from_node").alias("f"), F.col("edge_id").alias("next"))
        leads = now.join(onward, (F.col("to_node") == F.col("f")) & ~F.col("next").eqNullSafe(F.col("opposite_id")), "left_semi").select("edge_id")
        dead = settled(now.where("not kept").join(leads, "edge_id", "left_anti").select("edge_id", "opposite_id"), "dead")
        if not dead.limit(1).count():
            return edges.join(now.select("edge_id"), "edge_id", "left_semi")
        gone = dead.select(F.col("edge_id").alias("d")).union(dead.where("opposite_id is not null").select("opposite_id"))
        chains = settled(chains_of(now), "chains")
        ends = chains.join(gone, F.col("edge_id") == F.col("d"), "left_semi").select(F.col("label").alias("l")).distinct()
        gone = gone.union(chains.join(ends, F.col("label") == F.col("l"), "left_semi").select("edge_id")).distinct()
        now = settled(now.join(gone, F.col("edge_id") == F.col("d"), "left_anti"), "now")


def chains_of(edges: DataFrame) -> DataFrame:
    """edge_id, label: the roads of each chain of two or more. edges: edge_id, from_node, to_node, opposite_id, kept."""
    back = edges.select(F.col("edge_id").alias("o"), F.col("opposite_id").alias("oo"), F.col("kept").alias("o_kept"))
    two = edges.join(back, (F.col("opposite_id") == F.col("o")) & (F.col("oo") == F.col("edge_id")), "left")
    free = F.col("o").isNotNull() & ~F.col("kept") & ~F.coalesce(F.col("o_kept"), F.lit(True)) & (F.col("from_node") != F.col("to_node"))
    road = F.least("edge_id", "opposite_id")
    sides = two.select("edge_id", road.alias("road"), free.alias("free"), F.explode(F.array("from_node", "to_node")).alias("node"))
    # Two roads meet here, each with an edge in and one out, and nothing else.
    joints = sides.groupBy("node").agg(F.count("*").alias("n"), F.min("free").alias("free"), F.min("road").alias("a"), F.max("road").alias("b")).where("n = 4 and free and a != b").select("a", "b")
    labels = components(joints)
    return edges.select("edge_id", road.alias("node")).join(labels, "node").select("edge_id", "label")


def pass_nodes(edges: DataFrame) -> DataFrame:
    """node: those with exactly two two-way arms of equal speed, modes and incline, which can be joined into one."""
    two = edges.where("opposite_id is not null")
    slope = F.abs(F.col("incline")) if "incline" in edges.columns else F.lit(0.0)  # the same road up and down
    ends = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("other"), F.lit(1).alias("out"), "vmax", "modes", slope.alias("slope")).union(edges.select("to_node", "from_node", F.lit(0), "vmax", "modes", slope))
    seen = ends.groupBy("node").agg(F.count_distinct("other").alias("arms"), F.sum("out").alias("outs"), F.count("*").alias("n"), F.count_distinct("vmax", "modes", F.coalesce("slope", F.lit(0.0))).alias("kinds"))
    both = two.groupBy(F.col("from_node").alias("t")).agg(F.count("*").alias("pairs"))
    return seen.join(both, F.col("node") == F.col("t")).where("arms = 2 and outs = 2 and n = 4 and kinds = 1 and pairs = 2").select("node")


def join_similar(edges: DataFrame) -> DataFrame:
    """Chains of edges through pass nodes become one edge: edge_id of the first, opposite_id of the last (the first of the
    chain back), summed length, all points.

    Along a chain, every edge has one successor; pointers double each round, so a chain of n edges takes log n
    rounds. Rings without a fixed node stay as they are. Needs opposite_id.
    """
    joints = pass_nodes(edges)
    a, b = edges.alias("a"), edges.alias("b")
    follows = (F.col("a.to_node") == F.col("b.from_node")) & (F.col("a.from_node") != F.col("b.to_node"))
    links = a.join(joints, F.col("a.to_node") == F.col("node"), "left_semi").join(b, follows).select(F.col("a.edge_id").alias("e"), F.col("b.edge_id").alias("up"))
    # Pointers to the front of the chain: from an edge to the one before it.
    jumps = settled(links.select(F.col("up").alias("e"), F.col("e").alias("head"), F.lit(1).cast("bigint").alias("n")), "jumps")
    while True:
        on = jumps.select(F.col("e").alias("o"), F.col("head").alias("o_head"), F.col("n").alias("o_n"))
        step = settled(jumps.join(on, F.col("head") == F.col("o"), "left").select("e", F.coalesce("o_head", "head").alias("head"), (F.col("n") + F.coalesce("o_n", F.lit(0))).alias("n"), F.col("o_head").isNotNull().alias("moved")), "jumps")
        jumps = step.drop("moved")
        # A ring never comes to an end: its pointers come back to where they were.
        if not step.where("moved and n <= 1073741824").limit(1).count():
            break
    heads = jumps.where("n <= 1073741824")
    placed = edges.join(heads, F.col("edge_id") == F.col("e"), "left").select("*", F.coalesce("head", "edge_id").alias("chain"), F.coalesce("n", F.lit(0)).alias("place"))
    parts = placed.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("place", "from_node", "to_node", "length", "geom", "modes", "vmax", "opposite_id"))).alias("p"))
    p = F.col("p")
    points = F.concat(F.slice(p[0]["geom"], 1, 1), F.flatten(F.transform(p, lambda x: F.slice(x["geom"], 2, F.greatest(F.size(x["geom"]) - 1, F.lit(0))))))
    return parts.select(F.col("chain").alias("edge_id"), F.element_at(p, -1)["opposite_id"].alias("opposite_id"), p[0]["from_node"].alias("from_node"), F.element_at(p, -1)["to_node"].alias("to_node"), p[0]["modes"].alias("modes"), p[0]["vmax"].alias("vmax"), F.aggregate(p, F.lit(0.0), lambda s, x: s + x["length"]).alias("length"), F.size(p).cast("bigint").alias("parts"), points.alias("geom"))


def speed_at(edges: DataFrame, intervals: DataFrame, time: Column) -> DataFrame:
    """Adds measured: the speed of the interval that holds the time, the earliest where several do, or null."""
    lists = intervals.groupBy(F.col("edge_id").alias("s_edge")).agg(F.array_sort(F.collect_list(F.struct("ibegin", "iend", "speed"))).alias("s_list"))
    joined = edges.join(lists, F.col("edge_id") == F.col("s_edge"), "left")
    holds = F.filter("s_list", lambda s: (s["ibegin"] <= time) & (time <= s["iend"]))
    return joined.withColumn("measured", F.try_element_at(holds, F.lit(1))["speed"].cast("double")).drop("s_edge", "s_list")


def bounds(edges: DataFrame) -> DataFrame:
    """x1, y1, x2, y2: the box of all geometries, in one row."""
    of = lambda k, f, g: g(f(F.transform("geom", lambda p: p[k])))
    return edges.agg(of("x", F.array_min, F.min).alias("x1"), of("y", F.array_min, F.min).alias("y1"), of("x", F.array_max, F.max).alias("x2"), of("y", F.array_max, F.max).alias("y2"))
