"""One computation by its options: from sources over searches to result relations.

Options are a dict by name, as on a command line or in a file ``<configuration><name>value</name></configuration>``.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.functions import modes as M
from isomesh.operators import aggregate, limits, mapping, measures, network, sinks, transit
from isomesh.operators.state import settled
from isomesh.operators.ways import Enough
from isomesh.sources import gtfs, tables

#: Names of options and what they are by default; None: not given.
OPTIONS: dict[str, object] = {
    "config": None, "from": None, "to": None, "net": None, "mode": None, "epsg": None, "time": None, "from-agg": None, "to-agg": None, "from-types": None, "to-types": None, "pt": None, "traveltimes": None,
    "od-connections": None, "mode-changes": None, "weight": None, "variable": None,
    **{f"{k}.{o}": d for k in ("from", "to", "from-agg", "to-agg") for o, d in (("filter", None), ("id", "id"), ("geom", "geom"), ("boundary", None))},
    "net.vmax": "vmax", "net.vmax-model": "none", "net.geom": "geom", "net.boundary": None, "net.keep-subnets": False, "net.patch-errors": False, "net.incline": False, "pt.boundary": None,
    "max-number": None, "max-distance": None, "max-tt": None, "max-variable-sum": None, "shortest": False, "requirespt": False, "routing-measure": "tt_mode", "routing-measure.param1": 0.0, "routing-measure.param2": 0.0, "crossing-model": "none",
    "prunning.remove-geometries": False, "prunning.remove-dead-ends": False, "prunning.precompute-tt": False, "prunning.join-similar": False,
    "date": None, "entrainment": None, "pt-restriction": None, "foot.vmax": 3.6, "custom.vmax": None, "custom.kkc-per-hour": -1.0, "custom.co2-per-km": -1.0, "custom.price-per-km": -1.0, "custom.allowed": None,
    **{f"{o}-output": None for o in ("od", "ext-od", "stat-od", "pt", "interchanges", "edges", "direct", "process", "origins-to-road", "destinations-to-road", "subnets", "net-errors", "crossings")},
    "dropprevious": False, "precision": 2, "comment": False, "threads": 1, "verbose": False, "net.report-all-errors": False, "subnets-summary": False,
}
MANDATORY = ("from", "to", "net", "mode", "epsg", "time")
#: Old names.
OLD = {"nm-output": "od-output", "ext-nm-output": "ext-od-output", "stat-nm-output": "stat-od-output"}


def parsed(name: str, value: object) -> object:
    """A value as its option has it: switches and numbers from texts."""
    if name not in OPTIONS:
        raise ValueError(f"unknown option {name!r}")
    if not isinstance(value, str):
        return value
    if isinstance(OPTIONS[name], bool):
        return value.strip().lower() in ("true", "1", "yes", "on", "")
    numbers = ("max-distance", "max-tt", "max-variable-sum", "custom.vmax", "time", "routing-measure.param1", "routing-measure.param2", "foot.vmax", "custom.kkc-per-hour", "custom.co2-per-km", "custom.price-per-km")
    return int(value) if name in ("max-number", "precision", "threads", "epsg") else float(value) if name in numbers else value


def options_of(given: dict[str, object]) -> dict[str, object]:
    """All options: those given, then those of the file ``config``, then what they are by default."""
    given = {OLD.get(k, k): v for k, v in given.items()}
    held = read_options(str(given["config"])) if given.get("config") else {}
    return OPTIONS | {k: parsed(k, v) for k, v in (held | given).items()}


def read_options(path: str) -> dict[str, str]:
    return {OLD.get(e.tag, e.tag): (e.text or "").strip() for e in ET.parse(path).getroot()}


def write_options(path: str, options: dict[str, object]) -> None:
    """A file of the options that are given; with all of them it is a template."""
    root = ET.Element("configuration")
    for name, value in options.items():
        ET.SubElement(root, name).text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    ET.indent(root)
    Path(path).write_text(ET.tostring(root, encoding="unicode") + "\n")


def modes_of(o: dict[str, object]) -> list[M.Mode]:
    bits = M.mode_bits(str(o["mode"]))
    out = [M.FOOT._replace(vmax=float(o["foot.vmax"]) / 3.6), M.BIKE, M.CAR, M.BUS]
    out = [m for m in out if bits & m.bit]
    if bits & 1:
        if o["custom.vmax"] is None:
            raise ValueError("custom.vmax is needed")
        out.append(M.custom(float(o["custom.vmax"]), *(float(o[f"custom.{k}"]) for k in ("kkc-per-hour", "co2-per-km", "price-per-km"))))
    return out


class NetworkError(ValueError):
    """A network that can't be used. ``outputs``: what is known of it and asked for, to be written nevertheless."""

    def __init__(self, message: str, outputs: dict[str, DataFrame]):
        super().__init__(message)
        self.outputs = outputs


def compute(spark: SparkSession, given: dict[str, object]) -> dict[str, DataFrame]:
    """The result relations that options ask for, by option, not yet written.

    Limits hold for each origin (and type of destination). Searches end at ``max-tt``, and before it once an origin has
    the destinations that ``shortest``, ``max-number`` or ``max-variable-sum`` ask for; not where that can't be told on
    the way: with given pairs, a largest distance, rides required, delays or speeds by time, or measures besides time.
    """
    o = options_of(given)
    if absent := [n for n in MANDATORY if o[n] is None] + (["date"] if o["pt"] and not o["date"] else []):
        raise ValueError(f"needed: {', '.join(absent)}")
    out: dict[str, DataFrame] = {}
    modes, time = modes_of(o), float(o["time"])
    used = sum(m.bit for m in modes)

    # The network.
    edges = tables.network(spark, str(o["net"]), used, M.mode_bits(str(o["custom.allowed"] or "")), str(o["net.vmax"]), str(o["net.geom"]), bool(o["net.incline"]), int(o["epsg"]))
    edges = edges.withColumns({"from_node": F.col("from_node").cast("string"), "to_node": F.col("to_node").cast("string")})
    if o["net.boundary"]:
        keep = tables.boundary(spark, str(o["net.boundary"]))
        edges = edges.where(F.forall("geom", lambda p: keep(p["x"], p["y"])))
    errors = network.net_errors(edges)
    if o["net-errors-output"]:
        out["net-errors-output"] = sinks.shaped(errors, "net_errors")
    if o["net.patch-errors"]:
        edges = network.patched(edges)
    else:
        # One of each kind stands for the others, unless all are asked for.
        each = errors if o["net.report-all-errors"] else errors.groupBy("description").agg(F.min("edge1").alias("edge1"), F.count("*").alias("n"))
        if told := [f"{r.description}: {r.edge1}" + ("" if "n" not in each.columns or r.n == 1 else f" and {r.n - 1} more") for r in each.orderBy("description", "edge1").toLocalIterator()]:
            raise NetworkError("; ".join(told), out)
    if o["net.incline"]:
        edges = network.inclined(edges)
    if o["net.vmax-model"] != "none":
        edges = edges.withColumn("vmax", M.model_speed(F.col("vmax") * 3.6) / 3.6)
    edges, _ = network.merge_duplicates(edges)
    edges = settled(network.with_opposites(edges, bool(used & M.FOOT.bit)), "net")
    if o["subnets-output"]:
        out["subnets-output"] = sinks.shaped(network.subnets(edges), "subnets")
    if not o["net.keep-subnets"]:
        edges = settled(network.largest_subnet(edges), "net")
    if o["prunning.join-similar"]:
        if len(modes) > 1 or (modes[0].bit == M.CAR.bit and o["traveltimes"]):
            raise ValueError("edges are joined for one mode only, and not with speeds by time")
        edges = settled(network.join_similar(edges).drop("parts"), "joined")
    speeds = tables.speeds(spark, str(o["traveltimes"]), edges) if o["traveltimes"] else None

    # Objects.
    def layer(name: str, var: str | None) -> DataFrame:
        keep = tables.boundary(spark, str(o[f"{name}.boundary"]))(F.col("cx"), F.col("cy")) if o[f"{name}.boundary"] else None
        return tables.layer(spark, str(o[name]), o[f"{name}.filter"], str(o[f"{name}.id"]), str(o[f"{name}.geom"]), var, keep, int(o["epsg"]))

    def areas(name: str, objects: DataFrame) -> DataFrame | str | None:
        if o[name] in (None, "all"):
            return o[name]
        return settled(mapping.area_of(objects, layer(name, None)), name)

    sources = settled(layer("from", o["weight"]).withColumn("weight", F.col("var")), "from")
    goals = settled(layer("to", o["variable"]).withColumn("value", F.col("var")), "to")
    from_agg, to_agg = areas("from-agg", sources), areas("to-agg", goals)

    # Public transport.
    service = None
    if o["pt"]:
        keep = tables.boundary(spark, str(o["pt.boundary"])) if o["pt.boundary"] else None
        service = gtfs.load(spark, str(o["pt"]), int(str(o["date"]).replace("-", "")), int(o["epsg"]), gtfs.carriers_of(str(o["pt-restriction"] or "")), keep)
    rides = hops = transfers = None
    if service:
        stops = service["stops"].select(F.col("stop_id").alias("object_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
        walked = edges.where(F.col("modes").bitwiseAND(F.lit(M.FOOT.bit | M.BIKE.bit)) != 0)
        places = settled(mapping.nearest_edge(stops, walked), "stops")
        edges = settled(transit.connected(edges, stops, places), "connected")
        escorts = tables.escorts(spark, str(o["entrainment"])) if o["entrainment"] else None
        rides, hops, transfers = transit.ride_edges(service["lines"], service["stops"], service["running"], escorts), service["hops"], service["transfers"]
    links = F.col("from_node").startswith("stop ") | F.col("to_node").startswith("stop ")
    ground = edges.where(~links)
    from_road, to_road = (settled(mapping.nearest_edge(df, ground), "mapped") for df in (sources, goals))
    for name, df in (("origins-to-road-output", from_road), ("destinations-to-road-output", to_road)):
        if o[name]:
            at = df.join((sources if name.startswith("o") else goals).select("object_id", "cx", "cy"), "object_id").join(edges.select("edge_id", "geom"), "edge_id")
            out[name] = sinks.shaped(at.withColumn("conn", F.array(G.point(F.col("cx"), F.col("cy")), G.point_at(F.col("geom"), F.col("pos")))), "mapping")
    delays = settled(network.crossing_delays(edges), "delays") if o["crossing-model"] != "none" else None
    if o["crossings-output"]:
        out["crossings-output"] = sinks.shaped(delays if delays is not None else network.crossing_delays(edges), "crossings")
    if o["prunning.remove-dead-ends"]:
        needed = from_road.select("edge_id").union(to_road.select("edge_id")).union(edges.where(links).select("edge_id"))
        edges = settled(network.without_dead_ends(edges, needed), "pruned")

    # Ways.
    changes = None
    if o["mode-changes"]:
        nodes = edges.select(F.col("from_node").alias("node_id")).union(edges.select("to_node"))
        changes = tables.mode_changes(spark, str(o["mode-changes"]), nodes)
    max_tt = float(o["max-tt"]) if o["max-tt"] is not None else float("inf")
    types = tables.types(spark, str(o["to-types"])) if o["to-types"] else None
    number = lambda n, kind: None if o[n] is None else kind(o[n])
    bounds = arrive = None
    told = not any(o[n] for n in ("od-connections", "requirespt", "traveltimes")) and delays is None and o["max-distance"] is None
    if told and o["routing-measure"] in ("tt", "tt_mode") and (o["shortest"] or o["max-number"] is not None or o["max-variable-sum"] is not None):
        first = 1 if o["shortest"] else number("max-number", int)
        kinds = None if types is None else settled(types.select(F.col("id").alias("destination"), "type"), "types")
        enough = Enough(first, None if first is not None else number("max-variable-sum", float), goals.select(F.col("object_id").alias("destination"), "value"), kinds)
        bounds, arrive = transit.ending(enough, from_road, to_road, edges, modes)
    labels = transit.search(transit.starts(from_road, edges, modes, speeds, time), edges, modes, max_tt, rides, hops, transfers, changes, delays, speeds, time, str(o["routing-measure"]), float(o["routing-measure.param1"]), float(o["routing-measure.param2"]), bounds=bounds, arrive=arrive)
    od = transit.od_values(labels, from_road, to_road, edges, modes, max_tt, bool(o["requirespt"]), speeds, delays, time)
    if o["od-connections"]:
        od = od.join(tables.od_pairs(spark, str(o["od-connections"])).distinct(), ["origin", "destination"], "left_semi")
    od = od.join(goals.select(F.col("object_id").alias("destination"), "value"), "destination").join(sources.select(F.col("object_id").alias("origin"), "weight"), "origin")
    by = []
    if types is not None:
        od, by = aggregate.with_types(od, types), ["dest_type"]
    od = settled(limits.limited(od, number("max-tt", float), number("max-distance", float), number("max-number", int), number("max-variable-sum", float), bool(o["shortest"]), by), "od")

    # Results. Aggregated, they have a row for every two keys.
    weights, shortest = sources.select("object_id", "weight"), bool(o["shortest"])
    framed = lambda df: aggregate.framed(df, sources, goals, from_agg, to_agg, shortest, types)
    if o["od-output"]:
        out["od-output"] = sinks.shaped(framed(aggregate.od_measures(od, weights, from_agg, to_agg, shortest, by)), "od")
    if not any(o[f"{n}-output"] for n in ("ext-od", "stat-od", "pt", "interchanges", "edges", "direct", "process")):
        return out
    # A destination of several types has one way.
    pairs = od.drop("dest_type").distinct()
    way = settled(transit.steps(labels, pairs, time), "way")
    if o["ext-od-output"] or o["stat-od-output"]:
        ext = settled(transit.extended(od, way, modes, sources, goals), "extended")
        if o["ext-od-output"]:
            out["ext-od-output"] = sinks.shaped(framed(transit.extended_measures(ext, weights, from_agg, to_agg, by, shortest)), "ext_od")
        if o["stat-od-output"]:
            out["stat-od-output"] = sinks.shaped(aggregate.statistics(ext.withColumn("value", F.col("weight")), ["dist", "tt", "value", "kcal", "price", "co2"], from_agg, to_agg, shortest, by), "stat_od")
    if o["pt-output"]:
        out["pt-output"] = sinks.shaped(framed(transit.pt_measures(od, way, weights, from_agg, to_agg, shortest, by)), "pt")
    if o["interchanges-output"] and rides is not None:
        out["interchanges-output"] = sinks.shaped(transit.interchange_counts(od, way, rides, from_agg, to_agg, shortest, by), "interchanges")
    if o["edges-output"]:
        out["edges-output"] = sinks.shaped(aggregate.edge_use(way.select("origin", "destination", "edge"), od, from_agg, to_agg, shortest, by), "edges")
    if o["direct-output"]:
        shapes = edges.select("edge_id", "opposite_id", "length", "geom", "to_node")
        if rides is not None:
            stop = lambda c: service["stops"].select(transit.stop_node(F.col("stop_id")).alias(c), F.struct("x", "y").alias(f"{c}_p"))
            drawn = rides.join(stop("from_node"), "from_node").join(stop("to_node"), "to_node")
            shapes = shapes.unionByName(drawn.select("edge_id", F.lit(None).cast("string").alias("opposite_id"), "length", F.array("from_node_p", "to_node_p").alias("geom"), "to_node"))
        rows = measures.path_rows(way, shapes, from_road, to_road)
        named = F.lit("pt")
        for m in modes:
            named = F.when(F.col("line").isNull() & (F.col("mode") == m.bit), m.name).otherwise(named)
        rows = rows.join(way.select("origin", "destination", "idx", "line", "mode"), ["origin", "destination", "idx"]).withColumn("mode", named).join(shapes.select(F.col("edge_id").alias("edge"), F.col("to_node").alias("node")), "edge")
        out["direct-output"] = sinks.shaped(rows, "direct")
    if o["process-output"]:
        out["process-output"] = sinks.shaped(transit.effort(labels, pairs, way, edges), "process")
    return out


def run(spark: SparkSession, given: dict[str, object]) -> list[str]:
    """Computes and writes what the options ask for; returns the outputs written. The errors of a network that can't be
    used are written before the error is raised."""
    o, refused = options_of(given), None
    try:
        results = compute(spark, given)
    except NetworkError as e:
        results, refused = e.outputs, e
    comment = ", ".join(f"{k}={v}" for k, v in o.items() if v is not None) if o["comment"] else None
    for name, df in results.items():
        sinks.write(df, str(o[name]), int(o["precision"]), comment)
    if refused:
        raise refused
    return sorted(results)
