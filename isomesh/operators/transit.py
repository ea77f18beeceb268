"""Search over several modes and public transport.

Nodes are texts here: a node of the road network by its id, a stop as ``stop <id>``, a place where a road was cut as
``<road>@<number>``. Roads: edge_id, opposite_id, from_node, to_node, modes, vmax, length, geom, [incline]. Rides:
edge_id, from_node, to_node, modes, length, line. Labels are kept for each (origin, node, mode).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.functions.modes import BIKE, BUS, FARE, FOOT, Mode, price, travel_time
from isomesh.operators.aggregate import keyed, normed, safe
from isomesh.operators.state import Shelf, settled
from isomesh.operators.ways import Bounds, Enough, chains

#: Speed on the links between road and stop, and of rides, in m/s; their least length in metres.
LINK_VMAX, RIDE_VMAX, LEAST_LENGTH = 50.0, 80 / 3.6, 0.1
MEASURES = ("tt", "tt_mode", "price_tt", "interchanges_tt", "maxinterchanges_tt")


def stop_node(stop: Column) -> Column:
    return F.concat(F.lit("stop "), stop.cast("string"))


def stop_places(mapped: DataFrame, edges: DataFrame, apart: float = 1.0) -> DataFrame:
    """object_id, dist, road, place, k: where stops are joined to roads. mapped: object_id, edge_id, pos, dist.

    A road is an edge with its opposite, under the smaller id and in its direction. Stops that follow each other within
    ``apart`` metres share a place, that of the last of them; k counts the places of a road from 1.
    """
    e = edges.select(F.col("edge_id").alias("e"), "opposite_id", "length")
    road = F.least("e", F.coalesce("opposite_id", "e"))
    on = mapped.join(e, F.col("edge_id") == F.col("e")).select("object_id", "dist", road.alias("road"), F.when(road == F.col("e"), F.col("pos")).otherwise(F.col("length") - F.col("pos")).alias("at"))
    by = Window.partitionBy("road").orderBy("at", "object_id")
    on = on.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(by) > apart, F.lit(True)).cast("int"))
    on = on.withColumn("k", F.sum("new").over(by))
    return on.select("object_id", "dist", "road", F.max("at").over(Window.partitionBy("road", "k")).alias("place"), F.col("k").cast("int").alias("k"))


def connected(edges: DataFrame, stops: DataFrame, mapped: DataFrame, access: int = FOOT.bit | BIKE.bit) -> DataFrame:
    """The network with stops joined to it: roads are cut where stops are, and links ``on-<stop>`` and ``off-<stop>``
    lead to and from them. stops: object_id, cx, cy; mapped: as ``nearest_edge`` gives it.

    Roads that were cut are replaced by pieces ``<edge>#<i>``, i from 0 in the edge's direction. Nodes become texts.
    """
    places = settled(stop_places(mapped, edges), "places")
    cuts = places.groupBy(F.col("road").alias("c")).agg(F.array_sort(F.collect_set(F.struct("k", "place"))).alias("cuts"))
    e = edges.withColumn("road", F.least("edge_id", F.coalesce("opposite_id", "edge_id"))).join(cuts, F.col("road") == F.col("c"), "left")
    n = F.coalesce(F.size("cuts"), F.lit(0))
    ahead = F.col("edge_id") == F.col("road")
    whole = F.coalesce("cuts", F.array().cast("array<struct<k:int,place:double>>"))
    inner = F.when(ahead, F.transform(whole, lambda c: F.struct(F.concat(F.col("road"), F.lit("@"), c["k"].cast("string")).alias("node"), c["place"].alias("at")))).otherwise(
        F.reverse(F.transform(whole, lambda c: F.struct(F.concat(F.col("road"), F.lit("@"), c["k"].cast("string")).alias("node"), (F.col("length") - c["place"]).alias("at"))))
    )
    ends = F.concat(F.array(F.struct(F.col("from_node").cast("string").alias("node"), F.lit(0.0).alias("at"))), inner, F.array(F.struct(F.col("to_node").cast("string").alias("node"), F.col("length").alias("at"))))
    e = e.withColumns({"n": n, "ends": ends}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    a, b = F.col("ends")[F.col("i")], F.col("ends")[F.col("i") + 1]
    cut = F.col("n") > 0
    slope = [F.col("incline")] if "incline" in edges.columns else []
    roads = e.select(
        F.when(cut, F.concat("edge_id", F.lit("#"), F.col("i").cast("string"))).otherwise(F.col("edge_id")).alias("edge_id"),
        F.when(cut, F.concat("opposite_id", F.lit("#"), (F.col("n") - F.col("i")).cast("string"))).otherwise(F.col("opposite_id")).alias("opposite_id"),
        a["node"].alias("from_node"), b["node"].alias("to_node"), "modes", "vmax",
        F.when(cut, F.greatest(b["at"] - a["at"], F.lit(LEAST_LENGTH))).otherwise(F.col("length")).alias("length"),
        F.when(cut, G.part(F.col("geom"), a["at"], b["at"])).otherwise(F.col("geom")).alias("geom"), *slope,
    )
    road = edges.select(F.col("edge_id").alias("r"), F.col("geom").alias("r_geom"))
    at = places.join(road, F.col("road") == F.col("r")).join(stops.select(F.col("object_id").alias("s"), "cx", "cy"), F.col("object_id") == F.col("s"))
    here, there = G.point_at(F.col("r_geom"), F.col("place")), G.point(F.col("cx"), F.col("cy"))
    node, stop = F.concat("road", F.lit("@"), F.col("k").cast("string")), stop_node(F.col("object_id"))
    name = lambda way: F.concat(F.lit(f"{way}-"), F.col("object_id").cast("string"))
    link = lambda way, back, u, v, p, q: at.select(
        name(way).alias("edge_id"), name(back).alias("opposite_id"), u.alias("from_node"), v.alias("to_node"), F.lit(access).cast("bigint").alias("modes"), F.lit(LINK_VMAX).alias("vmax"),
        F.greatest("dist", F.lit(LEAST_LENGTH)).alias("length"), F.array(p, q).cast(G.POINTS).alias("geom"), *(F.lit(0.0).alias("incline") for _ in slope),
    )
    return roads.unionByName(link("on", "off", node, stop, here, there)).unionByName(link("off", "on", stop, node, there, here))


def ride_edges(lines: DataFrame, stops: DataFrame, running: DataFrame, escorts: DataFrame | None = None) -> DataFrame:
    """Rides for ``gtfs.line_edges``: on foot, and with the modes that the carrier takes along; as long as the beeline.

    stops: stop_id, x, y; running: route_id, route_type; escorts: carrier, subtype, modes.
    """
    at = lambda s: stops.select(F.col("stop_id").alias(f"{s}_id"), F.struct("x", "y").alias(f"{s}_p"))
    kinds = running.select("route_id", "route_type").distinct()
    rows = lines.join(at("a"), F.col("from_stop") == F.col("a_id")).join(at("b"), F.col("to_stop") == F.col("b_id")).join(kinds, "route_id")
    taken = F.lit(0).cast("bigint")
    if escorts is not None:
        rows = rows.join(escorts.where("carrier = 'pt'").select("subtype", F.col("modes").alias("taken")), F.col("route_type") == F.col("subtype"), "left")
        taken = F.coalesce("taken", F.lit(0).cast("bigint"))
    # Lines of one name between the same stops are one edge.
    rows = rows.groupBy("edge_id").agg(F.min(F.struct("from_stop", "to_stop", "a_p", "b_p")).alias("s"), F.bit_or(taken).alias("taken"), F.min("route_id").alias("line"))
    return rows.select("edge_id", stop_node(F.col("s.from_stop")).alias("from_node"), stop_node(F.col("s.to_stop")).alias("to_node"), F.col("taken").bitwiseOR(F.lit(FOOT.bit)).alias("modes"), F.lit(RIDE_VMAX).alias("vmax"), G.distance(F.col("s.a_p"), F.col("s.b_p")).alias("length"), "line")


def in_time(hops: DataFrame, time: float, max_tt: float, transfers: DataFrame | None = None) -> DataFrame:
    """The hops that a search from ``time`` on can use: they leave no sooner, and arrive within ``max_tt`` seconds. A
    transfer of less than no time lets later ones arrive in time too."""
    early = transfers.agg(F.min("seconds")).first()[0] if transfers is not None else None
    return hops.where((F.col("dep") >= time) & (F.col("arr") - time + min(float(early or 0), 0.0) <= max_tt))


def departures(hops: DataFrame, since: int = 0) -> DataFrame:
    """edge, hour, list, later: for every hour from ``since`` until its last departure, what still leaves an edge. hops:
    edge_id, dep, arr, trip_id; none leaves before that hour.

    Every departure carries the connection that arrives first of those that leave then or later; ``later`` is that of
    the hours after. So a label looks at the departures of one hour only.
    """
    hop = F.struct("arr", "dep", "trip_id")
    by = Window.partitionBy("edge_id").orderBy(F.desc("dep")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = hops.select("edge_id", "dep", F.min(hop).over(by).alias("best")).distinct().withColumn("hour", F.floor(F.col("dep") / 3600))
    lists = best.groupBy("edge_id", "hour").agg(F.array_sort(F.collect_list(F.struct("dep", "best"))).alias("list"))
    hours = lists.groupBy("edge_id").agg(F.max("hour").alias("last")).select("edge_id", F.explode(F.sequence(F.lit(since).cast("bigint"), F.col("last"))).alias("hour"))
    after = Window.partitionBy("edge_id").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    full = hours.join(lists, ["edge_id", "hour"], "left").withColumn("later", F.min(F.col("list")[0]["best"]).over(after))
    return full.select(F.col("edge_id").alias("d_edge"), "hour", "list", "later")


def by_mode(modes: list[Mode], of, mode: Column) -> Column:
    out = F.lit(None).cast("double")
    for m in modes:
        out = F.when(mode == m.bit, of(m)).otherwise(out)
    return out


def with_spells(edges: DataFrame, key: str, speeds: DataFrame | None, name: str = "spells") -> DataFrame:
    """``edges`` with the list of the times of day at which the edge ``key`` has a measured speed; null without any."""
    if speeds is None:
        return edges.withColumn(name, F.lit(None).cast("array<struct<ibegin:double,iend:double,speed:double>>"))
    spell = F.struct(*(F.col(c).cast("double").alias(c) for c in ("ibegin", "iend", "speed")))
    lists = speeds.groupBy(F.col("edge_id").alias("s_edge")).agg(F.array_sort(F.collect_list(spell)).alias(name))
    return edges.join(lists, F.col(key) == F.col("s_edge"), "left").drop("s_edge")


def driven(modes: list[Mode], vmax: Column, length: Column, at: Column, spells: Column) -> Column:
    """Seconds for an edge that is entered at a time of day; the first spell that holds then counts."""
    now = F.try_element_at(F.filter(spells, lambda s: (s["ibegin"] <= at) & (at <= s["iend"])), F.lit(1))["speed"]
    return by_mode(modes, lambda m: travel_time(length, vmax, m, now), F.col("mode"))


def starts(mapped: DataFrame, edges: DataFrame, modes: list[Mode], speeds: DataFrame | None = None, time: float = 0.0) -> DataFrame:
    """origin, node, mode, tt, dist, edge: both ways off the origin's edge, by each mode that may go there, at the speeds
    measured at ``time`` if there are any."""
    e = with_spells(edges.select("edge_id", "to_node", "modes", "vmax", "length", "opposite_id"), "edge_id", speeds)
    o = with_spells(edges.select(F.col("edge_id").alias("o_id"), F.col("to_node").alias("o_to"), F.col("modes").alias("o_modes"), F.col("vmax").alias("o_vmax")), "o_id", speeds, "o_spells")
    on = mapped.select(F.col("object_id").alias("origin"), F.col("edge_id").alias("m"), "pos").join(e, F.col("m") == F.col("edge_id"))
    on = on.withColumn("mode", F.explode(F.array(*(F.lit(m.bit) for m in modes))))
    ride = lambda vmax, spells: driven(modes, F.col(vmax), F.col("length"), F.lit(float(time)), F.col(spells))
    part = (F.col("length") - F.col("pos")) / F.col("length")
    ahead = on.where(F.col("modes").bitwiseAND(F.col("mode")) != 0).select("origin", F.col("to_node").cast("string").alias("node"), "mode", (ride("vmax", "spells") * part).alias("tt"), (F.col("length") - F.col("pos")).alias("dist"), F.col("edge_id").alias("edge"))
    back = on.join(o, F.col("opposite_id") == F.col("o_id")).where(F.col("o_modes").bitwiseAND(F.col("mode")) != 0)
    return ahead.union(back.select("origin", F.col("o_to").cast("string"), "mode", ride("o_vmax", "o_spells") * F.col("pos") / F.col("length"), F.col("pos"), F.col("o_id")))


def order(measure: str, modes: list[Mode], param1: float, param2: float) -> list[Column]:
    """What labels are compared by, smallest first."""
    n = F.col("interchanges").cast("double")
    return {
        "tt": [F.col("tt"), F.lit(0.0)],
        "tt_mode": [F.col("tt"), -by_mode(modes, lambda m: F.lit(m.vmax), F.col("mode"))],
        "price_tt": [F.col("price"), F.col("tt")],
        "interchanges_tt": [F.col("tt") + (F.exp(n * param1) - 1) * param2, F.lit(0.0)],
        "maxinterchanges_tt": [(n > param1).cast("double"), F.col("tt")],
    }[measure]


#: What a label holds beside its key, in the order in which labels of equal measure are preferred.
LABEL = ["tt", "dist", "edge", "before", "before_mode", "by", "trip", "last_trip", "line", "interchanges", "price", "ttt", "interchange", "departure", "run", "round"]


def search(start: DataFrame, edges: DataFrame, modes: list[Mode], max_tt: float, rides: DataFrame | None = None, hops: DataFrame | None = None, transfers: DataFrame | None = None, changes: DataFrame | None = None, delays: DataFrame | None = None, speeds: DataFrame | None = None, time: float = 0.0, measure: str = "tt", param1: float = 0.0, param2: float = 0.0, compat: bool = False, bounds: Bounds | None = None, arrive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best label of each (origin, node, mode) within ``max_tt`` seconds after ``time``.

    Columns: origin, node, mode and LABEL without round: time, distance and the last edge; the node and mode before it;
    ``by``, the mode on it; the trip on it, the last trip so far and the line; how often a ride was begun; the price;
    the time, change time, departure and length of the last edge.

    A ride takes the connection that arrives first; a timed transfer (stop_id, from_trip, to_trip, seconds) from the
    trip before is added to it. Roads take their speed at the time at which they are entered (speeds: edge_id, ibegin,
    iend, speed) and a delay after the edge before (from_edge, to_edge, delay). changes: node_id, from_mode, to_mode,
    duration, price; their costs apply but under ``compat``. Prices are summed along the way.

    Rounds correct labels until none changes. They are the best ways where a better label never leads to a worse one
    behind it: by time without transfers, delays and sinking speeds. Otherwise a node's label is the best of all offers
    made while its neighbours' labels improved, as in a search that keeps one label for a node and mode. Ties: the
    smaller distance, then the smaller edge. A round writes the labels that it improves and no others.

    With ``bounds``, and ``arrive``, which makes origin, destination and tt of labels, an origin's search ends when it has
    found enough. That changes no result where labels are compared by time, which is why other measures don't take it.
    Prices by which ways are compared must not be negative: a way to and fro would get ever cheaper.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    if bounds and measure not in ("tt", "tt_mode"):
        raise ValueError(f"a search by {measure} can't end early")
    if measure == "price_tt" and ((unset := [m.name for m in modes if m.price < 0]) or (changes is not None and not compat and changes.where("price < 0").limit(1).count())):
        raise ValueError(f"negative or unset prices: {', '.join(unset) or 'changes of mode'}")
    keys = ["origin", "node", "mode"]
    first, second = order(measure, modes, param1, param2)

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(F.struct(first.alias("k1"), second.alias("k2"), *LABEL)).alias("l")).select(*keys, *(f"l.{c}" for c in LABEL))

    text = lambda n: F.lit(None).cast("string").alias(n)
    out = edges.select(F.col("from_node").cast("string").alias("node"), F.col("to_node").cast("string").alias("next"), F.col("edge_id").alias("e"), F.col("modes").alias("e_modes"), F.col("vmax").alias("e_vmax"), F.col("length").alias("e_length"))
    out = settled(with_spells(out, "e", speeds), "out")
    now = F.lit(float(time)) + F.col("tt")
    drive = driven(modes, F.col("e_vmax"), F.col("e_length"), now, F.col("spells"))
    if rides is not None:
        leaving = settled(departures(in_time(hops, time, max_tt, transfers), int(time // 3600)), "departures")
        used = rides.join(leaving.select(F.col("d_edge").alias("edge_id")).distinct(), "edge_id", "left_semi")
        board = settled(used.select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.col("edge_id").alias("e"), F.col("modes").alias("e_modes"), F.col("length").alias("e_length"), F.col("line").alias("e_line")), "board")
    turns = None if delays is None else settled(turn_delays(delays), "turns")
    waits = None if transfers is None else settled(transfers.groupBy(stop_node(F.col("stop_id")).alias("t_node"), F.col("from_trip").alias("t_from"), F.col("to_trip").alias("t_to")).agg(F.min("seconds").cast("double").alias("seconds")), "waits")

    fare = by_mode(modes, lambda m: price(F.col("run"), m), F.col("mode"))
    begin = start.where(F.col("tt") <= max_tt).withColumn("run", F.col("dist"))
    begin = begin.select(*keys, "tt", "dist", "edge", text("before"), F.lit(None).cast("int").alias("before_mode"), F.col("mode").alias("by"), text("trip"), text("last_trip"), text("line"), F.lit(0).alias("interchanges"), fare.alias("price"), F.col("tt").alias("ttt"), F.lit(0.0).alias("interchange"), F.lit(None).cast("double").alias("departure"), "run", F.lit(0).alias("round"))
    log, turn = Shelf(start.sparkSession, "labels"), 0
    front = log.put(0, least(begin))
    while not front.isEmpty():
        if bounds:
            bounds.add(arrive(front))
            front = bounds.within(front)
        turn += 1
        may = F.col("e_modes").bitwiseAND(F.col("mode")) != 0
        road = front.join(out, "node").where(may)
        road = road.withColumn("delay", F.lit(0.0)) if turns is None else road.join(turns, ["edge", "e"], "left").withColumn("delay", F.coalesce("delay", F.lit(0.0)))
        road = road.withColumns({"took": drive + F.col("delay"), "cost": by_mode(modes, lambda m: price(F.col("e_length"), m), F.col("mode"))})
        offers = road.select("origin", F.col("next").alias("node"), "mode", (F.col("tt") + F.col("took")).alias("tt"), (F.col("dist") + F.col("e_length")).alias("dist"), F.col("e").alias("edge"), F.col("node").alias("before"), F.col("mode").alias("before_mode"), F.col("mode").alias("by"), text("trip"), "last_trip", text("line"), "interchanges", (F.col("price") + F.col("cost")).alias("price"), F.col("took").alias("ttt"), F.lit(0.0).alias("interchange"), F.lit(None).cast("double").alias("departure"), F.col("e_length").alias("run"), F.lit(turn).alias("round"))
        if rides is not None:
            at = front.join(board, "node").where(may).withColumn("at_hour", F.floor(now / 3600)).join(leaving, (F.col("e") == F.col("d_edge")) & (F.col("at_hour") == F.col("hour")))
            at = at.withColumn("hop", F.coalesce(F.try_element_at(F.filter("list", lambda d: d["dep"] >= now), F.lit(1))["best"], F.col("later"))).where("hop is not null")
            at = at.withColumn("seconds", F.lit(0.0)) if waits is None else at.join(waits, (F.col("node") == F.col("t_node")) & (F.col("trip") == F.col("t_from")) & (F.col("hop.trip_id") == F.col("t_to")) & (F.col("t_from") != F.col("t_to")), "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
            arrived = F.col("hop.arr") - F.lit(float(time)) + F.col("seconds")
            other = ~F.col("last_trip").eqNullSafe(F.col("hop.trip_id"))
            offers = offers.union(at.select("origin", F.col("next"), "mode", arrived, F.col("dist") + F.col("e_length"), F.col("e"), F.col("node"), F.col("mode"), F.col("mode"), F.col("hop.trip_id"), F.col("hop.trip_id"), F.col("e_line"), F.col("interchanges") + other.cast("int"), F.col("price") + F.when(F.col("last_trip").isNull(), FARE).otherwise(0.0), arrived - F.col("tt"), F.col("seconds"), F.col("hop.dep").cast("double"), F.col("e_length"), F.lit(turn)))
        if changes is not None:
            c = changes.select(F.col("node_id").cast("string").alias("node"), F.col("from_mode").alias("mode"), "to_mode", F.lit(0.0).alias("c_time") if compat else F.col("duration").alias("c_time"), F.lit(0.0).alias("c_price") if compat else F.col("price").alias("c_price"))
            offers = offers.union(front.join(c, ["node", "mode"]).select("origin", "node", F.col("to_mode").alias("mode"), F.col("tt") + F.col("c_time"), "dist", "edge", "before", "before_mode", "by", "trip", "last_trip", "line", "interchanges", F.col("price") + F.col("c_price"), F.col("ttt") + F.col("c_time"), "interchange", "departure", "run", F.lit(turn)))
        made = offers.where(F.col("tt") <= max_tt)
        made = least(bounds.within(made) if bounds else made)
        # A node's later label is better than all before.
        rank = lambda: F.struct(first, second, *LABEL[:-1])
        held = log.all().select(*keys, rank().alias("rank")).groupBy(*keys).agg(F.min("rank").alias("held"))
        front = log.put(turn, made.join(held, keys, "left").where(F.col("held").isNull() | (rank() < F.col("held"))).select(*keys, *LABEL))
    return least(log.all()).drop("round")


def turn_delays(delays: DataFrame) -> DataFrame:
    return delays.groupBy(F.col("from_edge").alias("edge"), F.col("to_edge").alias("e")).agg(F.max("delay").alias("delay"))


def ways_to(destinations: DataFrame, edges: DataFrame, speeds: DataFrame | None = None) -> DataFrame:
    """destination, node, end_edge, w_modes, w_vmax, w_length, end_run, w_spells: from where, and along which edge, each
    destination is reached; on its own edge, and on the opposite of that."""
    e = edges.select("edge_id", F.col("from_node").cast("string").alias("from_node"), "modes", "vmax", "length", "opposite_id")
    d = destinations.select(F.col("object_id").alias("destination"), F.col("edge_id").alias("d_edge"), F.col("pos").alias("d_pos")).join(e, F.col("d_edge") == F.col("edge_id"))
    o = e.select(F.col("edge_id").alias("o_id"), F.col("from_node").alias("o_from"), F.col("modes").alias("o_modes"), F.col("vmax").alias("o_vmax"))
    both = d.join(o, F.col("opposite_id") == F.col("o_id"), "left")
    ways = both.select("destination", F.col("from_node").alias("node"), F.col("edge_id").alias("end_edge"), F.col("modes").alias("w_modes"), F.col("vmax").alias("w_vmax"), F.col("length").alias("w_length"), F.col("d_pos").alias("end_run"))
    ways = ways.union(both.where("o_id is not null").select("destination", "o_from", "o_id", "o_modes", "o_vmax", "length", F.col("length") - F.col("d_pos")))
    return with_spells(ways, "end_edge", speeds, "w_spells")


def arrivals(labels: DataFrame, ways: DataFrame, modes: list[Mode], delays: DataFrame | None = None, time: float = 0.0) -> DataFrame:
    """Labels with the ways on from them, and ``ride``: the seconds on the last edge, at the speed that holds when it is
    entered, after the delay onto it; of both the share of the edge that is used."""
    met = labels.join(ways, "node").where(F.col("w_modes").bitwiseAND(F.col("mode")) != 0)
    met = met.withColumn("delay", F.lit(0.0)) if delays is None else met.join(turn_delays(delays).withColumnRenamed("e", "end_edge"), ["edge", "end_edge"], "left").fillna(0.0, ["delay"])
    whole = driven(modes, F.col("w_vmax"), F.col("w_length"), F.lit(float(time)) + F.col("tt"), F.col("w_spells")) + F.col("delay")
    return met.withColumn("ride", whole * F.col("end_run") / F.col("w_length"))


def along(origins: DataFrame, destinations: DataFrame, edges: DataFrame, modes: list[Mode], speeds: DataFrame | None = None, time: float = 0.0) -> DataFrame:
    """origin, destination, tt, dist, interchanges, node, mode, end_edge, run, ride, behind: ways on the origin's edge."""
    e = with_spells(edges.select("edge_id", "modes", "vmax", "length", "opposite_id"), "edge_id", speeds)
    d = destinations.select(F.col("object_id").alias("destination"), F.col("edge_id").alias("d_edge"), F.col("pos").alias("d_pos")).join(e, F.col("d_edge") == F.col("edge_id")).drop("d_edge")
    mine = origins.select(F.col("object_id").alias("origin"), F.col("edge_id").alias("m_edge"), F.col("pos").alias("o_pos"))
    on = d.join(mine, F.col("m_edge") == F.col("edge_id")).withColumn("there", F.col("o_pos"))
    on = on.union(d.join(mine, F.col("m_edge") == F.col("opposite_id")).withColumn("there", F.col("length") - F.col("o_pos")))
    on = on.withColumn("mode", F.explode(F.array(*(F.lit(m.bit) for m in modes)))).where(F.col("modes").bitwiseAND(F.col("mode")) != 0).withColumn("run", F.abs(F.col("d_pos") - F.col("there")))
    ride = driven(modes, F.col("vmax"), F.col("length"), F.lit(float(time)), F.col("spells")) * F.col("run") / F.col("length")
    behind = F.col("opposite_id").isNull() & (F.col("there") > F.col("d_pos"))
    return on.select("origin", "destination", ride.alias("tt"), F.col("run").alias("dist"), F.lit(0).alias("interchanges"), F.lit(None).cast("string").alias("node"), "mode", F.col("edge_id").alias("end_edge"), "run", ride.alias("ride"), behind.alias("behind"))


def od_values(labels: DataFrame, origins: DataFrame, destinations: DataFrame, edges: DataFrame, modes: list[Mode], max_tt: float, requires_ride: bool = False, speeds: DataFrame | None = None, delays: DataFrame | None = None, time: float = 0.0) -> DataFrame:
    """origin, destination, dist, tt, interchanges, node, mode, end_edge, run, ride: the quickest way to each
    destination. node and mode are of the label before the destination's edge (null: it lies on the origin's edge).

    ``requires_ride`` keeps ways with public transport only. Speeds and delays apply to the last edge as to all others.
    Ties: the smaller distance, then fewer interchanges.
    """
    rest = ["dist", "interchanges", "node", "mode", "end_edge", "run", "ride", "behind"]
    through = arrivals(labels, ways_to(destinations, edges, speeds), modes, delays, time)
    found = through.select("origin", "destination", (F.col("tt") + F.col("ride")).alias("tt"), (F.col("dist") + F.col("end_run")).alias("dist"), "interchanges", "node", "mode", "end_edge", F.col("end_run").alias("run"), "ride", F.lit(False).alias("behind"))
    found = found.where("interchanges > 0") if requires_ride else found.unionByName(along(origins, destinations, edges, modes, speeds, time))
    least = found.groupBy("origin", "destination").agg(F.min(F.struct("tt", *rest)).alias("l"))
    return least.where(~F.col("l.behind") & (F.col("l.tt") <= max_tt)).select("origin", "destination", "l.tt", *(f"l.{c}" for c in rest if c != "behind"))


def ending(enough: Enough, origins: DataFrame, destinations: DataFrame, edges: DataFrame, modes: list[Mode]) -> tuple[Bounds, Callable[[DataFrame], DataFrame]]:
    """What ``search`` needs to end early: the bounds by what lies on the origins' own edges, and how labels arrive.

    For searches whose labels only ever get quicker, and with them what lies behind: without turn delays and speeds by
    time, and where every way found counts.
    """
    ways = settled(ways_to(destinations, edges), "ways")
    direct = settled(along(origins, destinations, edges, modes), "direct")
    arrive = lambda labels: arrivals(labels, ways, modes).select("origin", "destination", (F.col("tt") + F.col("ride")).alias("tt"))
    return Bounds(enough, direct.where("not behind"), direct.where("behind")), arrive


def steps(labels: DataFrame, od: DataFrame, time: float = 0.0) -> DataFrame:
    """origin, destination, idx, edge, line, trip, mode, tt, ttt, run, wait, interchange: the edges of every way from the
    origin on, with the time and the length used of each, and the wait before a ride. Ways of n edges take about log2(n)
    rounds."""
    cols = ["edge", "line", "trip", "by", "tt", "ttt", "run", "interchange", "departure"]
    back = settled(labels.select("origin", "node", "mode", "before", "before_mode", *cols), "back")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    out = od.select("origin", "destination", F.lit(0).alias("step"), F.col("end_edge").alias("edge"), none("string", "line"), none("string", "trip"), F.col("mode").alias("by"), "tt", F.col("ride").alias("ttt"), "run", F.lit(0.0).alias("interchange"), none("double", "departure"))
    rows = chains(back.select("origin", "node", "mode", "before", "before_mode"), od.where("node is not null").select("origin", "destination", "node", "mode"), ["origin", "node", "mode"], ["before", "before_mode"])
    rows = rows.select("origin", "destination", F.col("at_node").alias("node"), F.col("at_mode").alias("mode"), (F.col("step") + 1).alias("step"))
    out = out.unionByName(rows.join(back, ["origin", "node", "mode"]).select("origin", "destination", "step", *cols))
    by = Window.partitionBy("origin", "destination").orderBy(F.desc("step"))
    boards = F.col("trip").isNotNull() & ~F.lag("trip").over(by).eqNullSafe(F.col("trip"))
    ready = F.lit(float(time)) + F.coalesce(F.lag("tt").over(by), F.lit(0.0))
    return out.select("origin", "destination", (F.row_number().over(by) - 1).alias("idx"), "edge", "line", "trip", F.col("by").alias("mode"), "tt", "ttt", "run", F.when(boards, F.col("departure") - ready).otherwise(0.0).alias("wait"), "interchange")


LEGS = ("access_distance", "access_tt", "egress_distance", "egress_tt", "interchange_distance", "interchange_tt", "pt_distance", "pt_tt", "num_interchanges", "waiting_time", "init_waiting_time")


def legs(way: DataFrame) -> DataFrame:
    """origin, destination and LEGS: what each way spends on foot or wheels before, between and after rides, and in them.

    A leg is a row of edges without rides, or of edges on one trip. Without a ride there is neither access nor egress.
    The wait before a ride counts as waiting and not as riding; the first wait is also given by itself. Timed transfers
    count as change time as well as in the ride that follows them.
    """
    by = Window.partitionBy("origin", "destination").orderBy("idx")
    new = F.coalesce(~F.lag("trip").over(by).eqNullSafe(F.col("trip")), F.lit(True)) | (F.col("idx") == 0)
    rows = way.withColumn("leg", F.sum(new.cast("int")).over(by))
    parts = rows.groupBy("origin", "destination", "leg").agg(F.min("trip").alias("trip"), F.sum("run").alias("run"), F.sum("ttt").alias("ttt"), F.sum("wait").alias("wait"), F.sum("interchange").alias("change"))
    ways = Window.partitionBy("origin", "destination")
    rode = F.col("trip").isNotNull()
    parts = parts.withColumns({"first": F.min(F.when(rode, F.col("leg"))).over(ways), "last": F.max(F.when(rode, F.col("leg"))).over(ways)})
    of = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    before, after, between = F.col("leg") < F.col("first"), F.col("leg") > F.col("last"), ~rode & F.col("leg").between(F.col("first"), F.col("last"))
    return parts.groupBy("origin", "destination").agg(
        of(before, "run").alias("access_distance"), of(before, "ttt").alias("access_tt"), of(after, "run").alias("egress_distance"), of(after, "ttt").alias("egress_tt"),
        of(between, "run").alias("interchange_distance"), (of(between, "ttt") + F.sum("change")).alias("interchange_tt"), of(rode, "run").alias("pt_distance"), (of(rode, "ttt") - F.sum("wait")).alias("pt_tt"),
        F.greatest(F.count_distinct("trip") - 1, F.lit(0)).cast("double").alias("num_interchanges"), F.sum("wait").alias("waiting_time"), of(F.col("leg") == F.col("first"), "wait").alias("init_waiting_time"),
    )


def pt_measures(od: DataFrame, way: DataFrame, origins: DataFrame, from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, shortest: bool = False, by: list[str] | None = None) -> DataFrame:
    """fid, sid, [by], avg_distance, avg_tt, avg_<m> of LEGS, avg_num, avg_value. od: origin, destination, dist, tt, value,
    weight; way: as ``steps`` gives it. Without origin aggregation, weights count as 1."""
    w = F.lit(1.0) if from_agg is None else F.col("weight")
    by = by or []
    pairs = keyed(od.withColumn("w_", w).join(legs(way), ["origin", "destination"]), from_agg, to_agg, shortest)
    sums = pairs.groupBy("fid", "sid", *by).agg(F.sum("w_").alias("n_"), F.sum(F.col("value") * F.col("w_")).alias("v_"), *(F.sum(F.col(c) * F.col("w_")).alias(f"s_{c}") for c in ("dist", "tt", *LEGS)))
    sums = normed(sums, origins, from_agg)
    names = {"dist": "distance"}
    return sums.select("fid", "sid", *by, *(safe(F.col(f"s_{c}"), F.col("n_")).alias(f"avg_{names.get(c, c)}") for c in ("dist", "tt", *LEGS)), (F.col("n_") / F.col("total")).alias("avg_num"), (F.col("v_") / F.col("total")).alias("avg_value"))


def interchange_counts(od: DataFrame, way: DataFrame, edges: DataFrame, from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, shortest: bool = False, by: list[str] | None = None) -> DataFrame:
    """fid, sid, halt, line_from, line_to, [by], num, tt: how often ways change from one trip to another where the next ride
    begins, and how long that takes on average: from the end of a ride to the begin of the next, without the wait.

    edges: the rides' edge_id and from_node.
    """
    by, along = by or [], Window.partitionBy("origin", "destination").orderBy("idx")
    rows = way.withColumn("walked", F.sum(F.when(F.col("trip").isNull(), F.col("ttt")).otherwise(0.0)).over(along))
    rode = rows.where("trip is not null").withColumns({"line_from": F.lag("line").over(along), "trip_from": F.lag("trip").over(along), "walked_from": F.lag("walked").over(along)})
    changed = rode.where(F.col("trip_from").isNotNull() & (F.col("trip_from") != F.col("trip")))
    halts = edges.select(F.col("edge_id").alias("h"), F.regexp_replace("from_node", "^stop ", "").alias("halt"))
    changed = changed.join(halts, F.col("edge") == F.col("h")).join(od.select(F.col("origin").alias("a"), F.col("destination").alias("b"), *by), (F.col("origin") == F.col("a")) & (F.col("destination") == F.col("b")))
    took = F.col("walked") - F.col("walked_from") + F.col("interchange")
    return keyed(changed, from_agg, to_agg, shortest).groupBy("fid", "sid", "halt", "line_from", F.col("line").alias("line_to"), *by).agg(F.count("*").alias("num"), F.avg(took).alias("tt"))


def effort(labels: DataFrame, od: DataFrame, way: DataFrame, edges: DataFrame) -> DataFrame:
    """fid, duration, path_length, seen_edges, seen_nodes: a row for each way found, with the edges and nodes that the
    origin's search met. All origins are searched at once, so a duration of one is not known: null."""
    per = labels.select("origin", "node").distinct().join(edges.groupBy(F.col("from_node").cast("string").alias("node")).agg(F.count("*").alias("n")), "node", "left")
    per = per.groupBy("origin").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen_edges"), F.count("*").alias("seen_nodes"))
    long = way.groupBy("origin", "destination").agg(F.count("*").alias("path_length"))
    return od.select("origin", "destination").join(long, ["origin", "destination"]).join(per, "origin").select(F.col("origin").alias("fid"), F.lit(None).cast("bigint").alias("duration"), "path_length", "seen_edges", "seen_nodes")


#: Measures of a way beside distance and time, in the order of the result relation.
EXTENDED = ("kcal", "price", "co2", "interchanges", "access", "egress", "waiting_time", "init_waiting_time", "pt_tt", "pt_interchange_time", "beeline_distance", "manhattan_distance")


def extended(od: DataFrame, way: DataFrame, modes: list[Mode], origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """od with EXTENDED and ``lines``, the lines and modes used, in order. origins, destinations: object_id, cx, cy.

    Energy goes by the time, emissions and prices by the length of each edge; in rides by the rates of a bus, and the
    fare is paid once.
    """
    rode = F.col("trip").isNotNull()
    rate = lambda name: F.when(rode, getattr(BUS, name)).otherwise(by_mode(modes, lambda m: F.lit(getattr(m, name)), F.col("mode")))
    names = F.lit(None).cast("string")
    for m in modes:
        names = F.when(F.col("mode") == m.bit, m.name).otherwise(names)
    sums = way.groupBy(F.col("origin").alias("a"), F.col("destination").alias("b")).agg(
        F.sum(rate("kcal") * F.col("ttt") / 3600).alias("kcal"), (F.sum(F.when(rode, 0.0).otherwise(rate("price") / 1000 * F.col("run"))) + F.when(F.bool_or(rode), FARE).otherwise(0.0)).alias("price"),
        F.sum(rate("co2") / 1000 * F.col("run")).alias("co2"), F.array_sort(F.collect_set(F.coalesce("line", names))).alias("lines"),
    )
    parts = legs(way).select(F.col("origin").alias("l_origin"), F.col("destination").alias("l_destination"), F.col("num_interchanges").alias("interchanges"), F.col("access_tt").alias("access"), F.col("egress_tt").alias("egress"), "waiting_time", "init_waiting_time", "pt_tt", F.col("interchange_tt").alias("pt_interchange_time"))
    at = lambda df, n: df.select(F.col("object_id").alias(f"{n}_id"), F.col("cx").alias(f"{n}x"), F.col("cy").alias(f"{n}y"))
    out = od.drop("interchanges").join(sums, (F.col("origin") == F.col("a")) & (F.col("destination") == F.col("b"))).drop("a", "b")
    out = out.join(parts, (F.col("origin") == F.col("l_origin")) & (F.col("destination") == F.col("l_destination"))).drop("l_origin", "l_destination")
    out = out.join(at(origins, "o"), F.col("origin") == F.col("o_id")).join(at(destinations, "d"), F.col("destination") == F.col("d_id"))
    dx, dy = F.col("dx") - F.col("ox"), F.col("dy") - F.col("oy")
    return out.withColumns({"beeline_distance": F.sqrt(dx * dx + dy * dy), "manhattan_distance": F.abs(dx) + F.abs(dy)}).drop("o_id", "ox", "oy", "d_id", "dx", "dy")


def extended_measures(ext: DataFrame, origins: DataFrame, from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, by: list[str] | None = None, shortest: bool = False) -> DataFrame:
    """The relation of extended measures: weighted means for each key, and all lines and modes used in ``modes``. ext: as
    ``extended`` gives it, with value and weight. Without origin aggregation, weights count as 1."""
    by = by or []
    w = F.lit(1.0) if from_agg is None else F.col("weight")
    pairs = keyed(ext.withColumn("w_", w), from_agg, to_agg, shortest)
    means = ("dist", "tt", *EXTENDED)
    sums = pairs.groupBy("fid", "sid", *by).agg(F.sum("w_").alias("n_"), F.sum(F.col("value") * F.col("w_")).alias("v_"), *(F.sum(F.col(c) * F.col("w_")).alias(f"s_{c}") for c in means), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("modes"))
    sums = normed(sums, origins, from_agg)
    name = lambda c: {"dist": "avg_distance", "beeline_distance": "beeline_distance", "manhattan_distance": "manhattan_distance"}.get(c, f"avg_{c}")
    mean = lambda c: safe(F.col(f"s_{c}"), F.col("n_")).alias(name(c))
    return sums.select("fid", "sid", *by, mean("dist"), mean("tt"), (F.col("n_") / F.col("total")).alias("avg_num"), (F.col("v_") / F.col("total")).alias("avg_value"), *(mean(c) for c in EXTENDED[:10]), "modes", *(mean(c) for c in EXTENDED[10:]))
