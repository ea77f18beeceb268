"""Measures of single ways: energy, prices, emissions, beelines, lines used, legs by public transport, path rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomesh.functions import geom as G
from isomesh.functions.modes import BUS, FARE, Mode, emissions, kilocalories, price


def simple(od: DataFrame, mode: Mode, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """od with kcal, price, co2, beeline and manhattan distance, each times the origin's weight. One mode without
    public transport: energy goes by time, price and emissions by distance."""
    o = origins.select(F.col("object_id").alias("origin"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    d = destinations.select(F.col("object_id").alias("destination"), F.col("cx").alias("dx"), F.col("cy").alias("dy"))
    dx, dy, w = F.col("dx") - F.col("ox"), F.col("dy") - F.col("oy"), F.col("weight")
    return od.join(o, "origin").join(d, "destination").withColumns({
        "kcal": kilocalories(F.col("tt"), mode) * w, "price": price(F.col("dist"), mode) * w, "co2": emissions(F.col("dist"), mode) * w,
        "beeline_distance": F.sqrt(dx * dx + dy * dy) * w, "manhattan_distance": (F.abs(dx) + F.abs(dy)) * w,
    }).drop("ox", "oy", "dx", "dy")


def legs(path: Column, time: float) -> Column:
    """Measures of a way as a fold from its end to its beginning.

    path: array<struct<line, is_pt, trip, tt, ttt, length, kcal_h, co2_km, price_km, share, interchange, departure>>
    from the origin on; tt is cumulated, share the part of the edge that is used, trip the ride, departure its start.
    Returns struct<kcal, price, co2, interchanges, access, egress, waiting, initial_waiting, pt_tt, interchange_time,
    num_rides, lines>; without a ride, access and egress are 0.
    """
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("kcal", "price", "co2", "interchanges", "access", "egress", "waiting", "initial_waiting", "pt_tt", "interchange_time", "num_rides")), F.lit(None).cast("string").alias("last"), F.lit(False).alias("paid"))
    backwards = F.reverse(F.transform(path, lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.get(path, i - 1)).alias("b"))))

    def step(a: Column, x: Column) -> Column:
        p, b = x["p"], x["b"]
        t = p["ttt"] * p["share"]
        rides = p["is_pt"]
        other = rides & a["last"].isNotNull() & (a["last"] != p["trip"])
        boards = rides & (b.isNull() | ~F.coalesce(b["is_pt"], F.lit(False)) | ~F.coalesce(b["trip"] == p["trip"], F.lit(False)))
        wait = F.when(boards, p["departure"] - (F.lit(time) + F.coalesce(b["tt"], F.lit(0.0)))).otherwise(0.0)
        metres = p["length"] * p["share"]
        fare = F.when(rides, F.when(a["paid"], 0.0).otherwise(FARE)).otherwise(p["price_km"] / 1000 * metres)
        hourly = F.when(rides, BUS.kcal).otherwise(p["kcal_h"])
        grams = F.when(rides, BUS.co2).otherwise(p["co2_km"])
        return F.struct(
            (a["kcal"] + hourly * t / 3600).alias("kcal"), (a["price"] + fare).alias("price"), (a["co2"] + grams / 1000 * metres).alias("co2"),
            (a["interchanges"] + F.when(other, 1.0).otherwise(0.0)).alias("interchanges"),
            F.when(rides, 0.0).otherwise(a["access"] + t).alias("access"),
            F.when(rides | a["last"].isNotNull(), a["egress"]).otherwise(a["egress"] + t).alias("egress"),
            (a["waiting"] + wait).alias("waiting"),
            F.when(rides, wait).otherwise(a["initial_waiting"]).alias("initial_waiting"),
            (a["pt_tt"] + F.when(rides, p["ttt"] - wait).otherwise(0.0)).alias("pt_tt"),
            (a["interchange_time"] + F.when(other, a["access"]).otherwise(0.0) + F.when(rides, p["interchange"]).otherwise(0.0)).alias("interchange_time"),
            (a["num_rides"] + F.when(boards, 1.0).otherwise(0.0)).alias("num_rides"),
            F.when(rides, p["trip"]).otherwise(a["last"]).alias("last"), (a["paid"] | rides).alias("paid"),
        )

    done = F.aggregate(backwards, zero, step)
    ridden = done["last"].isNotNull()
    names = ("kcal", "price", "co2", "interchanges", "waiting", "initial_waiting", "pt_tt", "interchange_time", "num_rides")
    lines = F.array_sort(F.array_distinct(F.transform(path, lambda p: p["line"])))
    return F.struct(*(done[n].alias(n) for n in names), *(F.when(ridden, done[n]).otherwise(0.0).alias(n) for n in ("access", "egress")), lines.alias("lines"))


def interchanges(path: Column) -> Column:
    """array<struct<halt, line_from, line_to, tt>>: where a ride is followed by another one. path as in ``legs``
    with the node at which each element ends as ``node``."""
    rides = F.filter(path, lambda p: p["is_pt"])
    pairs = F.transform(F.slice(rides, 1, F.greatest(F.size(rides) - 1, F.lit(0))), lambda p, i: F.struct(p["node"].alias("halt"), p["line"].alias("line_from"), rides[i + 1]["line"].alias("line_to"), rides[i + 1]["interchange"].alias("tt"), (p["trip"] != rides[i + 1]["trip"]).alias("changes")))
    return F.transform(F.filter(pairs, lambda x: x["changes"]), lambda x: F.struct(x["halt"], x["line_from"], x["line_to"], x["tt"]))


def path_rows(steps: DataFrame, edges: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """steps (origin, destination, idx, edge, tt) with each edge's geometry; of the first and the last edge only the
    part that is used. origins and destinations: object_id, edge_id, pos."""
    e = edges.select(F.col("edge_id").alias("e"), "geom", "length", "opposite_id")
    ends = steps.groupBy("origin", "destination").agg(F.max("idx").alias("last"))
    at = lambda df, key, name: df.select(F.col("object_id").alias(key), F.col("edge_id").alias(f"{name}_edge"), F.col("pos").alias(f"{name}_pos"))
    rows = steps.join(e, F.col("edge") == F.col("e")).join(ends, ["origin", "destination"]).join(at(origins, "origin", "o"), "origin").join(at(destinations, "destination", "d"), "destination")
    here = lambda name: F.when(F.col("edge") == F.col(f"{name}_edge"), F.col(f"{name}_pos")).otherwise(F.col("length") - F.col(f"{name}_pos"))
    begin = F.when(F.col("idx") == 0, here("o")).otherwise(0.0)
    end = F.when(F.col("idx") == F.col("last"), here("d")).otherwise(F.col("length"))
    return rows.select("origin", "destination", "idx", "edge", "tt", G.part(F.col("geom"), begin, end).alias("geom"))
