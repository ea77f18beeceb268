"""Timetables: which trips run on a day, their hops from stop to stop, and transfer times."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isomesh.functions.geom import projected, projection
from isomesh.functions.modes import seconds

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file of the feed, all columns as text."""
    return spark.read.csv(f"{folder}/{name}.txt", header=True, quote='"', escape='"')


def stops(df: DataFrame, epsg: int = 0, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """stop_id, x, y; of repeated ids one stays; projected, unless ``epsg`` is 0 or that of degrees, and within a boundary
    (as ``tables.boundary`` makes it), if given. A projection that is not known is an error."""
    lat, lon = F.col("stop_lat").cast("double"), F.col("stop_lon").cast("double")
    x, y = (lon, lat) if epsg in (0, 4326) else projected(lat, lon, projection(epsg))
    out = df.groupBy("stop_id").agg(F.min(F.struct("stop_lat", "stop_lon")).alias("s")).select("stop_id", "s.*").select("stop_id", x.alias("x"), y.alias("y"))
    return out.where(keep(F.col("x"), F.col("y"))) if keep else out


def routes(df: DataFrame, carriers: list[int] | None = None) -> DataFrame:
    out = df.select("route_id", "route_short_name", F.col("route_type").cast("int").alias("route_type"))
    return out.where(F.col("route_type").isin(carriers)) if carriers else out


def services(calendar: DataFrame, changes: DataFrame | None, day: int, compat: bool = False) -> DataFrame:
    """service_id of what runs on a day (yyyyMMdd): by range and weekday, added to and taken from by single dates.

    ``compat`` reads the flag of the day after, as the weekday tables of an older tool do.
    """
    name = WEEKDAYS[(date(day // 10000, day // 100 % 100, day % 100).weekday() + compat) % 7]
    runs = calendar.where((F.col("start_date").cast("int") <= day) & (F.col("end_date").cast("int") >= day) & (F.col(name).cast("int") == 1)).select("service_id")
    if changes is None:
        return runs.distinct()
    of = lambda kind: changes.where((F.col("date").cast("int") == day) & (F.col("exception_type").cast("int") == kind)).select("service_id")
    return runs.union(of(1)).distinct().join(of(2).distinct(), "service_id", "left_anti")


def trips(df: DataFrame, running: DataFrame, lines: DataFrame) -> DataFrame:
    return df.join(running, "service_id", "left_semi").join(lines, "route_id").select("trip_id", "route_id", "route_short_name", "route_type")


def times(df: DataFrame) -> DataFrame:
    """stop_times with arrival and departure in seconds."""
    return df.select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), seconds(F.col("arrival_time")).alias("arrival"), seconds(F.col("departure_time")).alias("departure"))


def hops(stop_times: DataFrame, running: DataFrame) -> DataFrame:
    """trip_id, route_id, from_stop, to_stop, place, dep, arr: consecutive stops of each running trip."""
    by = Window.partitionBy("trip_id").orderBy("stop_sequence")
    before = lambda c: F.lag(c).over(by)
    rows = stop_times.join(running.select("trip_id", "route_id"), "trip_id")
    rows = rows.select("trip_id", "route_id", before("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.row_number().over(by).cast("bigint").alias("place"), before("departure").alias("dep"), F.col("arrival").alias("arr"))
    return rows.where("from_stop is not null")


def repaired(connections: DataFrame, widened: int = 15) -> DataFrame:
    """Hops of each trip, those without duration spread over the time around them.

    A run is a row of hops without duration at one time, with the hop before it and the hop after it. Its n hops share
    its whole span evenly, in whole seconds: each gets the span divided by n, rounded down. A hop between two runs
    belongs to the first. A run of one hop is widened on both sides.
    """
    by = Window.partitionBy("trip_id").orderBy("place")
    none = F.col("dep") == F.col("arr")
    rows = connections.withColumns({"none": none, "none_before": F.coalesce(F.lag(none).over(by), F.lit(False)), "none_after": F.coalesce(F.lead(none).over(by), F.lit(False)), "dep_before": F.lag("dep").over(by), "first": F.row_number().over(by) == 1})
    rows = rows.withColumns({"head": ~F.col("none") & F.col("none_after") & ~F.col("none_before"), "tail": ~F.col("none") & F.col("none_before")})
    later = F.col("none") & (F.lag("tail").over(by) | F.col("none_before") & (F.col("dep") != F.col("dep_before")))
    rows = rows.withColumn("run", F.sum((F.col("head") | F.col("none") & F.col("first") | F.coalesce(later, F.lit(False))).cast("int")).over(by))
    rows = rows.withColumn("inside", F.col("none") | F.col("head") | F.col("tail"))
    own = Window.partitionBy("trip_id", "run", "inside")
    k, n = F.row_number().over(own.orderBy("place")) - 1, F.count("*").over(own)
    begin, end = F.min(F.struct("place", "dep")).over(own)["dep"], F.max(F.struct("place", "arr")).over(own)["arr"]
    rows = rows.withColumns({"k": k, "n": n, "begin": begin, "share": F.floor((end - begin) / n)})
    new = lambda old, wide, spread: F.when(~F.col("inside"), F.col(old)).when(F.col("n") == 1, F.col(old) + wide).otherwise(spread).cast("int").alias(old)
    return rows.select("trip_id", "route_id", "from_stop", "to_stop", "place", new("dep", -widened, F.col("begin") + F.col("k") * F.col("share")), new("arr", widened, F.col("begin") + (F.col("k") + 1) * F.col("share")))


def line_edges(connections: DataFrame, running: DataFrame) -> DataFrame:
    """edge_id, from_stop, to_stop, route_id: one for each pair of stops that a line serves in a row."""
    names = running.select("route_id", "route_short_name").distinct()
    pairs = connections.select("from_stop", "to_stop", "route_id").distinct().join(names, "route_id")
    return pairs.select(F.concat("from_stop", F.lit("_to_"), "to_stop", F.lit("_using_"), "route_short_name").alias("edge_id"), "from_stop", "to_stop", "route_id")


def transfers(df: DataFrame, running: DataFrame) -> DataFrame:
    """stop_id, from_trip, to_trip, seconds: timed transfers at one stop between running trips."""
    known = running.select("trip_id")
    rows = df.where((F.col("transfer_type").cast("int") == 2) & (F.col("from_stop_id") == F.col("to_stop_id")))
    rows = rows.join(known, F.col("from_trip_id") == F.col("trip_id"), "left_semi").join(known, F.col("to_trip_id") == F.col("trip_id"), "left_semi")
    return rows.select(F.col("from_stop_id").alias("stop_id"), F.col("from_trip_id").alias("from_trip"), F.col("to_trip_id").alias("to_trip"), F.col("min_transfer_time").cast("int").alias("seconds"))


def load(spark: SparkSession, folder: str, day: int, epsg: int = 0, carriers: list[int] | None = None, keep: Callable[[Column, Column], Column] | None = None, compat: bool = False) -> dict[str, DataFrame] | None:
    """What runs on a day: stops, running (trips), hops (repaired, with edge_id of their line) and lines, and transfers;
    None if no trip runs. calendar_dates and transfers may be absent."""

    def optional(name: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return read(spark, folder, name) if there else None

    running = trips(read(spark, folder, "trips"), services(read(spark, folder, "calendar"), optional("calendar_dates"), day, compat), routes(read(spark, folder, "routes"), carriers))
    if not running.limit(1).count():
        return None
    places = stops(read(spark, folder, "stops"), epsg, keep)
    rides = repaired(hops(times(read(spark, folder, "stop_times")), running))
    known = places.select("stop_id")
    for end in ("from_stop", "to_stop"):
        rides = rides.join(known, F.col(end) == F.col("stop_id"), "left_semi")
    lines = line_edges(rides, running)
    rides = rides.join(lines, ["from_stop", "to_stop", "route_id"])
    found = optional("transfers")
    return {"stops": places, "running": running, "hops": rides, "lines": lines, "transfers": None if found is None else transfers(found, running)}


def carriers_of(text: str) -> list[int]:
    """The kinds of routes that a restriction lists, divided by commas."""
    return [int(x) for x in filter(None, (t.strip() for t in text.split(",")))]


def stop_lines(stop_times: DataFrame, running: DataFrame) -> DataFrame:
    """stop_id, lines: the names of all lines that serve a stop, in order, divided by commas."""
    served = stop_times.select("trip_id", "stop_id").join(running.select("trip_id", "route_short_name"), "trip_id")
    return served.groupBy("stop_id").agg(F.array_join(F.array_sort(F.collect_set("route_short_name")), ",").alias("lines"))


#: The columns of a feed's tables that become numbers, and those that have to be there.
NUMBERS = {"stop_lat": "double", "stop_lon": "double", "location_type": "int", "route_type": "int", "direction_id": "int", "stop_sequence": "int", "pickup_type": "int", "drop_off_type": "int", "shape_dist_traveled": "double", "exception_type": "int", "transfer_type": "int", "min_transfer_time": "int"}
NEEDED = {"stops": ["stop_id"], "routes": ["route_id", "route_type"], "trips": ["route_id", "service_id", "trip_id"], "stop_times": ["trip_id", "stop_id", "stop_sequence"], "calendar": ["service_id", *WEEKDAYS, "start_date", "end_date"], "calendar_dates": ["service_id", "date", "exception_type"], "transfers": ["from_stop_id", "to_stop_id", "transfer_type"]}


def typed(df: DataFrame, name: str) -> DataFrame:
    """A file of the feed as a table: numbers as numbers, -1 where there is none (0 for the least transfer time). A
    column that has to be there and is not is an error."""
    if absent := [c for c in NEEDED.get(name, []) if c not in df.columns]:
        raise ValueError(f"{name} needs {', '.join(absent)}")
    value = lambda c: F.coalesce(F.trim(F.col(c)).try_cast(NUMBERS[c]), F.lit(0 if c == "min_transfer_time" else -1).cast(NUMBERS[c])).alias(c)
    return df.select(*(value(c) if c in NUMBERS else F.col(c) for c in df.columns))


def next_departure(waiting: DataFrame, connections: DataFrame, keys: list[str]) -> DataFrame:
    """waiting (keys, time) with the connection that arrives first among those that leave at ``time`` or later:
    dep, arr, trip_id, null if there is none.

    Of each later departure only the earliest arrival matters, so connections carry the best one that is still to
    come; waiting rows and connections then pass through one window by time, without pairing them.
    """
    own = [F.col(k) for k in keys]
    to_come = Window.partitionBy(*keys).orderBy(F.desc("time"), F.desc("is_hop")).rowsBetween(Window.unboundedPreceding, 0)
    hop = F.struct("arr", "dep", "trip_id")
    rows = connections.select(*own, F.col("dep").cast("double").alias("time"), F.lit(1).alias("is_hop"), hop.alias("hop"), F.lit(None).cast("bigint").alias("row"))
    asks = waiting.select(*own, F.col("time").cast("double").alias("time"), F.lit(0).alias("is_hop"), F.lit(None).cast(rows.schema["hop"].dataType).alias("hop"), F.col("row"))
    return rows.union(asks).withColumn("best", F.min("hop").over(to_come)).where("is_hop = 0").select("row", *own, "time", "best.dep", "best.arr", "best.trip_id")
