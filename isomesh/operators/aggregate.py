"""Measures of origin-destination pairs, summed by areas.

od: origin, destination, dist, tt, value (of the destination), weight (of the origin), and further measures that
are already multiplied by the weight where their definition says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isomesh.operators.state import settled

ALL = -1


def keyed(od: DataFrame, from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, shortest: bool = False) -> DataFrame:
    """Adds fid and sid. from_agg and to_agg: "all", object_id with area_id, or None for the objects themselves.
    With origin areas and only the nearest destination, destinations are not told apart."""

    def key(df: DataFrame, agg: DataFrame | str | None, of: str, name: str) -> DataFrame:
        if isinstance(agg, str):
            return df.withColumn(name, F.lit(ALL).cast("bigint"))
        if agg is None:
            return df.withColumn(name, F.col(of))
        a = agg.select(F.col("object_id").alias("a_id"), F.col("area_id").alias(name))
        return df.join(a, F.col(of) == F.col("a_id"), "left").drop("a_id").withColumn(name, F.coalesce(name, F.lit(ALL).cast("bigint")))

    out = key(od, from_agg, "origin", "fid")
    if isinstance(from_agg, DataFrame) and to_agg is None and shortest:
        return out.withColumn("sid", F.lit(ALL).cast("bigint"))
    return key(out, to_agg, "destination", "sid")


def weight_sums(origins: DataFrame, from_agg: DataFrame | str | None) -> DataFrame:
    """fid, total: the weights of all origins of a key, reached or not. origins: object_id, weight."""
    o = keyed(origins.select(F.col("object_id").alias("origin"), F.lit(0).cast("bigint").alias("destination"), "weight"), from_agg)
    return o.groupBy("fid").agg(F.sum("weight").alias("total"))


def normed(pairs: DataFrame, origins: DataFrame, from_agg: DataFrame | str | None) -> DataFrame:
    """Adds total: the weight sum of the origin key, or 1 where origins are not aggregated."""
    if from_agg is None:
        return pairs.withColumn("total", F.lit(1.0))
    return pairs.join(weight_sums(origins, from_agg), "fid")


def safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def od_measures(od: DataFrame, origins: DataFrame, from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, shortest: bool = False, by: list[str] | None = None, more: list[str] | None = None) -> DataFrame:
    """fid, sid, [by], avg_distance, avg_tt, avg_num, avg_value, and avg_<m> of further measures.

    Without origin aggregation, weights count as 1.
    """
    w = F.lit(1.0) if from_agg is None else F.col("weight")
    by = by or []
    pairs = keyed(od.withColumn("w_", w), from_agg, to_agg, shortest)
    sums = pairs.groupBy("fid", "sid", *by).agg(F.sum(F.col("dist") * F.col("w_")).alias("d_"), F.sum(F.col("tt") * F.col("w_")).alias("t_"), F.sum("w_").alias("n_"), F.sum(F.col("value") * F.col("w_")).alias("v_"), *(F.sum(m).alias(f"m_{m}") for m in more or []))
    sums = normed(sums, origins, from_agg)
    return sums.select("fid", "sid", *by, safe(F.col("d_"), F.col("n_")).alias("avg_distance"), safe(F.col("t_"), F.col("n_")).alias("avg_tt"), (F.col("n_") / F.col("total")).alias("avg_num"), (F.col("v_") / F.col("total")).alias("avg_value"), *(safe(F.col(f"m_{m}"), F.col("n_")).alias(f"avg_{m}") for m in more or []))


def dense(measures: DataFrame, origin_keys: DataFrame, destination_keys: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """A row for every origin key with every destination key (and every dest_type of ``kinds``), zeros and empty sets
    where none was reached. The frame has as many rows as the sets of aggregation keys multiply to, so it is for
    aggregated results."""
    frame, keys = origin_keys.select("fid").distinct().crossJoin(destination_keys.select("sid").distinct()), ["fid", "sid"]
    if kinds is not None:
        frame, keys = frame.crossJoin(kinds.select("dest_type").distinct()), [*keys, "dest_type"]
    empty = lambda f: F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(0).cast(f.dataType)
    values = [F.coalesce(f.name, empty(f)).alias(f.name) for f in measures.schema.fields if f.name not in keys]
    return frame.join(measures, keys, "left").select(*keys, *values)


def framed(measures: DataFrame, origins: DataFrame, destinations: DataFrame, from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, shortest: bool = False, types: DataFrame | None = None) -> DataFrame:
    """``dense`` over the keys of all objects, reached or not, wherever origins or destinations are aggregated; without
    that, the measures as they are. origins, destinations: object_id; types: id, type."""
    if from_agg is None and to_agg is None:
        return measures
    pair = lambda df, name, other: df.select(F.col("object_id").alias(name), F.lit(None).cast("bigint").alias(other))
    fids = keyed(pair(origins, "origin", "destination"), from_agg, "all")
    sids = keyed(pair(destinations, "destination", "origin"), from_agg, to_agg, shortest)
    return dense(measures, fids, sids, None if types is None else types.select(F.col("type").alias("dest_type")))


def statistics(od: DataFrame, values: list[str], from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, shortest: bool = False, by: list[str] | None = None) -> DataFrame:
    """fid, sid, [by], num and avg, med, min, max, p15, p85 of each value, percentiles by rank int(n * q) of the sorted values.

    Rows are counted by key, measure and value first, and the counts dealt out by ranges of these; every range numbers
    its own behind what the ranges before it hold of the key. So a key with most of the rows takes many tasks.
    """
    pairs = keyed(od, from_agg, to_agg, shortest)
    rows = ["fid", "sid", *(by or [])]
    keys = [*rows, "measure"]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("measure"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)))).alias("e")
    counts = pairs.select(*rows, each).select(*rows, "e.measure", "e.v").where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("k"))
    spread = counts.repartitionByRange(int(od.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "v")
    dealt = settled(spread.withColumn("part", F.spark_partition_id()), "ranges")
    # A row for each key in each range that has some of it: as many as there are keys and ranges.
    held = dealt.groupBy(*keys, "part").agg(F.sum("k").alias("here"), F.sum(F.col("v") * F.col("k")).alias("sum"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*keys, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"), "here", "sum", "least", "most")
    all_of = held.groupBy(*keys).agg(F.sum("here").alias("n"), F.sum("sum").alias("sum"), F.min("least").alias("least"), F.max("most").alias("most"))
    own = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.select(*keys, "part", "v", "k", F.sum("k").over(own).alias("own")).join(held.select(*keys, "part", "base"), [*keys, "part"]).join(all_of, keys)
    last = F.col("base") + F.col("own")
    at = lambda q: F.max(F.when((F.floor(F.col("n") * q) >= last - F.col("k")) & (F.floor(F.col("n") * q) < last), F.col("v")))
    found = upto.groupBy(*keys).agg(F.first("n").alias("n"), F.first("sum").alias("sum"), F.first("least").alias("min"), F.first("most").alias("max"), at(0.5).alias("med"), at(0.15).alias("p15"), at(0.85).alias("p85"))
    of = lambda i, c: F.max(F.when(F.col("measure") == i, c))
    columns = []
    for i, v in enumerate(values):
        columns += [of(i, F.col("sum") / F.col("n")).alias(f"avg_{v}"), *(of(i, F.col(c)).alias(f"{c}_{v}") for c in ("med", "min", "max", "p15", "p85"))]
    num = pairs.groupBy(*(F.col(k).alias(f"n_{k}") for k in rows)).agg(F.count("*").alias("num"))
    wide = found.groupBy(*rows).agg(*columns)
    same = reduce(lambda a, b: a & b, (F.col(f"n_{k}").eqNullSafe(F.col(k)) for k in rows))
    return num.join(wide, same, "left").select(*(F.col(f"n_{k}").alias(k) for k in rows), "num", *wide.columns[len(rows) :])


def edge_use(steps: DataFrame, od: DataFrame, from_agg: DataFrame | str | None = None, to_agg: DataFrame | str | None = None, shortest: bool = False, by: list[str] | None = None) -> DataFrame:
    """fid, sid, eid, [by], num, origins_weight, normed: how much value goes over each edge. steps: origin, destination,
    edge. An edge and its made opposite count as one."""
    by = by or []
    rows = keyed(steps.join(od.select("origin", "destination", "value", "weight", *by), ["origin", "destination"]), from_agg, to_agg, shortest)
    w = F.lit(1.0) if from_agg is None else F.col("weight")
    rows = rows.withColumn("eid", F.regexp_replace("edge", "^opp_", "")).withColumn("w_", w)
    sums = rows.groupBy("fid", "sid", "eid", *by).agg(F.sum(F.col("value") * F.col("w_")).alias("num"), F.sum("w_").alias("origins_weight"))
    return sums.withColumn("normed", F.col("num") / F.col("origins_weight"))


def with_types(od: DataFrame, types: DataFrame) -> DataFrame:
    """A row for each type of the destination; types: id, type."""
    return od.join(types.select(F.col("id").alias("t_id"), F.col("type").alias("dest_type")), F.col("destination") == F.col("t_id")).drop("t_id")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """bin, n: how many values lie in each bin of a fixed width, bin 0 from 0 on; without bins of none."""
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
