"""Connected components of links, and numbers of rows in an order, without a task that sees more rows than a fixed number."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isomesh.operators.state import settled

#: So many links at most are put together by one task, instead of in rounds.
FEW = 200_000


def put_together(batches):
    """node, root: one node of its component, for all nodes of the links (v, u) of a task."""
    up: dict = {}

    def top(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for batch in batches:
        kind = batch.schema.field("v").type
        for v, u in zip(batch.column("v").to_pylist(), batch.column("u").to_pylist(), strict=True):
            up.setdefault(v, v)
            up.setdefault(u, u)
            a, b = sorted((top(v), top(u)))
            up[b] = a
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(n) for n in up], kind)], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for all nodes in ``links`` (a, b).

    In every round a node goes over to that one of itself and its neighbours whose hash in this round is least, and links
    are drawn between what is left. Of the nodes of a path about half are left of each round, and fewer of a star or a
    grid, so all rounds together write a few times the links, and their number grows with the logarithm of the nodes.
    The last ``FEW`` links, whatever the size of the network, would take most of the rounds for hardly any rows: one task
    puts them together.
    """
    loops = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    edges = settled(links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    # Of each round: where every node went, and the smallest node that had come to it before.
    moves: list[DataFrame] = []
    low = lambda moved: moved.groupBy("root").agg(F.min("low").alias("low"))
    while left := edges.count():
        rank = lambda c, turn=len(moves): F.struct(F.xxhash64(F.lit(turn), c).alias("hash"), F.col(c).alias("node"))
        if left > FEW:
            around = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
            least = around.groupBy("x").agg(F.min(rank("y")).alias("m"))
            moved = least.select(F.col("x").alias("node"), F.least("m", rank("x"))["node"].alias("root"))
        else:
            kind = edges.schema["v"].dataType.simpleString()
            moved = edges.coalesce(1).mapInArrow(put_together, f"node {kind}, root {kind}")
        moved = moved.join(low(moves[-1]).withColumnRenamed("root", "node"), "node") if moves else moved.withColumn("low", F.col("node"))
        moves.append(settled(moved, "moves"))
        if left <= FEW:
            break
        to = lambda c, moved=moves[-1]: moved.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        drawn = edges.join(to("u"), "u").join(to("v"), "v").where("u_root != v_root")
        edges = settled(drawn.select(F.greatest("u_root", "v_root").alias("v"), F.least("u_root", "v_root").alias("u")).distinct(), "links")
    found = None
    for moved in reversed(moves):
        own = moved.select("node", "root").join(low(moved).withColumnRenamed("low", "label"), "root")
        if found is not None:
            own = own.join(found.select(F.col("node").alias("root"), F.col("label").alias("later")), "root", "left").withColumn("label", F.coalesce("later", "label"))
        found = settled(own.select("node", "label"), "labels")
    return loops.distinct() if found is None else found.union(loops.distinct().join(found, "node", "left_anti"))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with the places of its rows, from 0, in an order without ties: ranges of rows are counted, and each range
    numbers its own rows behind the counts of those before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    # One row for each range.
    sizes = dealt.groupBy("part_").agg(F.count("*").alias("n_"))
    upto = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("base_"))
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return dealt.join(F.broadcast(upto), "part_").withColumn(name, (F.col("base_") + own - 1).cast("bigint")).drop("part_", "base_")
