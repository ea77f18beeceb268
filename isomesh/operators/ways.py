"""Chains of predecessors, and the bounds with which searches end early.

Both are tables beside the labels: a chain is unfolded by doubled jumps, and an origin that has found enough gets a bound
on time behind which nothing of it is looked at any more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isomesh.operators.state import settled


def chains(back: DataFrame, goals: DataFrame, key: list[str], parent: list[str]) -> DataFrame:
    """For every row of ``goals`` (key, others) the rows of ``back`` from which it is reached: the columns of goals, with
    its key under ``at_<key>``, and ``step``: 0 for the goal itself, 1 for its parent and so on.

    back: key, parent (null: none before). In round k all rows so far jump 2 ** k steps back, and the table of jumps is
    joined with itself; so a chain of n rows takes about log2(n) rounds, whatever the number of goals, and no plan grows.
    Rows whose parent is not in ``back`` end their chain.
    """
    at = [f"at_{k}" for k in key]
    # Only the origins that are asked for; the first column of a key is the origin.
    asked = goals.select(key[0]).distinct()
    named = back.where(F.col(parent[0]).isNotNull()).join(asked, key[0], "left_semi")
    same = key[: len(key) - len(parent)]
    known = back.select(*key).join(asked, key[0], "left_semi")
    jumps = named.select(*key, *(F.col(p).alias(f"to_{k}") for k, p in zip(key[len(same) :], parent, strict=True)))
    moved = key[len(same) :]
    # A jump leads to rows that exist.
    exist = known.select(*same, *(F.col(k).alias(f"to_{k}") for k in moved))
    jumps = settled(jumps.join(exist, [*same, *(f"to_{k}" for k in moved)], "left_semi"), "jumps")
    rows = goals.select("*", *(F.col(k).alias(a) for k, a in zip(key, at, strict=True)), F.lit(0).alias("step"))
    rows = settled(rows.join(known.select(*(F.col(k).alias(a) for k, a in zip(key, at, strict=True))), at, "left_semi"), "chain")
    length = 1
    while not jumps.isEmpty():
        here = jumps.select(*(F.col(k).alias(f"at_{k}") for k in key), *(f"to_{k}" for k in moved))
        far = rows.join(here, at).select(*goals.columns, *(f"at_{k}" for k in same), *(F.col(f"to_{k}").alias(f"at_{k}") for k in moved), (F.col("step") + length).alias("step"))
        rows = settled(rows.select(*goals.columns, *at, "step").unionByName(far), "chain")
        on = jumps.select(*same, *(F.col(k).alias(f"to_{k}") for k in moved), *(F.col(f"to_{k}").alias(f"then_{k}") for k in moved))
        jumps = settled(jumps.join(on, [*same, *(f"to_{k}" for k in moved)]).select(*key, *(F.col(f"then_{k}").alias(f"to_{k}") for k in moved)), "jumps")
        length *= 2
    return rows


class Enough(NamedTuple):
    """When an origin has found enough: its nearest ``number`` destinations, or destinations whose values sum to
    ``value``; for each type of destination where types (destination, type) are given. values: destination, value."""

    number: int | None = None
    value: float | None = None
    values: DataFrame | None = None
    types: DataFrame | None = None


class Bounds:
    """What every origin has found so far, and from it the time up to which its search has to go.

    A destination found later than the bound can't be among those asked for: it would come behind enough others. So
    a search that leaves out all labels beyond the bound finds the same as one that goes through the whole network. The
    bounds are kept for origins that have enough only; a row of ``found`` for each destination that counts.
    """

    def __init__(self, enough: Enough, found: DataFrame, never: DataFrame | None = None):
        """found: origin, destination, tt, what is found before the search; never: pairs that don't count."""
        self.enough, self.never = enough, never
        self.kinds = enough.types.select("type").distinct().count() if enough.types is not None else 1
        if enough.value is not None and enough.number is None and enough.values.where("value < 0").limit(1).count():
            raise ValueError("sums of values that may be negative don't bound a search")
        self.found = self.table = None
        self.add(found)

    def add(self, found: DataFrame) -> None:
        """Takes in more ways to destinations (origin, destination, tt)."""
        e = self.enough
        new = found.groupBy("origin", "destination").agg(F.min("tt").alias("tt"))
        if self.never is not None:
            new = new.join(self.never.select("origin", "destination"), ["origin", "destination"], "left_anti")
        if self.found is not None:
            new = self.found.select("origin", "destination", "tt").unionByName(new).groupBy("origin", "destination").agg(F.min("tt").alias("tt"))
        # A destination that counts for several types is kept once and told apart here.
        rows = new.join(e.types.select("destination", "type"), "destination") if e.types is not None else new.withColumn("type", F.lit(""))
        by = Window.partitionBy("origin", "type").orderBy("tt", "destination")
        if e.number is not None:
            rows = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= e.number).withColumn("last", F.col("rank") == e.number)
        else:
            rows = rows.join(e.values.select("destination", "value"), "destination").withColumn("upto", F.sum("value").over(by.rowsBetween(Window.unboundedPreceding, 0)))
            rows = rows.where(F.col("upto") - F.col("value") < e.value).withColumn("last", F.col("upto") >= e.value)
        self.found = settled(rows.select("origin", "destination", "type", "tt", "last"), "found")
        least = self.found.where("last").groupBy("origin").agg(F.count("*").alias("kinds"), F.max("tt").alias("bound"))
        self.table = least.where(F.col("kinds") >= self.kinds).select(F.col("origin").alias("b_origin"), "bound")

    def within(self, offers: DataFrame) -> DataFrame:
        """The offers (origin, tt, others) that may still matter."""
        kept = offers.join(self.table, F.col("origin") == F.col("b_origin"), "left")
        return kept.where(F.col("bound").isNull() | (F.col("tt") <= F.col("bound"))).drop("b_origin", "bound")
