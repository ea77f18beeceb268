"""Which destinations of an origin count: bounds, the nearest, the first n, or until enough value is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_bounds(od: DataFrame, max_tt: float | None = None, max_distance: float | None = None) -> DataFrame:
    if max_tt is not None:
        od = od.where(F.col("tt") <= max_tt)
    if max_distance is not None:
        od = od.where(F.col("dist") <= max_distance)
    return od


def ranked(by: list[str]):
    """Destinations of an origin by time, then id."""
    return Window.partitionBy("origin", *by).orderBy("tt", "destination")


def first_n(od: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    return od.withColumn("rank_", F.row_number().over(ranked(by or []))).where(F.col("rank_") <= n).drop("rank_")


def nearest(od: DataFrame, by: list[str] | None = None) -> DataFrame:
    return first_n(od, 1, by)


def until_value(od: DataFrame, enough: float, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Destinations until the values before a row reach ``enough``; the row that reaches it is kept."""
    before = F.coalesce(F.sum(value).over(ranked(by or []).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return od.withColumn("before_", before).where(F.col("before_") < enough).drop("before_")


def limited(od: DataFrame, max_tt: float | None = None, max_distance: float | None = None, max_number: int | None = None, max_value: float | None = None, shortest: bool = False, by: list[str] | None = None) -> DataFrame:
    """Bounds come first; of the others the strictest given applies."""
    od = within_bounds(od, max_tt, max_distance)
    if shortest:
        return nearest(od, by)
    if max_number is not None:
        od = first_n(od, max_number, by)
    return until_value(od, max_value, by=by) if max_value is not None else od
