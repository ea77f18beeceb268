"""Intermediate tables of iterations, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@cache
def local_dir() -> str:
    return Path(tempfile.mkdtemp(prefix="isomesh-state-")).as_uri()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine, which serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = local_dir()
    return named.rstrip("/")


def settled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that the plans of iterations stay short and lost
    executors cost no more than one round."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shelf:
    """Tables of one kind that an iteration writes one after the other and never again, under numbers. They are read one
    by one or several at once, as one scan of their files."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.schema = None

    @property
    def numbers(self) -> list[int]:
        return list(self.paths)

    def put(self, number: int, df: DataFrame) -> DataFrame:
        """Writes a table and reads it again."""
        path = f"{self.path}/{number}"
        df.write.parquet(path)
        return self.own(number, path, df)

    def take(self, number: int, other: Shelf) -> DataFrame:
        """The only table of another shelf, where it lies."""
        (path,) = other.paths.values()
        return self.own(number, path, other)

    def own(self, number: int, path: str, like: DataFrame | Shelf) -> DataFrame:
        self.schema, self.paths[number] = like.schema, path
        return self.get(number)

    def get(self, *numbers: int) -> DataFrame | None:
        """The tables of these numbers, as far as there are any."""
        paths = [self.paths[n] for n in numbers if n in self.paths]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def all(self) -> DataFrame | None:
        return self.get(*self.paths)
