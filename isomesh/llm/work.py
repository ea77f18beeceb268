"""Shared helpers of the corpus operators: picking columns, shared work tables, text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def local_dir() -> str:
    return Path(tempfile.mkdtemp(prefix="isomesh-work-")).as_uri()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of this
    machine serves a local master; on a cluster executors would not see each other's files, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = local_dir()
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.work_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def named(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with its columns renamed by position, and the column of each name as spelt (the first of equals), so that
    names that differ in case only, or repeat, can't be confused."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain, {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(df.columns)))}


def chosen(df: DataFrame, *wanted: tuple[str, str]) -> DataFrame:
    """The columns asked for as (name, type), null where there is none; all other columns are left out."""
    plain, of = named(df)
    return plain.select(*(of.get(n, F.lit(None)).cast(k).alias(n) for n, k in wanted))


def texts(df: DataFrame, *more: tuple[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (bigint), text (null: empty) and the columns asked for as (name, type); all other columns are left out."""
    return chosen(df, (key, "bigint"), (text, "string"), *more).fillna("", [text])


def packed(df: DataFrame, *wanted: tuple[str, str]) -> DataFrame:
    """``row``, all columns as one struct, beside the columns asked for as in ``chosen``: names can't clash. A text that
    is asked for as it is stands beside the row only, so that tasks get it once."""
    plain, of = named(df)
    kinds = dict(zip(plain.columns, (f.dataType.simpleString() for f in df.schema), strict=True))
    own = [c for c in plain.columns if not any(n == "text" and k == kinds[c] and n in of and df.columns.index(n) == int(c[1:]) for n, k in wanted)]
    row = F.struct(*own) if own else F.struct(F.lit(0).alias("none"))
    return plain.select(row.alias("row"), *(of.get(n, F.lit(None)).cast(k).alias(n) for n, k in wanted))


def unpacked(rows: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``like`` from ``row``, some of them replaced; a replaced one keeps its type."""
    kinds = {f.name: f.dataType for f in like.schema}
    held = set(rows.schema["row"].dataType.names)
    return rows.select(*((new[c].cast(kinds[c]) if c in new else F.col(f"row.c{i}") if f"c{i}" in held else F.col("text")).alias(c) for i, c in enumerate(like.columns)))


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; null as empty."""
    return [t or "" for t in column.to_pylist()]


def lean(spark: SparkSession) -> None:
    """A setting of the session for tables of texts: tasks get so few rows at once that long ones fit their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the registered queries."""
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``most`` at most; a larger item comes alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
