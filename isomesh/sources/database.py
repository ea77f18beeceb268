"""Tables of databases over JDBC, read in as many tasks as their rows need, filtered where they lie."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that a task reads, as far as ids tell rows apart, and the most ranges that are counted at once.
ROWS, BUCKETS = 200_000, 10_000
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


class Place(NamedTuple):
    """Where a table lies."""

    url: str
    table: str
    login: dict[str, str]


def is_database(source: str) -> bool:
    return re.sub(r"^db[;,]", "", source).startswith("jdbc:")


def place(source: str) -> Place:
    """``jdbc:...,table`` or ``jdbc:...,table,user,password``, with ``db,`` before it or not; semicolons may divide, too,
    where the url has none itself."""
    text = re.sub(r"^db[;,]", "", source)
    parts = text.split(",") if "," in text else text.split(";")
    if not text.startswith("jdbc:") or len(parts) not in (2, 4) or not all(parts[:2]):
        raise ValueError("a database is named by url and table, or url, table, user and password")
    return Place(parts[0], parts[1], dict(zip(("user", "password"), parts[2:], strict=False)))


def selection(at: Place, where: str | None = None, geom: str | None = None, epsg: int | None = None) -> str:
    """What stands for the table in a query: itself, or what a condition in the database's own SQL leaves of it. A
    database that can project geometry (PostGIS) does so and gives it in binary form, under the name ``geom_binary``."""
    projects = geom and epsg and at.url.startswith("jdbc:postgresql:")
    if not where and not projects:
        return at.table
    binary = f", ST_AsBinary(ST_Transform(t.{geom}, {int(epsg)})) AS geom_binary" if projects else ""
    return f"(SELECT t.*{binary} FROM {at.table} t{f' WHERE {where}' if where else ''}) s"


def ranges(count: Callable[[int, int, int], list[tuple[int, int]]], low: int, high: int, n: int, rows: int = ROWS) -> list[tuple[int, int]]:
    """Closed ranges of ids, in order, that hold all ``n`` rows, each at most ``rows`` but where one id has more.

    ``count(low, high, width)`` counts the rows of stretches that are ``width`` ids wide: (first id, rows) for each that
    has any. Stretches with few rows are put together, those with too many are counted again by narrower ones, so gaps
    and crowded ids make no large task.
    """
    if n <= rows or low == high:
        return [(low, high)]
    wanted = min(max(2 * -(-n // rows), 2), BUCKETS)
    width = -(-(high - low + 1) // wanted)
    out: list[tuple[int, int]] = []
    open_, held, last = None, 0, low
    for first, m in sorted(count(low, high, width)):
        if open_ is not None and held + m > rows:
            out.append((open_, last))
            open_, held = None, 0
        last = min(first + width - 1, high)
        if m > rows:
            out += ranges(count, first, last, m, rows) if width > 1 else [(first, first)]
        else:
            open_, held = first if open_ is None else open_, held + m
    if open_ is not None:
        out.append((open_, last))
    return out


def read(spark: SparkSession, source: str, by: str | None = None, where: str | None = None, geom: str | None = None, epsg: int | None = None, rows: int = ROWS) -> DataFrame:
    """The table that a source names, by ranges of the column ``by``, a task for about ``rows`` rows. ``where`` is SQL of
    the database. The ranges come from counts that the database makes, so the driver sees at most BUCKETS of them at a
    time. A table without ``by``, or with one that is no whole number, is read in one task."""
    at = place(source)
    chosen = selection(at, where, geom, epsg)
    ask = lambda **what: spark.read.format("jdbc").options(url=at.url, fetchsize="10000", **at.login, **what).load()
    whole = ask(dbtable=chosen)
    field = next((f for f in whole.schema.fields if by and f.name.lower() == by.lower()), None)
    if field is None or not isinstance(field.dataType, WHOLE) or getattr(field.dataType, "scale", 0):
        return whole
    quote = "`" if at.url.startswith(("jdbc:mysql:", "jdbc:mariadb:")) else '"'
    by = f"{quote}{field.name}{quote}"
    low, high, n, all_ = ask(query=f"SELECT MIN({by}) AS low, MAX({by}) AS high, COUNT({by}) AS known, COUNT(*) AS n FROM {chosen}").first()
    if not n or all_ <= rows:
        return whole

    def count(a: int, b: int, width: int) -> list[tuple[int, int]]:
        rest = f"({by} - ({a})) % {width}" if at.url.startswith("jdbc:sqlite:") else f"MOD({by} - ({a}), {width})"
        found = ask(query=f"SELECT low, COUNT(*) AS n FROM (SELECT {by} - {rest} AS low FROM {chosen} WHERE {by} BETWEEN {a} AND {b}) q GROUP BY low")
        return [(int(first), int(m)) for first, m in found.collect()]

    conditions = [f"{by} BETWEEN {a} AND {b}" for a, b in ranges(count, int(low), int(high), int(n), rows)]
    if all_ > n:
        conditions.append(f"{by} IS NULL")
    return spark.read.jdbc(at.url, chosen, predicates=conditions, properties={"fetchsize": "10000", **at.login})


def write(df: DataFrame, target: str, replace: bool = True, comment: str = "", batch: int = 10_000) -> None:
    """To the table that a target names, as a source does (or ``url|table``), with a comment where the database has any."""
    at = Place(*target.split("|"), {}) if "|" in target else place(target)
    writer = df.write.mode("overwrite" if replace else "errorifexists").option("batchsize", batch).options(**at.login)
    if comment:
        writer = writer.option("tableComment", comment)
    writer.jdbc(at.url, at.table)
