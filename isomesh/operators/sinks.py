"""Result relations: their columns in order, text with fixed decimals, and tables with a comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isomesh.functions.geom import to_wkt
from isomesh.sources import database

STATISTICS = [f"{s}_{v}" for v in ("distance", "tt", "value", "kcal", "price", "co2") for s in ("avg", "med", "min", "max", "p15", "p85")]
#: The columns of the result relations.
RELATIONS = {
    "od": ["fid", "sid", "avg_distance", "avg_tt", "avg_num", "avg_value"],
    "ext_od": ["fid", "sid", "avg_distance", "avg_tt", "avg_num", "avg_value", "avg_kcal", "avg_price", "avg_co2", "avg_interchanges", "avg_access", "avg_egress", "avg_waiting_time", "avg_init_waiting_time", "avg_pt_tt", "avg_pt_interchange_time", "modes", "beeline_distance", "manhattan_distance"],
    "stat_od": ["fid", "sid", "num", *STATISTICS],
    "pt": ["fid", "sid", *(f"avg_{m}" for m in ("distance", "tt", "access_distance", "access_tt", "egress_distance", "egress_tt", "interchange_distance", "interchange_tt", "pt_distance", "pt_tt", "num_interchanges", "waiting_time", "init_waiting_time", "num", "value"))],
    "process": ["fid", "duration", "path_length", "seen_edges", "seen_nodes"],
    "interchanges": ["fid", "sid", "halt", "line_from", "line_to", "num", "tt"],
    "edges": ["fid", "sid", "eid", "num", "origins_weight", "normed"],
    "direct": ["fid", "sid", "edge", "line", "mode", "tt", "node", "idx", "geom"],
    "mapping": ["id", "rid", "rpos", "dist", "conn"],
    "subnets": ["edge_id", "cell_id", "cell_size"],
    "net_errors": ["description", "edge1", "edge2"],
    "crossings": ["from_edge", "to_edge", "delay"],
}


#: Columns by which lines of text are in order, over all files.
ORDER = ("fid", "sid", "dest_type", "idx", "halt", "line_from", "line_to", "eid", "id", "cell_id", "edge_id", "from_edge", "to_edge", "edge1")

#: What producers call a column of a relation.
CALLED = {
    "ext_od": {"avg_init_waiting_time": "avg_initial_waiting", "avg_waiting_time": "avg_waiting", "avg_pt_interchange_time": "avg_interchange_time", "modes": "lines", "beeline_distance": "avg_beeline", "manhattan_distance": "avg_manhattan"},
    "stat_od": {f"{s}_distance": f"{s}_dist" for s in ("avg", "med", "min", "max", "p15", "p85")},
    "direct": {"fid": "origin", "sid": "destination"},
    "mapping": {"id": "object_id", "rid": "edge_id", "rpos": "pos"},
    "net_errors": {},
}
#: Columns that a relation may lack: they are null then.
OPTIONAL = {"net_errors": {"edge2"}}


def shaped(df: DataFrame, relation: str) -> DataFrame:
    """The relation's columns in order (dest_type last, if there is one), under its own names or the producers', doubles
    as float32. A column that is absent is an error, unless the relation may lack it."""
    kinds, called = dict(df.dtypes), CALLED.get(relation, {})
    out, absent = [], []
    for n in [*RELATIONS[relation], *(["dest_type"] if "dest_type" in kinds else [])]:
        source = n if n in kinds else called.get(n)
        if source in kinds:
            out.append((F.col(f"`{source}`").cast("float") if kinds[source] == "double" else F.col(f"`{source}`")).alias(n))
        elif n in OPTIONAL.get(relation, ()):
            out.append(F.lit(None).cast("string").alias(n))
        else:
            absent.append(n)
    if absent:
        raise ValueError(f"{relation} needs {', '.join(absent)}")
    return df.select(*out)


def as_text(df: DataFrame, precision: int = 2) -> DataFrame:
    """One text column: fields divided by semicolons, numbers with fixed decimals, lines as WKT, sets in brackets."""

    def field(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.format_string(f"%.{precision}f", c.cast("double"))
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            return to_wkt(c) if isinstance(inner, T.StructType) else F.concat(F.lit("["), F.array_join(F.array_sort(c), ", "), F.lit("]"))
        return c.cast("string")

    return df.select(F.concat_ws(";", *(F.coalesce(field(f), F.lit("")) for f in df.schema.fields)).alias("value"))


def write(df: DataFrame, target: str, precision: int = 2, comment: str | None = None) -> None:
    """To a text file (.csv, .txt), a Parquet folder, a table of a database, or a table of the catalog."""
    if target.endswith((".csv", ".txt")):
        order = [c for c in ORDER if c in df.columns]
        as_text(df.sort(*order) if order else df, precision).write.mode("overwrite").text(target)
    elif database.is_database(target):
        database.write(df, target, comment=masked(comment or ""))
    elif "/" in target:
        df.write.mode("overwrite").parquet(target)
    else:
        df.write.mode("overwrite").option("comment", masked(comment or "")).saveAsTable(target)


def masked(options: str) -> str:
    """A text of options without passwords."""
    import re

    return re.sub(r"((?:jdbc|db)[^\s]*?[;,])([^;,\s]+)([;,])([^;,\s]+)$|(password\s*[=:]\s*)\S+", lambda m: f"{m[5]}xxx" if m[5] else f"{m[1]}{m[2]}{m[3]}xxx", options, flags=re.I)
