"""Queries of the catalogue against their SQL in DuckDB."""

import duckdb
import pytest

from isomesh.plans import catalog

SMALL = "/root/testdata/sf0.001"
NAMES = ["od_within_time", "map_origins", "limit_value", "od_measures_by_areas", "od_statistics", "subnet_cells", "crossing_delays", "net_lines", "next_arrivals", "running_services", "transit_labels", "map_roads"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    expected = duck.sql(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(expected, key=str) and expected


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
