"""A road network, objects and timetables derived from the driver's tables, in SQL that Spark and DuckDB both read.

Every part is a node of a square grid, 120 m apart; neighbours are joined by two edges. Customers are origins,
suppliers destinations, orders with their lines give pairs and trips, events give speeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Views by name; a view may use those before it.
VIEWS = {
    "grid": "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM part",
    "nodes": """
        SELECT p_partkey AS node_id, p_partkey % side AS ix, CAST(floor(p_partkey / side) AS BIGINT) AS iy, CAST(p_size AS BIGINT) AS size,
               120e0 * (p_partkey % side) AS x, 120e0 * floor(p_partkey / side) AS y
        FROM part, grid""",
    "ties": """
        SELECT 'h' AS d, a.node_id AS u, b.node_id AS v, a.size, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM nodes a JOIN nodes b ON b.iy = a.iy AND b.ix = a.ix + 1
        UNION ALL
        SELECT 'v', a.node_id, b.node_id, a.size, a.x, a.y, b.x, b.y FROM nodes a JOIN nodes b ON b.ix = a.ix AND b.iy = a.iy + 1""",
    "edges": """
        SELECT concat(d, CAST(u AS STRING), 'a') AS edge_id, concat(d, CAST(u AS STRING), 'b') AS opposite_id, u AS from_node, v AS to_node,
               CAST(2 + 8 + CASE WHEN size % 4 <> 0 THEN 4 ELSE 0 END AS BIGINT) AS modes, CASE size % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 10e0 ELSE 20e0 END AS vmax,
               120e0 AS length, CAST(size % 15 - 7 AS DOUBLE) AS incline, x1, y1, x2, y2 FROM ties
        UNION ALL
        SELECT concat(d, CAST(u AS STRING), 'b'), concat(d, CAST(u AS STRING), 'a'), v, u,
               CAST(2 + 8 + CASE WHEN size % 4 <> 0 THEN 4 ELSE 0 END AS BIGINT), CASE size % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 10e0 ELSE 20e0 END,
               120e0, CAST(7 - size % 15 AS DOUBLE), x2, y2, x1, y1 FROM ties""",
    "origins": """
        SELECT c_custkey AS object_id, 0.25e0 + (c_custkey * 7919) % (side * 120 - 120) AS cx, 0.5e0 + (c_custkey * 104729) % (side * 120 - 120) AS cy,
               CAST(1 + c_custkey % 4 AS DOUBLE) AS weight, CAST(c_nationkey AS BIGINT) AS nation FROM customer, grid""",
    "destinations": """
        SELECT s_suppkey AS object_id, 0.75e0 + (s_suppkey * 6007) % (side * 120 - 120) AS cx, 0.125e0 + (s_suppkey * 3001) % (side * 120 - 120) AS cy,
               CAST(1 + s_suppkey % 5 AS DOUBLE) AS value, n_name AS nation, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, grid""",
    "areas": """
        SELECT i * 4 + j AS object_id, i * w AS x1, j * w AS y1, (i + 1) * w AS x2, (j + 1) * w AS y2
        FROM (SELECT DISTINCT CAST(n_nationkey % 4 AS BIGINT) AS i FROM nation) a, (SELECT DISTINCT CAST(n_nationkey % 3 AS BIGINT) AS j FROM nation) b, (SELECT side * 30e0 AS w FROM grid) c""",
    "spells": """
        SELECT concat(CASE user_id % 2 WHEN 0 THEN 'h' ELSE 'v' END, CAST(user_id AS STRING), 'a') AS edge_id, CAST(3600 * hour(ts) AS DOUBLE) AS ibegin,
               CAST(3600 * hour(ts) + 1800 AS DOUBLE) AS iend, CAST(min(event_id % 21) AS DOUBLE) AS speed
        FROM events GROUP BY user_id, hour(ts)""",
    "calls": """
        SELECT l_orderkey AS trip, CAST(l_linenumber AS BIGINT) AS seq, min(l_partkey) AS stop, CAST(21600 + (l_orderkey % 40) * 900 + l_linenumber * 240 + min(l_partkey) % 5 * 30 AS BIGINT) AS arr
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "mapped": """
        WITH d AS (SELECT o.object_id, o.cx, o.cy, e.edge_id, e.opposite_id, e.length,
                     (o.cx - x1) * (x2 - x1) / 120e0 + (o.cy - y1) * (y2 - y1) / 120e0 AS run, (x2 - x1) * (o.cy - y1) - (y2 - y1) * (o.cx - x1) AS side,
                     sqrt(pow(least(greatest(o.cx, least(x1, x2)), greatest(x1, x2)) - o.cx, 2) + pow(least(greatest(o.cy, least(y1, y2)), greatest(y1, y2)) - o.cy, 2)) AS dist
                   FROM (SELECT object_id, cx, cy FROM {objects}) o, edges e),
             m AS (SELECT object_id, min(dist) AS least_d FROM d GROUP BY object_id),
             n AS (SELECT d.object_id, min(edge_id) AS e FROM d JOIN m ON d.object_id = m.object_id AND d.dist = m.least_d GROUP BY d.object_id),
             p AS (SELECT d.*, row_number() OVER (PARTITION BY d.object_id ORDER BY CASE WHEN side < 0 THEN 0 ELSE 1 END, d.edge_id DESC) AS k
                   FROM d JOIN n ON d.object_id = n.object_id AND (d.edge_id = n.e OR d.opposite_id = n.e))
        SELECT object_id, edge_id, dist, least(greatest(run, 0e0), length) AS pos FROM p WHERE k = 1""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def clauses(*names: str, **more: str) -> str:
    """WITH clauses for DuckDB: the named views and what they need, then further ones."""
    wanted = list(VIEWS)[: max(list(VIEWS).index(n) for n in names) + 1]
    wanted = [n for n in wanted if n in names or n in ("grid", "nodes", "ties", "edges") and {"edges", "nodes", "ties"} & set(names) or n == "grid"]
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted if n != "mapped"] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return ", ".join(parts)


def mapped_sql(objects: str) -> str:
    return VIEWS["mapped"].format(objects=objects)


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views as DataFrames."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n, sql in VIEWS.items():
        if n != "mapped":
            spark.sql(sql).createOrReplaceTempView(n)
    return [spark.table(n) for n in names]
