"""A deterministic transit network derived from the star-schema tables, in SQL that Spark and DuckDB both run.

``{div}`` is the integer division of the dialect. Only test inputs are written this way; operators are
DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name -> SQL over base tables and earlier names.
TABLES: dict[str, str] = {
    "dims": """SELECT CAST(4 * count(*) AS BIGINT) AS n_stops, CAST(2 * count(*) AS BIGINT) AS n_patterns,
        CAST(CASE WHEN count(*) < 50 THEN 20 WHEN count(*) < 500 THEN 40 ELSE 80 END AS BIGINT) AS w FROM supplier""",
    "positions": "SELECT CAST(c AS BIGINT) AS pos FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(c)",
    "stops": """SELECT p_partkey AS stop_idx, 't:' || CAST(p_partkey AS VARCHAR(20)) AS stop_id, p_name AS name,
        419000000 + (p_partkey {div} 20) * 30000 AS lat_e7, 125000000 + (p_partkey % 20) * 30000 AS lon_e7
        FROM part CROSS JOIN dims WHERE p_partkey < n_stops""",
    "pattern_ids": "SELECT p_partkey AS pattern FROM part CROSS JOIN dims WHERE p_partkey < n_patterns",
    "pattern_stops": """SELECT pattern, pos, CAST((2 * pattern + pos * CASE pattern % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 9 END) % n_stops AS BIGINT) AS stop_idx
        FROM pattern_ids CROSS JOIN positions CROSS JOIN dims""",
    "routes": """SELECT pattern, CAST(pattern % 25 AS BIGINT) AS route_id, n_name AS short, CAST(CASE WHEN (pattern % 25) % 10 = 0 THEN 1 ELSE 3 END AS BIGINT) AS type
        FROM pattern_ids JOIN nation ON n_nationkey = pattern % 25""",
    "trips": """SELECT o_orderkey AS trip, o_custkey % n_patterns AS pattern, o_orderpriority AS service, 18000 + (o_orderkey * 37) % 68400 AS dep0
        FROM orders CROSS JOIN dims""",
    "timetable": """SELECT trip, t.pattern, CAST(row_number() OVER (PARTITION BY t.pattern, pos ORDER BY dep0, trip) - 1 AS BIGINT) AS trip_rank, pos, stop_idx,
        dep0 + pos * (90 + 30 * (t.pattern % 3)) AS arr, dep0 + pos * (90 + 30 * (t.pattern % 3)) + CASE WHEN pos < 7 THEN 20 ELSE 0 END AS dep, 10 * (pos + 1) AS seq, service
        FROM trips t JOIN pattern_stops p ON p.pattern = t.pattern""",
    "timetable_jitter": "SELECT trip, pattern, pos, stop_idx, arr + ((trip + pos) % 3) * 600 AS arr, dep, seq FROM timetable",
    "stop_times_gappy": """SELECT trip, pos, seq, stop_idx, CASE WHEN (trip + pos) % 5 IN (1, 2, 3) THEN NULL ELSE arr + (3 * pos + trip) % 7 END AS arr,
        CASE WHEN (trip + pos) % 5 IN (1, 2, 3) THEN NULL ELSE dep + (3 * pos + trip) % 7 END AS dep FROM timetable""",
    "services": """SELECT service, CAST(mask AS BIGINT) AS mask, CAST(20260101 AS BIGINT) AS start_date, CAST(20261231 AS BIGINT) AS end_date
        FROM (VALUES ('1-URGENT', 127), ('2-HIGH', 31), ('3-MEDIUM', 127), ('4-NOT SPECIFIED', 31), ('5-LOW', 96)) v(service, mask)""",
    "service_exceptions": """SELECT service, CAST(date AS BIGINT) AS date, kind FROM (VALUES ('4-NOT SPECIFIED', 20260710, 'remove'), ('5-LOW', 20260710, 'add')) v(service, date, kind)""",
    "transfers": """SELECT stop_idx AS from_stop, stop_idx + 1 AS to_stop, 1800 + (stop_idx % 5) * 103 AS ds FROM stops CROSS JOIN dims WHERE stop_idx % 4 <> 3 AND stop_idx + 1 < n_stops
        UNION ALL SELECT stop_idx + 1, stop_idx, 1800 + (stop_idx % 5) * 103 FROM stops CROSS JOIN dims WHERE stop_idx % 4 <> 3 AND stop_idx + 1 < n_stops""",
    "requests": """SELECT s_suppkey AS query_id, s_suppkey % n_stops AS source, 21600 + (s_suppkey * 60) % 50400 AS dep_sec, (s_suppkey * 13 + 11) % n_stops AS target, 30 * (s_suppkey % 5) AS egress_sec
        FROM supplier CROSS JOIN dims""",
    "g_nodes": """SELECT o_orderkey AS node, 419000000 + (o_orderkey {div} w) * 30000 AS lat_e7, 125000000 + (o_orderkey % w) * 30000 AS lon_e7
        FROM orders CROSS JOIN dims WHERE o_orderkey < w * w""",
    "g_pairs": """SELECT node AS a, node + 1 AS b, 300 + (node % 7) * 10 AS meters, 30 + 10 * (node % 4) AS speed, node % 11 AS m FROM g_nodes CROSS JOIN dims WHERE node % w < w - 1
        UNION ALL SELECT node, node + w, 300 + (node % 7) * 10, 30 + 10 * (node % 4), node % 11 FROM g_nodes CROSS JOIN dims WHERE node + w < w * w""",
    "g_edges": """SELECT a * 4 + CASE WHEN b = a + 1 THEN 0 ELSE 2 END AS edge, a AS src, b AS dst, meters, CAST(7 AS BIGINT) AS flags, speed FROM g_pairs
        UNION ALL SELECT a * 4 + CASE WHEN b = a + 1 THEN 1 ELSE 3 END, b, a, meters, CAST(CASE WHEN m = 0 THEN 4 ELSE 7 END AS BIGINT), speed FROM g_pairs""",
    "shapes": """SELECT pattern AS shape_id, 2 * pos AS idx, lat_e7, lon_e7 FROM pattern_stops p JOIN stops s ON s.stop_idx = p.stop_idx
        UNION ALL SELECT pattern, 2 * pos + 1, lat_e7 + 3000, lon_e7 + 3000 FROM pattern_stops p JOIN stops s ON s.stop_idx = p.stop_idx""",
    "rt_entities": """SELECT event_id, event_id AS feed_ts, (event_id * 7) % n AS trip, event_type AS kind, 10 * (1 + user_id % 8) AS seq,
        CAST(floor(value) AS BIGINT) AS delay, user_id % 3 AS status FROM events CROSS JOIN (SELECT count(*) AS n FROM orders) o""",
    "gps_fixes": """SELECT event_id, user_id AS session_id, CAST(floor(date_part('epoch', ts)) AS BIGINT) AS {q}at{q}, 419000000 + ((event_id % n_stops) {div} 20) * 30000 + CAST(floor(value) AS BIGINT) AS lat_e7,
        125000000 + ((event_id % n_stops) % 20) * 30000 + CAST(floor(value) AS BIGINT) AS lon_e7, value AS accuracy FROM events CROSS JOIN dims""",
}


def _needs(name: str, seen: list[str]) -> list[str]:
    for other in TABLES:
        if other != name and other not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", TABLES[name]):
            _needs(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def ctes(*names: str) -> str:
    """DuckDB: the common table expressions of ``names`` and of all that they build on."""
    order: list[str] = []
    for n in names:
        _needs(n, order)
    return ",\n".join(f"{n} AS ({TABLES[n].format(div='//', q='"')})" for n in order)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark: one derived table over the Parquet tables of ``sf_dir``."""
    order = _needs(name, [])
    text = "WITH " + ",\n".join(f"{n} AS ({TABLES[n].format(div='div', q='`')})" for n in order) + f"\nSELECT * FROM {name}"
    text = text.replace("date_part('epoch', ts)", "unix_timestamp(CAST(ts AS TIMESTAMP))")
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(BASE)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` AS {m[2]}", text))
