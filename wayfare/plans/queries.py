"""One query for each operator over the derived network, and the DuckDB SQL that answers it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import ctes, fixture
from ..functions import geo, parse
from ..operators import itineraries, realtime, routing, street, timetable
from ..store import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DATE, PREVIOUS = 20260710, 20260709


def query(sql: str | None = None, *tables: str, recursive: bool = False):
    """Register a query under its function's name; ``sql`` is its answer over the derived ``tables``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = ctes(*tables)
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if head and sql.lstrip().startswith('+') else ''}{sql.lstrip().lstrip('+')}" if head else sql
        return f

    return add


def fx(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [fixture(spark, d, n) for n in names]


# --- scalars -------------------------------------------------------------------------------------------------


@query("SELECT a.stop_idx AS a, CAST(round(sqrt(power((b.lon_e7 - a.lon_e7) / 1e7 * cos(radians((a.lat_e7 + b.lat_e7) / 2e7)), 2) + power((b.lat_e7 - a.lat_e7) / 1e7, 2)) * 111194.9, 3) AS DOUBLE) AS m FROM stops a JOIN stops b ON b.stop_idx = (a.stop_idx * 7 + 3) % (SELECT n_stops FROM dims)", "stops", "dims")
def geo_dist(spark: SparkSession, d: str) -> DataFrame:
    a, b = _stop_pairs(spark, d)
    return a.join(b, "k").select("a", F.round(geo.distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 3).alias("m"))


def _stop_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stops, dims = fx(spark, d, "stops", "dims")
    n = dims.first().n_stops
    a = stops.select(F.col("stop_idx").alias("a"), F.col("lat_e7").alias("lat1"), F.col("lon_e7").alias("lon1"), ((F.col("stop_idx") * 7 + 3) % n).alias("k"))
    return a, stops.select(F.col("stop_idx").alias("k"), F.col("lat_e7").alias("lat2"), F.col("lon_e7").alias("lon2"))


_PAIR = "FROM stops a JOIN stops b ON b.stop_idx = (a.stop_idx * 7 + 3) % (SELECT n_stops FROM dims)"


@query(f"SELECT a.stop_idx AS a, round(2 * 6371008.8 * asin(sqrt(power(sin(radians((b.lat_e7 - a.lat_e7) / 1e7) / 2), 2) + cos(radians(a.lat_e7 / 1e7)) * cos(radians(b.lat_e7 / 1e7)) * power(sin(radians((b.lon_e7 - a.lon_e7) / 1e7) / 2), 2))), 3) AS m {_PAIR}", "stops", "dims")
def haversine(spark: SparkSession, d: str) -> DataFrame:
    a, b = _stop_pairs(spark, d)
    return a.join(b, "k").select("a", F.round(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 3).alias("m"))


@query(f"""+ x AS (SELECT a.stop_idx AS a, radians(a.lat_e7 / 1e7) AS p, radians(b.lat_e7 / 1e7) AS q, radians((b.lon_e7 - a.lon_e7) / 1e7) AS l {_PAIR})
SELECT a, round(CASE WHEN v < 0 THEN v + 360 ELSE v END, 6) AS deg FROM (SELECT a, degrees(atan2(sin(l) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(l))) AS v FROM x)""", "stops", "dims")
def bearing(spark: SparkSession, d: str) -> DataFrame:
    a, b = _stop_pairs(spark, d)
    return a.join(b, "k").select("a", F.round(geo.bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6).alias("deg"))


@query("""+ x AS (SELECT p_partkey AS id, CAST((p_partkey * 37) % 721 - 360 AS DOUBLE) AS d FROM part), y AS (SELECT id, d - 360 * floor(d / 360) AS m FROM x), z AS (SELECT id, CASE WHEN m > 180 THEN m - 360 ELSE m END AS t FROM y)
SELECT id, t AS angle, CASE WHEN abs(t) < 25 THEN 'straight' WHEN abs(t) < 60 THEN 'slight ' || s WHEN abs(t) < 130 THEN s WHEN abs(t) < 165 THEN 'sharp ' || s ELSE 'uturn' END AS modifier FROM (SELECT *, CASE WHEN t < 0 THEN 'left' ELSE 'right' END AS s FROM z)""", "dims")
def turn_modifier(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37) % 721 - 360).cast("double").alias("d"))
    t = geo.turn(F.lit(0.0), F.col("d"))
    return p.select("id", t.alias("angle"), geo.modifier(t).alias("modifier"))


@query("""+ x AS (SELECT s.stop_idx, s.lat_e7 + 4000 + s.stop_idx % 7 * 1000 AS plat, s.lon_e7 + 9000 AS plon, s.lat_e7 AS alat, s.lon_e7 AS alon, s.lat_e7 + 3000 AS blat, s.lon_e7 + 30000 AS blon FROM stops s),
y AS (SELECT *, (blon - alon) * cos(radians(plat / 1e7)) AS bx, CAST(blat - alat AS DOUBLE) AS byy, (plon - alon) * cos(radians(plat / 1e7)) AS px, CAST(plat - alat AS DOUBLE) AS py FROM x),
z AS (SELECT *, greatest(0.0, least(1.0, (px * bx + py * byy) / (bx * bx + byy * byy))) AS t FROM y)
SELECT stop_idx, round(t, 9) AS t, CAST(alat + round(t * (blat - alat)) AS BIGINT) AS lat_e7, CAST(alon + round(t * (blon - alon)) AS BIGINT) AS lon_e7 FROM z""", "stops")
def project_segment(spark: SparkSession, d: str) -> DataFrame:
    (s,) = fx(spark, d, "stops")
    lat, lon = F.col("lat_e7"), F.col("lon_e7")
    q = geo.project(lat + 4000 + F.col("stop_idx") % 7 * 1000, lon + 9000, lat, lon, lat + 3000, lon + 30000)
    return s.select("stop_idx", q.alias("q")).select("stop_idx", F.round("q.t", 9).alias("t"), "q.lat_e7", "q.lon_e7")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE (p_partkey % 30) * 3600 + (p_partkey % 60) * 60 + p_partkey * 7 % 60 END AS sec FROM part""", "dims")
def parse_gtfs_time(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    text = F.format_string("%s%d:%02d:%02d%s", F.when(p % 5 == 1, " ").otherwise(""), p % 30, p % 60, p * 7 % 60, F.when(p % 5 == 4, "x").otherwise(""))
    return spark.read.parquet(f"{d}/part.parquet").select(p.alias("id"), parse.gtfs_time(text).alias("sec"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 8 THEN NULL ELSE (CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END) * ((p_partkey % 170) * 10000000 + (((p_partkey * 7919) % 100000000) + 5) // 10) END AS e7 FROM part""", "dims")
def parse_e7(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    text = F.format_string("%s%d.%08d%s", F.when(p % 2 == 1, "-").otherwise(""), p % 170, p * 7919 % 100000000, F.when(p % 9 == 8, "E").when(p % 9 == 7, "99").otherwise(""))
    return spark.read.parquet(f"{d}/part.parquet").select(p.alias("id"), parse.degrees_e7(text).alias("e7"))


@query("""SELECT stop_idx, CAST(CASE WHEN v < 0 THEN -((-v + 50) // 100) ELSE (v + 50) // 100 END AS BIGINT) AS e5 FROM (SELECT stop_idx, lat_e7 * (CASE WHEN stop_idx % 2 = 0 THEN 1 ELSE -1 END) + stop_idx * 13 AS v FROM stops)""", "stops")
def e7_to_e5(spark: SparkSession, d: str) -> DataFrame:
    (s,) = fx(spark, d, "stops")
    v = F.col("lat_e7") * F.when(F.col("stop_idx") % 2 == 0, 1).otherwise(-1) + F.col("stop_idx") * 13
    return s.select("stop_idx", geo.e7_to_e5(v).alias("e5"))


@query("""SELECT p_partkey AS id, substr(t, 1, 3) || '/' || substr(t, 4, 3) || '/' || substr(t, 7, 3) AS path FROM (SELECT p_partkey, lpad(CAST(p_partkey * 3901 % 1000000000 AS VARCHAR), 9, '0') AS t FROM part)""", "dims")
def seq_path(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), parse.sequence_path(F.col("p_partkey") * 3901 % 1000000000).alias("path"))


_SPEEDS = ["50", "90", "30 mph", "30mph", "none", "walk", "IT:rural", "140", "60 km/h", "signals"]


@query("""SELECT p_partkey AS id, CAST([50, 87, 48, 48, NULL, 5, 87, 123, 60, NULL][p_size % 10 + 1] AS BIGINT) AS kmh FROM part""", "dims")
def maxspeed(spark: SparkSession, d: str) -> DataFrame:
    tag = F.element_at(F.array(*[F.lit(x) for x in _SPEEDS]), (F.col("p_size") % 10 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), parse.maxspeed(tag).alias("kmh"))


# --- timetable -----------------------------------------------------------------------------------------------


@query("+ x AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY seq, stop_idx) - 1 AS pos2 FROM timetable) SELECT trip, stop_idx, CAST(pos2 AS BIGINT) AS pos FROM x", "timetable")
def stop_time_order(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable")
    return timetable.in_stop_order(t.select("trip", "seq", "stop_idx", F.col("stop_idx").alias("file_pos"))).select("trip", "stop_idx", "pos")


@query("""+ n AS (SELECT trip, pos, arr, dep, first_value(arr IGNORE NULLS) OVER w AS nxt, coalesce(first_value(CASE WHEN arr IS NOT NULL THEN pos END IGNORE NULLS) OVER w, 8) - pos AS gapn
  FROM stop_times_gappy WINDOW w AS (PARTITION BY trip ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r AS (
  SELECT trip, pos, coalesce(arr, nxt, 0) AS a, coalesce(dep, nxt, 0) AS b FROM n WHERE pos = 0
  UNION ALL SELECT n.trip, n.pos, CASE WHEN n.arr IS NOT NULL THEN n.arr WHEN n.nxt IS NULL THEN r.b ELSE r.b + greatest(n.nxt - r.b, 0) // (n.gapn + 1) END,
    CASE WHEN n.arr IS NOT NULL THEN n.dep WHEN n.nxt IS NULL THEN r.b ELSE r.b + greatest(n.nxt - r.b, 0) // (n.gapn + 1) END
  FROM r JOIN n ON n.trip = r.trip AND n.pos = r.pos + 1)
SELECT trip, pos, a AS arr, b AS dep FROM r""", "stop_times_gappy", recursive=True)
def interpolate_times(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "stop_times_gappy")
    return timetable.interpolate(t).select("trip", "pos", "arr", "dep")


@query("""+ r AS (
  SELECT trip, pos, arr, dep FROM timetable_jitter WHERE pos = 0
  UNION ALL SELECT t.trip, t.pos, greatest(t.arr, r.dep), greatest(t.dep, greatest(t.arr, r.dep)) FROM r JOIN timetable_jitter t ON t.trip = r.trip AND t.pos = r.pos + 1)
SELECT trip, pos, arr, dep FROM r""", "timetable_jitter", recursive=True)
def monotonic_times(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable_jitter")
    return timetable.monotonic(t)


@query("SELECT DISTINCT pattern, trip, trip_rank FROM timetable", "timetable")
def trip_rank(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable")
    return timetable.trip_rank(t).select("pattern", "trip", "trip_rank")


@query("""+ s AS (SELECT t.trip, any_value(r.route_id) AS route_id, string_agg(CAST(stop_idx AS VARCHAR), ',' ORDER BY pos) AS stops FROM timetable t JOIN routes r ON r.pattern = t.pattern GROUP BY t.trip)
SELECT route_id, stops, count(*) AS n_trips, min(trip) AS first_trip FROM s GROUP BY route_id, stops""", "timetable", "routes")
def patterns(spark: SparkSession, d: str) -> DataFrame:
    t, trips, routes = fx(spark, d, "timetable", "trips", "routes")
    p = timetable.patterns(t, trips.join(routes, "pattern").select("trip", "route_id"))
    return p.select("route_id", F.array_join(F.transform("stops", lambda x: x.cast("string")), ",").alias("stops"), "n_trips", "first_trip")


_ACTIVE = """act AS (SELECT CAST(v.d AS BIGINT) AS date, s.service FROM services s CROSS JOIN (VALUES (20260709, 3), (20260710, 4), (20260711, 5), (20270101, 4)) v(d, wd)
  WHERE CASE WHEN EXISTS (SELECT 1 FROM service_exceptions e WHERE e.service = s.service AND e.date = v.d AND e.kind = 'remove') THEN FALSE
    WHEN EXISTS (SELECT 1 FROM service_exceptions e WHERE e.service = s.service AND e.date = v.d AND e.kind = 'add') THEN TRUE
    ELSE (s.mask >> v.wd) & 1 = 1 AND v.d BETWEEN s.start_date AND s.end_date END)"""


@query(f"+ {_ACTIVE} SELECT date, service FROM act", "services", "service_exceptions")
def active_services(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d)


def _active(spark: SparkSession, d: str) -> DataFrame:
    s, e = fx(spark, d, "services", "service_exceptions")
    dates = spark.createDataFrame([(20260709,), (20260710,), (20260711,), (20270101,)], "date long")
    return timetable.active_services(s, e, dates)


@query("""SELECT trip, t.pattern, t.service, route_id, short, type, mask FROM trips t JOIN routes r ON r.pattern = t.pattern JOIN services s ON s.service = t.service""", "trips", "routes", "services")
def trips_enriched(spark: SparkSession, d: str) -> DataFrame:
    return timetable.trips_enriched(*fx(spark, d, "trips", "routes", "services")).select("trip", "pattern", "service", "route_id", "short", "type", "mask")


@query("""SELECT stop_idx FROM stops WHERE lat_e7 BETWEEN 419060000 - 179858 AND 419120000 + 179858 AND lon_e7 BETWEEN 125060000 - 256410 AND 125120000 + 256410""", "stops")
def coverage_stops(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d, 419060000, 125060000, 419120000, 125120000).select("stop_idx")


def _covered(spark: SparkSession, d: str, *box: int) -> DataFrame:
    (s,) = fx(spark, d, "stops")
    return timetable.covered_stops(s, spark.createDataFrame([box], "min_lat long, min_lon long, max_lat long, max_lon long"))


@query("""+ bad AS (SELECT DISTINCT trip FROM timetable WHERE stop_idx NOT IN (SELECT stop_idx FROM stops WHERE lat_e7 BETWEEN 419000000 - 179858 AND 419120000 + 179858 AND lon_e7 BETWEEN 125000000 - 256410 AND 125200000 + 256410))
SELECT route_id, short, count(*) AS excluded FROM bad JOIN trips USING (trip) JOIN routes USING (pattern) GROUP BY route_id, short ORDER BY excluded DESC, route_id LIMIT 12""", "timetable", "stops", "trips", "routes")
def exclusion_report(spark: SparkSession, d: str) -> DataFrame:
    t, trips, routes = fx(spark, d, "timetable", "trips", "routes")
    return timetable.exclusions(t, trips.join(routes, "pattern"), _covered(spark, d, 419000000, 125000000, 419120000, 125200000))


@query("""+ f AS (SELECT s_name AS id, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, s_suppkey FROM supplier) SELECT k, id, s_suppkey AS row FROM f WHERE n = 1""", "dims")
def gtfs_stops(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("id"), F.col("s_suppkey").alias("row"))
    return timetable.first_of(s, "k", "row")


@query("""SELECT 'a' AS feed, 'a:' || stop_id AS stop_id, lat_e7 FROM stops WHERE stop_idx % 2 = 0 UNION ALL SELECT 'b', 'b:' || stop_id, lat_e7 FROM stops WHERE stop_idx % 3 = 0""", "stops")
def merge_feeds(spark: SparkSession, d: str) -> DataFrame:
    (s,) = fx(spark, d, "stops")
    return timetable.merge_feeds({"a": s.where("stop_idx % 2 = 0"), "b": s.where("stop_idx % 3 = 0")}, "stop_id").select("feed", "stop_id", "lat_e7")


_DIST = "coalesce(sqrt(power((lon_e7 - lag(lon_e7) OVER w) / 1e7 * cos(radians((lat_e7 + lag(lat_e7) OVER w) / 2e7)), 2) + power((lat_e7 - lag(lat_e7) OVER w) / 1e7, 2)) * 111194.9, 0)"


@query(f"""+ x AS (SELECT shape_id, idx, {_DIST} AS step FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY idx))
SELECT shape_id, idx, CAST(floor(sum(step) OVER (PARTITION BY shape_id ORDER BY idx) * 10) AS BIGINT) AS cum_dm FROM x""", "shapes")
def shape_cumdist(spark: SparkSession, d: str) -> DataFrame:
    (s,) = fx(spark, d, "shapes")
    return timetable.shape_distance(s).select("shape_id", "idx", "cum_dm")


@query("SELECT pattern AS leg, shape_id, idx, lat_e7, lon_e7 FROM pattern_ids JOIN shapes ON shape_id = pattern WHERE idx BETWEEN pattern % 4 AND 8 + pattern % 4", "pattern_ids", "shapes")
def shape_slice(spark: SparkSession, d: str) -> DataFrame:
    p, s = fx(spark, d, "pattern_ids", "shapes")
    k = F.col("pattern") % 4
    return timetable.shape_slice(s, p.select(F.col("pattern").alias("leg"), F.col("pattern").alias("shape_id"), k.alias("from_idx"), (k + 8).alias("to_idx")))


@query("SELECT pattern, pos, stop_idx, 2 * pos AS shape_idx FROM pattern_stops", "pattern_stops")
def shape_anchors(spark: SparkSession, d: str) -> DataFrame:
    p, stops, s = fx(spark, d, "pattern_stops", "stops", "shapes")
    return timetable.shape_anchors(p.join(stops, "stop_idx"), s)


@query("""SELECT trip, pos, stop_idx, greatest(0, arr + CASE WHEN trip % 3 = 0 THEN pos * 30 - 60 ELSE 0 END) AS arr, greatest(0, dep + CASE WHEN trip % 3 = 0 THEN pos * 30 - 60 ELSE 0 END) AS dep FROM timetable""", "timetable")
def rt_adjusted_times(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable")
    delta = F.col("pos") * 30 - 60
    return timetable.scheduled_with_realtime(t, t.where("trip % 3 = 0").select("trip", "pos", delta.alias("arr_delta"), delta.alias("dep_delta")))


# --- routing -------------------------------------------------------------------------------------------------


def _day(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable")
    dates = spark.createDataFrame([(DATE, PREVIOUS)], "date long, previous long")
    return routing.layers(t, _active(spark, d), dates)


_DAY = f"""{_ACTIVE}, day AS MATERIALIZED (SELECT 1 AS layer, pattern, trip_rank, trip, pos, stop_idx, arr, dep FROM timetable JOIN act ON act.service = timetable.service AND act.date = {DATE}
  UNION ALL SELECT 0, pattern, trip_rank, trip, pos, stop_idx, arr - 86400, dep - 86400 FROM timetable JOIN act ON act.service = timetable.service AND act.date = {PREVIOUS})"""
_NET = ("timetable", "services", "service_exceptions", "pattern_stops", "requests", "transfers")


@query(f"+ {_DAY} SELECT query_id, layer, d.pattern, d.pos, min(trip_rank) AS trip_rank FROM requests r JOIN day d ON d.stop_idx = r.source AND d.pos < 7 AND d.dep >= 0 AND d.dep >= r.dep_sec GROUP BY ALL", *_NET)
def asof_board(spark: SparkSession, d: str) -> DataFrame:
    return _boarded(spark, d, _day(spark, d)).select("query_id", F.col("layer"), "pattern", "pos", "trip_rank")


def _boarded(spark: SparkSession, d: str, day: DataFrame) -> DataFrame:
    (r,) = fx(spark, d, "requests")
    ready = r.select("query_id", F.lit(DATE).cast("long").alias("date"), F.col("source").alias("stop"), F.col("dep_sec").alias("ready"))
    return routing.asof_board(ready, routing.boards(routing.rides(day)))


@query(f"""+ {_DAY}, b AS MATERIALIZED (SELECT query_id, layer, d.pattern, d.pos, min(trip_rank) AS trip_rank FROM requests r JOIN day d ON d.stop_idx = r.source AND d.pos < 7 AND d.dep >= 0 AND d.dep >= r.dep_sec GROUP BY ALL)
SELECT query_id, x.trip, b.pos AS board_pos, x.pos AS alight_pos, x.stop_idx AS alight, x.arr AS alight_arr FROM b JOIN day x ON x.layer = b.layer AND x.pattern = b.pattern AND x.trip_rank = b.trip_rank AND x.pos > b.pos AND x.arr >= 0""", *_NET)
def ride_expand(spark: SparkSession, d: str) -> DataFrame:
    day = _day(spark, d)
    return routing.ride_expand(_boarded(spark, d, day), routing.rides(day)).select("query_id", "trip", "board_pos", "alight_pos", "alight", "alight_arr")


def _departures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ride = materialize(routing.rides(_day(spark, d)), "rides")
    return materialize(routing.boards(ride), "boards"), ride


def _raptor(spark: SparkSession, d: str, max_transfers: int = 4, requests: DataFrame | None = None) -> DataFrame:
    board, ride = _departures(spark, d)
    r, x = fx(spark, d, "requests", "transfers")
    r = requests if requests is not None else r
    sources = r.select("query_id", F.lit(DATE).cast("long").alias("date"), F.col("source").alias("stop"), F.col("dep_sec").alias("arr"))
    targets = r.select("query_id", F.col("target").alias("stop"), F.col("egress_sec").alias("egress"))
    return routing.raptor(sources, targets, board, ride, x, max_transfers)


def _rounds(k: int) -> str:
    """SQL of k rounds without target pruning, which changes no earliest arrival."""
    out = ["l0 AS (SELECT query_id, source AS stop, dep_sec AS arr, FALSE AS ride FROM requests)", "best0 AS (SELECT query_id, stop, arr FROM l0)"]
    for i in range(1, k + 1):
        out.append(f"""b{i} AS (SELECT l.query_id, d.layer, d.pattern, d.pos, min(d.trip_rank) AS trip_rank FROM l{i - 1} l JOIN day d ON d.stop_idx = l.stop AND d.pos < 7 AND d.dep >= 0 AND d.dep >= l.arr + CASE WHEN l.ride THEN 90 ELSE 0 END GROUP BY ALL)""")
        out.append(f"""r{i} AS (SELECT b.query_id, x.stop_idx AS stop, min(x.arr) AS arr FROM b{i} b JOIN day x ON x.layer = b.layer AND x.pattern = b.pattern AND x.trip_rank = b.trip_rank AND x.pos > b.pos AND x.arr >= 0 GROUP BY ALL)""")
        out.append(f"""i{i} AS (SELECT r.* FROM r{i} r LEFT JOIN best{i - 1} o ON o.query_id = r.query_id AND o.stop = r.stop WHERE o.arr IS NULL OR r.arr < o.arr)""")
        out.append(f"""f{i} AS (SELECT w.* FROM (SELECT i.query_id, t.to_stop AS stop, min(i.arr + t.ds // 10 + (t.ds % 10) // 5) AS arr FROM i{i} i JOIN transfers t ON t.from_stop = i.stop GROUP BY ALL) w LEFT JOIN best{i - 1} o ON o.query_id = w.query_id AND o.stop = w.stop WHERE o.arr IS NULL OR w.arr < o.arr)""")
        out.append(f"""l{i} AS (SELECT query_id, stop, min(arr) AS arr, arg_min(ride, arr * 2 + CASE WHEN ride THEN 0 ELSE 1 END) AS ride FROM (SELECT query_id, stop, arr, TRUE AS ride FROM i{i} UNION ALL SELECT query_id, stop, arr, FALSE FROM f{i}) GROUP BY ALL)""")
        out.append(f"""best{i} AS (SELECT query_id, stop, min(arr) AS arr FROM (SELECT query_id, stop, arr FROM best{i - 1} UNION ALL SELECT query_id, stop, arr FROM l{i}) GROUP BY ALL)""")
    hits = " UNION ALL ".join(f"SELECT l.query_id, {i} AS rides, l.arr + r.egress_sec AS arr FROM l{i} l JOIN requests r ON r.query_id = l.query_id AND r.target = l.stop" for i in range(1, k + 1))
    return ",\n".join([*out, f"hits AS ({hits})"])


_PARETO = "SELECT query_id, CAST(rides AS BIGINT) AS rides, arr FROM (SELECT *, min(arr) OVER (PARTITION BY query_id ORDER BY rides ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits) WHERE before IS NULL OR arr < before"


@query(f"+ {_DAY}, {_rounds(5)} {_PARETO}", *_NET)
def raptor(spark: SparkSession, d: str) -> DataFrame:
    return _raptor(spark, d).select("query_id", "rides", "arr")


@query(f"+ {_DAY}, {_rounds(3)} {_PARETO}", *_NET)
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return routing.pareto(_raptor(spark, d, 2)).select("query_id", "rides", "arr")


def _from_stops(sql: str) -> str:
    return sql.replace("SELECT query_id, source AS stop, dep_sec AS arr, FALSE AS ride FROM requests", "SELECT query_id, (source + k) % (SELECT n_stops FROM dims) AS stop, dep_sec + 60 * k AS arr, FALSE AS ride FROM requests CROSS JOIN (VALUES (0), (1), (2)) v(k)")


@query(f"+ {_DAY}, {_from_stops(_rounds(3))} {_PARETO}", *_NET, "dims")
def plan_from_stops(spark: SparkSession, d: str) -> DataFrame:
    board, ride = _departures(spark, d)
    r, x, dims = fx(spark, d, "requests", "transfers", "dims")
    k = spark.range(3).select(F.col("id").alias("k"))
    n = dims.first().n_stops
    sources = r.join(F.broadcast(k)).select("query_id", F.lit(DATE).cast("long").alias("date"), ((F.col("source") + F.col("k")) % n).alias("stop"), (F.col("dep_sec") + 60 * F.col("k")).alias("arr"))
    targets = r.select("query_id", F.col("target").alias("stop"), F.col("egress_sec").alias("egress"))
    return routing.raptor(sources, targets, board, ride, x, 2).select("query_id", "rides", "arr")


def _back(k: int) -> str:
    """SQL of k rounds backwards: f holds the latest arrivals by ride, p the latest boardings."""
    walk = "t.ds // 10 + (t.ds % 10) // 5"
    out = [f"ze0 AS (SELECT query_id, target AS stop, dep_sec + 7200 - egress_sec AS dep FROM requests)", f"zf0 AS (SELECT query_id, stop, max(arr) AS arr FROM (SELECT query_id, stop, dep AS arr FROM ze0 UNION ALL SELECT query_id, t.from_stop, e.dep - ({walk}) FROM ze0 e JOIN transfers t ON t.to_stop = e.stop) GROUP BY ALL)"]
    for i in range(1, k + 1):
        out.append(f"""zo{i} AS MATERIALIZED (SELECT f.query_id, d.layer, d.pattern, d.pos, max(d.trip_rank) AS trip_rank FROM zf{i - 1} f JOIN day d ON d.stop_idx = f.stop AND d.pos > 0 AND d.arr >= 0 AND d.arr <= f.arr GROUP BY ALL)""")
        out.append(f"""ze{i} AS MATERIALIZED (SELECT o.query_id, x.stop_idx AS stop, max(x.dep) AS dep FROM zo{i} o JOIN day x ON x.layer = o.layer AND x.pattern = o.pattern AND x.trip_rank = o.trip_rank AND x.pos < o.pos AND x.dep >= 0 GROUP BY ALL)""")
        out.append(f"""zf{i} AS (SELECT query_id, stop, max(arr) AS arr FROM (SELECT query_id, stop, dep - 90 AS arr FROM ze{i} UNION ALL SELECT e.query_id, t.from_stop, e.dep - ({walk}) FROM ze{i} e JOIN transfers t ON t.to_stop = e.stop) GROUP BY ALL)""")
    every = " UNION ALL ".join(f"SELECT * FROM ze{i}" for i in range(1, k + 1))
    return ",\n".join([*out, f"latest AS (SELECT query_id, stop, max(dep) AS dep FROM ({every}) GROUP BY ALL)"])


_PROBES = "probes AS MATERIALIZED (SELECT r.query_id * 17 + k AS query_id, r.query_id AS asked, source, target, egress_sec, dep_sec + 7200 AS deadline, dep_sec + 7200 - greatest(0, CAST(ceil((dep_sec + 7200 - l.dep) / 60) AS BIGINT)) * 60 - 60 * k AS dep_sec FROM requests r JOIN latest l ON l.query_id = r.query_id AND l.stop = r.source CROSS JOIN (SELECT unnest(range(17)) AS k))"
_FORWARD = _rounds(5).replace("SELECT query_id, source AS stop, dep_sec AS arr, FALSE AS ride FROM requests", "SELECT query_id, source AS stop, dep_sec AS arr, FALSE AS ride FROM probes").replace("JOIN requests r ON r.query_id = l.query_id", "JOIN probes r ON r.query_id = l.query_id")


@query(f"""+ {_DAY}, {_back(5)}, {_PROBES}, {_FORWARD}, tried AS (SELECT p.asked, p.dep_sec, p.deadline, min(h.arr) AS arr FROM probes p JOIN hits h ON h.query_id = p.query_id GROUP BY ALL)
SELECT asked AS query_id, max(dep_sec) AS dep_sec, arg_max(arr, dep_sec) AS arr FROM tried WHERE arr <= deadline AND dep_sec >= 0 GROUP BY asked""", *_NET)
def arrive_by(spark: SparkSession, d: str) -> DataFrame:
    r, x = fx(spark, d, "requests", "transfers")
    board, ride = _departures(spark, d)
    r = r.select("query_id", F.lit(DATE).cast("long").alias("date"), F.col("source").alias("stop"), "source", "target", "egress_sec", (F.col("dep_sec") + 7200).alias("deadline"))
    ends = r.select("query_id", "date", F.col("target").alias("stop"), (F.col("deadline") - F.col("egress_sec")).alias("by"))
    latest = routing.latest_departures(ends, materialize(routing.alights(ride), "alights"), ride, x)
    return routing.arrive_by(r, latest, lambda tries: _raptor(spark, d, requests=tries))


_COST = f"greatest(1, (meters * {street.speed_factor(4.8)}) >> 16)"


def _foot_edges(spark: SparkSession, d: str) -> DataFrame:
    (e,) = fx(spark, d, "g_edges")
    return e.where("flags & 4 != 0").select("src", "dst", street.edge_cost(F.col("meters"), F.col("speed"), "foot", street.speed_factor(4.8)).alias("cost"))


@query(f"SELECT edge, {_COST} AS foot_ds, CAST(ceil(meters * 36 / speed) AS BIGINT) AS car_ds FROM g_edges", "g_edges")
def edge_cost(spark: SparkSession, d: str) -> DataFrame:
    (e,) = fx(spark, d, "g_edges")
    m, v = F.col("meters"), F.col("speed")
    return e.select("edge", street.edge_cost(m, v, "foot", street.speed_factor(4.8)).alias("foot_ds"), street.edge_cost(m, v, "car").alias("car_ds"))


def _spread(seeds: str, bound: int) -> str:
    """Bellman-Ford rounds as a recursion over (origin, node) with the best cost so far."""
    return f"""e AS (SELECT src, dst, {_COST} AS cost FROM g_edges WHERE flags & 4 <> 0),
    s(origin, node, ds) USING KEY (origin, node) AS (
      {seeds}
      UNION
      SELECT n.origin, n.node, n.ds FROM (SELECT s.origin, e.dst AS node, min(s.ds + e.cost) AS ds FROM s JOIN e ON e.src = s.node WHERE s.ds + e.cost <= {bound} GROUP BY ALL) n
      LEFT JOIN recurring.s o ON o.origin = n.origin AND o.node = n.node WHERE o.ds IS NULL OR n.ds < o.ds)"""


_SEEDS = "SELECT s_suppkey AS origin, s_suppkey * 37 % (w * w) AS node, CAST(0 AS BIGINT) AS ds FROM supplier CROSS JOIN dims"


@query(f"+ {_spread(_SEEDS, 9000)} SELECT origin, node, ds FROM s", "g_edges", "dims", recursive=True)
def near_search(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 9000)


def _near(spark: SparkSession, d: str, bound: int) -> DataFrame:
    (dims,) = fx(spark, d, "dims")
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{d}/supplier.parquet").crossJoin(F.broadcast(dims))  # dims has one row
    return routing.near_search(_foot_edges(spark, d), s.select(k.alias("origin"), (k * 37 % (F.col("w") * F.col("w"))).alias("node"), F.lit(0).cast("long").alias("ds")), bound)


@query(f"+ {_spread(_SEEDS, 7200)} SELECT origin, stop_idx AS stop, min(ds + stop_idx % 3 * 11 + 5) // 10 AS sec FROM s CROSS JOIN dims JOIN stops ON node = stop_idx * 5 % (w * w) GROUP BY ALL", "g_edges", "stops", "dims", recursive=True)
def access_stops(spark: SparkSession, d: str) -> DataFrame:
    s, dims = fx(spark, d, "stops", "dims")
    i = F.col("stop_idx")
    anchors = s.crossJoin(F.broadcast(dims)).select((i * 5 % (F.col("w") * F.col("w"))).alias("node"), i.alias("stop"), (i % 3 * 11).alias("extra"))
    return routing.access(_near(spark, d, 7200), anchors)


# --- street --------------------------------------------------------------------------------------------------

_HIGHWAYS = [*street.CLASSES, "proposed", "construction"]


def _ways(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    tags = F.map_from_arrays(F.array(*map(F.lit, ("highway", "maxspeed", "oneway", "bicycle", "name"))), F.array(pick(_HIGHWAYS, p % 24), pick(_SPEEDS, F.col("p_size") % 10), pick([None, "yes", "-1", "1"], p % 4), pick([None, "no", "yes", None, None], p % 5), F.col("p_name")))
    return spark.read.parquet(f"{d}/part.parquet").select(p.alias("way_id"), F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: p * 3 + i).alias("refs"))


_CLASSIFY = f"""c AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {m}, {v})" for k, (m, v) in street.CLASSES.items())}) v(highway, base, kmh)),
w AS (SELECT p_partkey AS way_id, {_HIGHWAYS!r}[p_partkey % 24 + 1] AS highway, CAST([50, 87, 48, 48, NULL, 5, 87, 123, 60, NULL][p_size % 10 + 1] AS BIGINT) AS ms, [NULL, 'yes', '-1', '1'][p_partkey % 4 + 1] AS oneway, [NULL, 'no', 'yes', NULL, NULL][p_partkey % 5 + 1] AS bicycle, p_name FROM part),
k AS (SELECT w.*, coalesce(ms, kmh) AS speed, CASE WHEN w.highway = 'steps' THEN m & 253 ELSE m END AS m2, CASE WHEN w.highway LIKE '%\\_link' ESCAPE '\\' THEN 32 ELSE 0 END | CASE WHEN w.highway = 'steps' THEN 64 ELSE 0 END AS extra
  FROM w JOIN (SELECT * FROM c) c USING (highway), LATERAL (SELECT CASE bicycle WHEN 'no' THEN base & 253 WHEN 'yes' THEN base | 2 ELSE base END AS m)),
f AS (SELECT *, CASE WHEN oneway = '-1' THEN m2 & 252 ELSE m2 END AS fw, CASE WHEN oneway IN ('yes', '1') OR (oneway IS NULL AND highway IN ('motorway', 'motorway_link')) THEN m2 & 252 ELSE m2 END AS bw FROM k WHERE m2 <> 0)"""


@query(f"+ {_CLASSIFY} SELECT way_id, CAST(CASE WHEN fw = 0 THEN 0 ELSE fw | extra END AS BIGINT) AS fwd, CAST(CASE WHEN bw = 0 THEN 0 ELSE bw | extra END AS BIGINT) AS bwd, CAST(speed AS BIGINT) AS speed, p_name AS name FROM f", "dims")
def classify_way(spark: SparkSession, d: str) -> DataFrame:
    return street.classify(_ways(spark, d)).select("way_id", F.col("fwd").cast("long"), F.col("bwd").cast("long"), "speed", "name")


_REFS = "r AS (SELECT p_partkey AS way_id, i AS pos, p_partkey * 3 + i AS node FROM part CROSS JOIN (SELECT unnest(range(5)) AS i)), rn AS (SELECT node FROM r GROUP BY node HAVING count(*) >= 2 OR bool_or(pos IN (0, 4)))"


@query(f"+ {_REFS} SELECT node FROM rn", "dims")
def routing_nodes(spark: SparkSession, d: str) -> DataFrame:
    return street.routing_nodes(_ways(spark, d))


def _way_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/part.parquet").agg(F.max("p_partkey").alias("m")).first().m
    i = F.col("id")
    return spark.range(3 * n + 5).where("id % 97 != 50").select(i.alias("node"), (F.lit(419000000) + F.floor(i / 40) * 30000).cast("long").alias("lat_e7"), (F.lit(125000000) + i % 40 * 30000).cast("long").alias("lon_e7"))


_SEGS = f"""{_REFS}, known AS (SELECT r.*, node % 97 <> 50 AS ok, node IN (SELECT node FROM rn) AS cut FROM r),
pairs AS (SELECT way_id, pos, node, ok, cut, lead(node) OVER w AS nxt, lead(ok) OVER w AS nok, lag(ok) OVER w AS pok FROM known WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
st AS (SELECT way_id, pos, node FROM pairs WHERE ok AND nok AND (cut OR pos = 0 OR NOT pok))"""


@query(f"""+ {_SEGS}, walk AS (SELECT way_id, pos AS start, pos, node, 0 AS seq FROM st UNION ALL SELECT k.way_id, w.start, k.pos, k.node, w.seq + 1 FROM walk w JOIN known p ON p.way_id = w.way_id AND p.pos = w.pos JOIN known k ON k.way_id = w.way_id AND k.pos = w.pos + 1 WHERE k.ok AND (w.seq = 0 OR NOT p.cut))
SELECT way_id, CAST(start AS BIGINT) AS start, CAST(seq AS BIGINT) AS seq, node FROM walk""", "dims", recursive=True)
def way_segments(spark: SparkSession, d: str) -> DataFrame:
    s = street.way_segments(_ways(spark, d), _way_nodes(spark, d))
    first = s.where("seq = 0").select("way_id", "seg", (F.col("node") - F.col("way_id") * 3).alias("start"))
    return s.join(first, ["way_id", "seg"]).select("way_id", "start", "seq", "node")


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return street.graph_edges(street.classify(_ways(spark, d)), _way_nodes(spark, d))


@query(f"""+ {_CLASSIFY.replace("w AS (", "w AS (", 1)}, {_SEGS.replace("r AS (SELECT p_partkey AS way_id, i AS pos, p_partkey * 3 + i AS node FROM part", "r AS (SELECT p_partkey AS way_id, i AS pos, p_partkey * 3 + i AS node FROM (SELECT p_partkey FROM part WHERE p_partkey IN (SELECT way_id FROM f))", 1)},
pt AS (SELECT *, 419000000 + (node // 40) * 30000 AS lat, 125000000 + (node % 40) * 30000 AS lon FROM known),
walk AS (SELECT s.way_id, s.pos AS start, s.pos, s.node, 0 AS seq, CAST(0 AS DOUBLE) AS m FROM st s UNION ALL
  SELECT k.way_id, w.start, k.pos, k.node, w.seq + 1, w.m + sqrt(power((k.lon - p.lon) / 1e7 * cos(radians((k.lat + p.lat) / 2e7)), 2) + power((k.lat - p.lat) / 1e7, 2)) * 111194.9
  FROM walk w JOIN pt p ON p.way_id = w.way_id AND p.pos = w.pos JOIN pt k ON k.way_id = w.way_id AND k.pos = w.pos + 1 WHERE k.ok AND (w.seq = 0 OR NOT p.cut)),
ends AS (SELECT way_id, start, max(seq) AS n FROM walk GROUP BY ALL),
ch AS (SELECT e.way_id, s.node AS a, w.node AS b, greatest(1, CAST(floor(w.m + 0.5) AS BIGINT)) AS meters FROM ends e JOIN walk w ON w.way_id = e.way_id AND w.start = e.start AND w.seq = e.n JOIN walk s ON s.way_id = e.way_id AND s.start = e.start AND s.seq = 0)
SELECT way_id, a AS src, b AS dst, meters, CAST(fw | extra AS BIGINT) AS flags FROM ch JOIN f USING (way_id) WHERE fw <> 0 UNION ALL SELECT way_id, b, a, meters, CAST(bw | extra AS BIGINT) FROM ch JOIN f USING (way_id) WHERE bw <> 0""", "dims", recursive=True)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).select(F.substring_index("pair_id", ":", 1).cast("long").alias("way_id"), "src", "dst", "meters", F.col("flags").cast("long").alias("flags"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    (e,) = fx(spark, d, "g_edges")
    return e.where("edge % 13 != 5").withColumn("pair_id", F.floor(F.col("edge") / 2))


@query("+ e AS (SELECT * FROM g_edges WHERE edge % 13 <> 5) SELECT a.edge, b.edge AS twin FROM e a JOIN e b ON a.edge // 2 = b.edge // 2 AND a.edge <> b.edge", "g_edges")
def edge_twins(spark: SparkSession, d: str) -> DataFrame:
    return street.twins(_pairs(spark, d))


@query("+ e AS (SELECT * FROM g_edges WHERE edge % 13 <> 5) SELECT edge, src, dst FROM e a WHERE src < dst OR NOT EXISTS (SELECT 1 FROM e b WHERE a.edge // 2 = b.edge // 2 AND a.edge <> b.edge)", "g_edges")
def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    return street.canonical(_pairs(spark, d)).select("edge", "src", "dst")


@query("SELECT min(lat_e7) AS min_lat, min(lon_e7) AS min_lon, max(lat_e7) AS max_lat, max(lon_e7) AS max_lon FROM g_nodes", "g_nodes")
def graph_bbox(spark: SparkSession, d: str) -> DataFrame:
    return street.bounding_box(*fx(spark, d, "g_nodes"))


@query("""+ e AS (SELECT src, dst FROM g_edges WHERE src % 5 <> 0 AND dst % 5 <> 0), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
c(node, component) USING KEY (node) AS (SELECT src AS node, src AS component FROM u GROUP BY src UNION SELECT n.node, n.component FROM (SELECT u.dst AS node, min(c.component) AS component FROM c JOIN u ON u.src = c.node GROUP BY u.dst) n JOIN recurring.c o ON o.node = n.node WHERE n.component < o.component)
SELECT node, component FROM c""", "g_edges", recursive=True)
def components(spark: SparkSession, d: str) -> DataFrame:
    e, n = fx(spark, d, "g_edges", "g_nodes")
    return street.components(e.where("src % 5 != 0 AND dst % 5 != 0"), n, street.FOOT)


_CELLS = """ge AS (SELECT e.edge, e.src, e.dst, a.lat_e7 AS alat, a.lon_e7 AS alon, b.lat_e7 AS blat, b.lon_e7 AS blon, greatest(abs(b.lat_e7 - a.lat_e7), abs(b.lon_e7 - a.lon_e7)) // 15000 + 1 AS n FROM g_edges e JOIN g_nodes a ON a.node = e.src JOIN g_nodes b ON b.node = e.dst WHERE e.src < e.dst),
cells AS (SELECT DISTINCT (alat + (blat - alat) * i // n) // 30000 AS cell_y, (alon + (blon - alon) * i // n) // 30000 AS cell_x, edge FROM (SELECT *, unnest(range(n + 1)) AS i FROM ge))"""


@query(f"+ {_CELLS} SELECT cell_y, cell_x, edge FROM cells", "g_edges", "g_nodes")
def grid_index(spark: SparkSession, d: str) -> DataFrame:
    e, n = fx(spark, d, "g_edges", "g_nodes")
    return street.grid_index(e.where("src < dst"), n)


@query("""+ p AS (SELECT stop_idx AS point, lat_e7 + 3000 + stop_idx % 11 * 900 AS lat, lon_e7 + 5000 + stop_idx % 13 * 1100 AS lon FROM stops),
ge AS (SELECT e.edge, a.lat_e7 AS alat, a.lon_e7 AS alon, b.lat_e7 AS blat, b.lon_e7 AS blon FROM g_edges e JOIN g_nodes a ON a.node = e.src JOIN g_nodes b ON b.node = e.dst WHERE e.src < e.dst),
x AS (SELECT point, lat, lon, edge, alat, alon, blat, blon, cos(radians(lat / 1e7)) AS k FROM p JOIN ge ON abs(lat - (alat + blat) / 2) < 90000 AND abs(lon - (alon + blon) / 2) < 120000),
t AS (SELECT *, greatest(0.0, least(1.0, ((lon - alon) * k * (blon - alon) * k + CAST(lat - alat AS DOUBLE) * (blat - alat)) / ((blon - alon) * k * (blon - alon) * k + CAST(blat - alat AS DOUBLE) * (blat - alat)))) AS t FROM x),
q AS (SELECT *, CAST(alat + round(t * (blat - alat)) AS BIGINT) AS qlat, CAST(alon + round(t * (blon - alon)) AS BIGINT) AS qlon FROM t),
r AS (SELECT *, sqrt(power((qlon - lon) / 1e7 * cos(radians((lat + qlat) / 2e7)), 2) + power((qlat - lat) / 1e7, 2)) * 111194.9 AS perp FROM q)
SELECT point, edge, round(perp, 3) AS perp, qlat AS q_lat, qlon AS q_lon FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY perp, edge) AS n FROM r WHERE perp <= 300) WHERE n = 1""", "stops", "g_edges", "g_nodes")
def snap_points(spark: SparkSession, d: str) -> DataFrame:
    s, e, n = fx(spark, d, "stops", "g_edges", "g_nodes")
    i = F.col("stop_idx")
    points = s.select(i.alias("point"), (F.col("lat_e7") + 3000 + i % 11 * 900).alias("lat_e7"), (F.col("lon_e7") + 5000 + i % 13 * 1100).alias("lon_e7"))
    return street.snap(points, e.where("src < dst"), n, street.FOOT).select("point", "edge", F.round("perp", 3).alias("perp"), "q_lat", "q_lon")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 1 THEN 'new ' || p_name ELSE p_name END AS name FROM part WHERE p_partkey % 10 <> 0""", "dims")
def osc_apply(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    ways = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    k = F.col("p_partkey") % 10
    last = p.where(k < 2).select((F.lit(1) + F.col("p_partkey") % 3).alias("seq"), F.col("p_partkey").alias("id"), F.when(k == 0, "delete").otherwise("modify").alias("op"), F.concat(F.lit("new "), "p_name").alias("name"))
    older = last.select((F.col("seq") - 1).alias("seq"), "id", F.lit("modify").alias("op"), F.concat(F.lit("old "), "name").alias("name"))
    return street.apply_changes(ways, last.unionByName(older))


@query("""+ x AS (SELECT way_id, pos, name, lag(name) OVER w AS before, pmod FROM (SELECT pattern AS way_id, pos, CAST(stop_idx % 3 AS VARCHAR) AS name, (pos * 50 + pattern) % 360 AS pmod FROM pattern_stops) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
a AS (SELECT *, CASE WHEN d > 180 THEN d - 360 ELSE d END AS t FROM (SELECT *, (pmod - lag(pmod) OVER (PARTITION BY way_id ORDER BY pos) + 720) % 360 AS d FROM x)),
n AS (SELECT *, sum(CASE WHEN pos = 0 THEN 0 WHEN name <> before OR abs(t) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) AS step FROM a)
SELECT way_id AS route, CAST(step AS BIGINT) AS step, min(name) AS name, CAST(sum(100 + pos) AS BIGINT) AS meters FROM n GROUP BY ALL UNION ALL SELECT way_id, CAST(max(step) + 1 AS BIGINT), '', 0 FROM n GROUP BY way_id""", "pattern_stops")
def turn_steps(spark: SparkSession, d: str) -> DataFrame:
    (p,) = fx(spark, d, "pattern_stops")
    b = ((F.col("pos") * 50 + F.col("pattern")) % 360).cast("double")
    path = p.select(F.col("pattern").alias("route"), "pos", (F.col("stop_idx") % 3).cast("string").alias("name"), F.lit(4).alias("flags"), b.alias("b_in"), b.alias("b_out"), (100 + F.col("pos")).alias("meters"), (F.col("pos") * 9).alias("ds"))
    return street.turn_steps(path).select("route", "step", "name", "meters")


@query("SELECT i AS node, 419000000 + (i // 12) * 45000 AS lat_e7, 125000000 + (i % 12) * 45000 AS lon_e7 FROM (SELECT unnest(range(120)) AS i)", "dims")
def synthetic_grid(spark: SparkSession, d: str) -> DataFrame:
    return street.grid(spark, 10, 12, 419000000, 125000000, 45000)


# --- realtime ------------------------------------------------------------------------------------------------


@query("""SELECT kind, count(*) AS entities, count(*) FILTER (t.trip IS NOT NULL) AS matched, count(*) FILTER (t.trip IS NULL) AS unmatched, max(feed_ts) AS last_ts
FROM (SELECT *, trip * 3 AS key FROM rt_entities) e LEFT JOIN trips t ON t.trip = e.key GROUP BY kind""", "rt_entities", "trips")
def rt_match_stats(spark: SparkSession, d: str) -> DataFrame:
    e, t = fx(spark, d, "rt_entities", "trips")
    return realtime.match_stats(e.withColumn("trip", F.col("trip") * 3), t)


def _updates(spark: SparkSession, d: str) -> DataFrame:
    (e,) = fx(spark, d, "rt_entities")
    null = F.lit(None).cast("long")
    one = e.where("kind IN ('click', 'purchase')").groupBy("trip", "seq").agg(F.min(F.struct("event_id", "kind", "delay")).alias("m")).select("trip", "seq", "m.*")
    click = F.col("kind") == "click"
    return one.select("trip", "seq", null.alias("arr_delay"), F.when(click, F.col("delay")).alias("dep_delay"), F.when(~click, 1_783_641_600 + F.col("delay") * 60).alias("arr_time"), null.alias("dep_time"), F.lit(1_783_641_600).cast("long").alias("base"))


_UPD = """up AS (SELECT trip, seq, arg_min(kind, event_id) AS kind, arg_min(delay, event_id) AS delay FROM rt_entities WHERE kind IN ('click', 'purchase') GROUP BY trip, seq),
dl AS (SELECT u.trip, t.pos, CASE WHEN kind = 'purchase' THEN delay * 60 - t.arr END AS arr_delta, CASE WHEN kind = 'click' THEN delay END AS dep_delta FROM up u JOIN timetable t ON t.trip = u.trip AND t.seq = u.seq)"""


@query(f"+ {_UPD} SELECT trip, pos, arr_delta, dep_delta FROM dl", "rt_entities", "timetable")
def stu_deltas(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable")
    return realtime.stu_deltas(_updates(spark, d), t)


@query(f"""+ {_UPD}, c AS (SELECT t.trip, t.pos, d.arr_delta, coalesce(d.dep_delta, d.arr_delta) AS e, t.trip % 90 AS own FROM timetable t LEFT JOIN dl d ON d.trip = t.trip AND d.pos = t.pos WHERE t.trip IN (SELECT trip FROM dl))
SELECT trip, pos, coalesce(arr_delta, last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), own) AS arr_delta, coalesce(last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), own) AS dep_delta FROM c WINDOW w AS (PARTITION BY trip ORDER BY pos)""", "rt_entities", "timetable")
def rt_propagate(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable")
    return realtime.propagate(realtime.stu_deltas(_updates(spark, d), t).withColumn("trip_delay", F.col("trip") % 90), t)


@query("""+ v AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY event_id DESC) AS n FROM rt_entities WHERE kind = 'view') SELECT v.trip, t.pos, v.status, t.pos - 1 AS passed FROM v JOIN timetable t ON t.trip = v.trip AND t.seq = v.seq WHERE n = 1""", "rt_entities", "timetable")
def rt_vehicles(spark: SparkSession, d: str) -> DataFrame:
    e, t = fx(spark, d, "rt_entities", "timetable")
    return realtime.vehicles(e.where("kind = 'view'"), t)


@query("""+ f AS (SELECT *, accuracy <= 30 AS ok FROM gps_fixes), g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY "at", event_id) AS island FROM f)
SELECT session_id, min("at") AS since, max("at") AS until, count(*) AS fixes FROM g WHERE ok GROUP BY session_id, island HAVING max("at") - min("at") >= 20""", "gps_fixes")
def hold_persistence(spark: SparkSession, d: str) -> DataFrame:
    (f,) = fx(spark, d, "gps_fixes")
    return realtime.hold_persistence(f, F.col("accuracy") <= 30, 20)


# --- itineraries ---------------------------------------------------------------------------------------------

_ITS = "its AS (SELECT o_orderkey AS itinerary, o_custkey % 100 AS query_id, 't' || CAST(o_orderkey % 7 AS VARCHAR) AS sig, 30000 + o_orderkey * 17 % 900 AS arrive, o_orderkey % 4 AS transfers, o_orderkey * 31 % 4000 AS duration, ['walk', 'bike_walk', 'walk_bike', 'bike'][o_orderkey % 4 + 1] AS variant FROM orders)"


def _itineraries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    variant = F.element_at(F.array(*map(F.lit, ("walk", "bike_walk", "walk_bike", "bike"))), (k % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("itinerary"), (F.col("o_custkey") % 100).alias("query_id"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("sig"), (30000 + k * 17 % 900).alias("arrive"),
        (k % 4).alias("transfers"), (k * 31 % 4000).alias("duration"), variant.alias("variant"),
    )


@query(f"""+ {_ITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, sig ORDER BY arrive, transfers, itinerary) AS n FROM its),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arrive, transfers, itinerary) AS rank FROM o WHERE n = 1) SELECT query_id, itinerary, rank FROM r WHERE rank <= 4""", "dims")
def topk_itineraries(spark: SparkSession, d: str) -> DataFrame:
    return itineraries.top_itineraries(_itineraries(spark, d)).select("query_id", "itinerary", "rank")


@query(f"""+ {_ITS}, b AS (SELECT query_id, min(arrive) AS best FROM its WHERE variant = 'walk' GROUP BY query_id) SELECT query_id, itinerary, variant FROM its LEFT JOIN b USING (query_id)
WHERE variant = 'walk' OR (variant IN ('bike_walk', 'walk_bike') AND (best IS NULL OR arrive + 300 <= best)) OR (variant = 'bike' AND duration <= 2700 AND (best IS NULL OR arrive <= best + 600))""", "dims")
def bike_transit_gate(spark: SparkSession, d: str) -> DataFrame:
    return itineraries.bike_gate(_itineraries(spark, d)).select("query_id", "itinerary", "variant")


_LEGS = "lg AS (SELECT l_orderkey % 500 AS query_id, l_orderkey AS itinerary, l_linenumber AS leg, CASE WHEN l_linenumber % 3 = 0 THEN 'foot' ELSE 'transit' END AS mode, CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 3 END AS route_type, l_suppkey % 3 <> 0 AS realtime, l_linenumber * 900 + l_partkey % 600 AS dep FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))"


@query(f"""+ {_LEGS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, itinerary ORDER BY leg) AS n, realtime OR route_type = 1 AS el FROM lg WHERE mode = 'transit'),
j AS (SELECT query_id, itinerary, bool_and(CASE WHEN n = 1 THEN el AND dep <= 2700 ELSE el OR dep > 3600 END) AS live FROM r GROUP BY ALL) SELECT DISTINCT l.query_id, l.itinerary, coalesce(j.live, TRUE) AS live FROM lg l LEFT JOIN j ON j.query_id = l.query_id AND j.itinerary = l.itinerary""", "dims")
def live_rule(spark: SparkSession, d: str) -> DataFrame:
    l = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber")
    legs = l.select(
        (F.col("l_orderkey") % 500).alias("query_id"), F.col("l_orderkey").alias("itinerary"), n.alias("leg"), F.when(n % 3 == 0, "foot").otherwise("transit").alias("mode"),
        F.when(F.col("p") % 4 == 0, 1).otherwise(3).alias("route_type"), (F.col("s") % 3 != 0).alias("realtime"), (n * 900 + F.col("p") % 600).alias("dep"), F.lit(0).cast("long").alias("asked"),
    )
    return itineraries.live(legs)


@query("""+ n AS (SELECT o_custkey AS session_id, o_orderkey AS leg, 't' || CAST(o_orderkey % 11 AS VARCHAR) AS sig FROM orders WHERE o_orderkey % 2 = 0), o AS (SELECT o_custkey AS session_id, 't' || CAST(o_orderkey % 11 AS VARCHAR) AS sig FROM orders WHERE o_orderkey % 2 = 1)
SELECT session_id, leg, sig FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = n.session_id AND o.sig = n.sig)""", "dims")
def changed_legs(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("leg"), F.concat(F.lit("t"), (F.col("o_orderkey") % 11).cast("string")).alias("sig"))
    return itineraries.changed_legs(o.where("leg % 2 = 1"), o.where("leg % 2 = 0")).select("session_id", "leg", "sig")


@query()
def polyline_encode(spark: SparkSession, d: str) -> DataFrame:
    """Shapes as polyline text; the points of one shape are one string."""
    (s,) = fx(spark, d, "shapes")
    g = s.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("idx", geo.e7_to_e5(F.col("lat_e7")).alias("lat"), geo.e7_to_e5(F.col("lon_e7")).alias("lon")))).alias("points"))

    @F.pandas_udf("string")
    def encode(points: pd.Series) -> pd.Series:
        return points.map(lambda ps: geo.encode_polyline((int(p["lat"]), int(p["lon"])) for p in ps))

    return g.select("shape_id", encode(F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))).alias("polyline"))
