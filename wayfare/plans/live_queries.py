"""Queries of the rules of live journeys, and the SQL that answers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import itineraries, live, realtime, timetable
from .queries import _DAY, _ITS, _LEGS, _NET, _PARETO, _day, _itineraries, _raptor, _rounds, fx, query

ZONE, SUMMER, NOW = "Europe/Rome", 7200, 1_784_000_000


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))


_O = "o AS (SELECT o_orderkey AS o, o_custkey AS c FROM orders)"
_MIDNIGHT = f"((%s + {SUMMER}) // 86400) * 86400 - {SUMMER}"


@query(f"""+ {_O} SELECT o, CASE o % 4 WHEN 0 THEN CAST(epoch(TIMESTAMP '2026-01-15') AS BIGINT) - 3600 WHEN 1 THEN CAST(epoch(TIMESTAMP '2026-07-15') AS BIGINT) - 7200 ELSE {_MIDNIGHT % f'({NOW} + o * 97)'} END AS base FROM o""", "dims")
def service_base(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    date = F.when(o % 4 == 0, "20260115").when(o % 4 == 1, "20260715").when(o % 4 == 2, "20261399")
    return _orders(spark, d).select("o", live.service_base(date, F.lit(NOW) + o * 97, ZONE).alias("base"))


@query(f"""+ {_O}, x AS (SELECT o, {NOW} + o * 97 AS dep, (o * 37) % 100000 AS sched, {_MIDNIGHT % f'({NOW} + o * 97)'} AS mid FROM o),
y AS (SELECT o, unnest([struct_pack(off := abs(mid + sched - dep), ord := 0, base := mid), struct_pack(off := abs(mid - 86400 + sched - dep), ord := 1, base := mid - 86400), struct_pack(off := abs(mid + 86400 + sched - dep), ord := 2, base := mid + 86400)]) AS s FROM x)
SELECT o, arg_min(s.base, s.off * 3 + s.ord) AS base FROM y GROUP BY o""", "dims")
def ride_base(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    return _orders(spark, d).select("o", live.ride_base(F.lit(NOW) + o * 97, (o * 37) % 100000, ZONE).alias("base"))


@query("""SELECT a.stop_idx AS leg, CASE WHEN a.stop_idx % 3 = 0 THEN 't|x' || a.stop_idx % 5 || '|' || a.stop_id || '|' || b.stop_id
ELSE 'walk|' || printf('%.4f,%.4f', a.lat_e7 / 1e7, a.lon_e7 / 1e7) || '|' || printf('%.4f,%.4f', b.lat_e7 / 1e7, b.lon_e7 / 1e7) END AS sig FROM stops a JOIN stops b ON b.stop_idx = (a.stop_idx * 7 + 3) % (SELECT n_stops FROM dims)""", "stops", "dims")
def leg_signature(spark: SparkSession, d: str) -> DataFrame:
    s, dims = fx(spark, d, "stops", "dims")
    b = s.select(F.col("stop_idx").alias("b"), F.col("stop_id").alias("b_id"), F.col("lat_e7").alias("y"), F.col("lon_e7").alias("x"))
    j = s.crossJoin(F.broadcast(dims)).withColumn("b", (F.col("stop_idx") * 7 + 3) % F.col("n_stops")).join(b, "b")
    deg = lambda c: F.col(c) / F.lit(1e7)
    mode = F.when(F.col("stop_idx") % 3 == 0, "transit").otherwise("walk")
    trip = F.concat(F.lit("x"), (F.col("stop_idx") % 5).cast("string"))
    return j.select(F.col("stop_idx").alias("leg"), live.signature(mode, trip, F.col("stop_id"), F.col("b_id"), deg("lat_e7"), deg("lon_e7"), deg("y"), deg("x")).alias("sig"))


@query(f"""+ {_O}, x AS (SELECT o, o % 3 = 0 AS ride, 1000 + o % 50 AS dep, 1000 + o % 50 + o % 4 * 100 AS arr, 1000 + o * 7 % 500 AS now, CAST(10 AS DOUBLE) AS a, CAST(11 + o % 6 AS DOUBLE) AS b FROM o)
SELECT o, round(CASE WHEN ride OR arr <= dep OR now <= dep THEN a WHEN now >= arr THEN b ELSE a + (b - a) * ((now - dep) / (arr - dep)) END, 6) AS lat FROM x""", "dims")
def virtual_point(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    dep, num = 1000 + o % 50, lambda c: c.cast("double")
    mode = F.when(o % 3 == 0, "transit").otherwise("walk")
    return _orders(spark, d).select("o", F.round(live.virtual_point(mode, dep, dep + o % 4 * 100, 1000 + o * 7 % 500, num(F.lit(10)), num(11 + o % 6)), 6).alias("lat"))


_RIDE_LEGS = "lg AS (SELECT a.trip AS leg, a.trip, a.stop_idx AS from_stop, b.stop_idx AS to_stop FROM timetable a JOIN timetable b ON b.trip = a.trip AND b.pos = (a.pos + 3) % 8 WHERE a.pos = a.trip % 7)"


@query(f"""+ {_RIDE_LEGS}, on_ AS (SELECT l.leg, l.trip, l.to_stop, min(t.pos) AS board FROM lg l JOIN timetable t ON t.trip = l.trip AND t.stop_idx = l.from_stop GROUP BY ALL)
SELECT o.leg, o.trip, o.board, min(t.pos) AS alight FROM on_ o JOIN timetable t ON t.trip = o.trip AND t.stop_idx = o.to_stop AND t.pos > o.board GROUP BY ALL""", "timetable")
def resolve_rides(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "timetable")
    a = t.where(F.col("pos") == F.col("trip") % 7).select("trip", F.col("stop_idx").alias("from_stop"), ((F.col("pos") + 3) % 8).alias("pos"))
    legs = a.join(t.select("trip", "pos", F.col("stop_idx").alias("to_stop")), ["trip", "pos"]).select(F.col("trip").alias("leg"), "trip", "from_stop", "to_stop")
    return live.resolve_rides(legs, t.select("trip", "pos", F.col("stop_idx").alias("stop")))


@query(f"+ {_LEGS} SELECT query_id, itinerary, CAST(coalesce(sum(dep % 500) FILTER (mode <> 'transit'), 0) AS BIGINT) AS walk FROM lg GROUP BY ALL", "dims")
def walk_seconds(spark: SparkSession, d: str) -> DataFrame:
    return live.walk_seconds(_legs(spark, d).withColumn("duration", F.col("dep") % 500))


def _legs(spark: SparkSession, d: str) -> DataFrame:
    l = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber")
    return l.select(
        (F.col("l_orderkey") % 500).alias("query_id"), F.col("l_orderkey").alias("itinerary"), n.alias("leg"), F.when(n % 3 == 0, "foot").otherwise("transit").alias("mode"),
        F.when(F.col("p") % 4 == 0, 1).otherwise(3).alias("route_type"), (F.col("s") % 3 != 0).alias("realtime"), (n * 900 + F.col("p") % 600).alias("dep"),
    )


@query("""+ f AS (SELECT event_id, session_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE "at" END AS sent, "at" + event_id * 13 % 100 - 45 AS received, lat_e7, lon_e7, accuracy FROM gps_fixes),
g AS (SELECT event_id, session_id, CASE WHEN sent IS NULL OR sent > received + 30 THEN received ELSE sent END AS t FROM f WHERE accuracy <= 150 AND event_id % 23 <> 0 AND received - CASE WHEN sent IS NULL OR sent > received + 30 THEN received ELSE sent END <= 45)
SELECT event_id, session_id, t AS "at" FROM (SELECT *, max(t) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM g) WHERE l IS NULL OR t >= l""", "gps_fixes")
def fix_plausibility(spark: SparkSession, d: str) -> DataFrame:
    (f,) = fx(spark, d, "gps_fixes")
    e = F.col("event_id")
    f = f.withColumn("received", F.col("at") + e * 13 % 100 - 45).withColumn("at", F.when(e % 17 != 0, F.col("at")))
    for c in ("lat_e7", "lon_e7"):
        f = f.withColumn(c, F.when(e % 23 != 0, F.col(c)).otherwise(F.lit(0).cast("long")))
    return live.plausible(f).select("event_id", "session_id", "at")


@query("""+ v AS (SELECT trip, seq // 10 - 1 AS pos, status, row_number() OVER (PARTITION BY trip ORDER BY event_id DESC) AS n FROM rt_entities WHERE kind = 'view')
SELECT v.trip, v.pos, v.status, CASE WHEN v.trip % 2 = 0 THEN s.lat_e7 ELSE 410000000 END AS lat_e7, CASE WHEN v.trip % 2 = 0 THEN s.lon_e7 ELSE 120000000 END AS lon_e7
FROM v LEFT JOIN timetable t ON t.trip = v.trip AND t.pos = v.pos LEFT JOIN stops s ON s.stop_idx = t.stop_idx WHERE n = 1 AND (v.trip % 2 = 1 OR s.stop_idx IS NOT NULL)""", "rt_entities", "timetable", "stops")
def vehicle_place(spark: SparkSession, d: str) -> DataFrame:
    e, t, s = fx(spark, d, "rt_entities", "timetable", "stops")
    v = realtime.last_of(e.where("kind = 'view'"), "event_id")
    odd = F.col("trip") % 2 == 1
    v = v.select("trip", (F.floor(F.col("seq") / 10) - 1).cast("long").alias("pos"), "status", F.when(odd, F.lit(410000000).cast("long")).alias("lat_e7"), F.when(odd, F.lit(120000000).cast("long")).alias("lon_e7"))
    return live.vehicle_place(v, t.join(s.select("stop_idx", "lat_e7", "lon_e7"), "stop_idx"))


_STATES = """st AS (SELECT c AS session_id, o AS "at", CAST(o % 3 + k AS BIGINT) AS leg, o % 9 AS trip, o % 4 = 0 AS boarded, CAST(o % 5 AS BIGINT) AS board, CAST(o % 5 + 3 AS BIGINT) AS alight, CASE WHEN o % 7 <> 0 THEN CAST(o % 2 + 3 AS BIGINT) END AS pos,
  o % 4 AS status, 419000000 + o % 2 * 1000 AS lat_e7, 125000000 AS lon_e7, o % 2 * 30 AS delay FROM o CROSS JOIN (VALUES (0), (1)) v(k))"""


@query(f"""+ {_O}, {_STATES}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, "at" ORDER BY leg) AS n FROM st) WHERE n = 1 AND pos IS NOT NULL),
e AS (SELECT session_id, "at", leg, trip, boarded, CASE status WHEN 0 THEN 'incoming_at' WHEN 1 THEN 'stopped_at' WHEN 2 THEN 'in_transit_to' ELSE 'unknown' END AS status, greatest(CASE WHEN boarded THEN alight ELSE board END - pos, 0) AS stops_away, lat_e7, lon_e7, delay FROM f)
SELECT * EXCLUDE (seen, last) FROM (SELECT *, lag(seen) OVER (PARTITION BY session_id ORDER BY "at") AS last FROM (SELECT *, concat_ws('|', boarded, status, stops_away, lat_e7, lon_e7, delay) AS seen FROM e)) WHERE last IS NULL OR last <> seen""", "dims")
def vehicle_events(spark: SparkSession, d: str) -> DataFrame:
    o, long = F.col("o"), lambda c: c.cast("long")
    s = _orders(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("c").alias("session_id"), o.alias("at"), long(o % 3 + F.col("k")).alias("leg"), (o % 9).alias("trip"), (o % 4 == 0).alias("boarded"), (o % 5).alias("board"), (o % 5 + 3).alias("alight"),
        F.when(o % 7 != 0, o % 2 + 3).alias("pos"), (o % 4).alias("status"), (419000000 + o % 2 * 1000).alias("lat_e7"), long(F.lit(125000000)).alias("lon_e7"), (o % 2 * 30).alias("delay"),
    )
    return live.vehicle_events(s)


_FIXES = """fx AS (SELECT session_id, event_id % 3 AS leg, "at", event_id, event_id % 3 <> 1 AS riding, CASE WHEN "at" // 3000 % 3 = 0 THEN 5 WHEN "at" // 3000 % 3 = 1 THEN 4 ELSE 2 END AS passed, 4 AS alight, accuracy,
  CAST("at" // 20000 % 3 * 150 AS DOUBLE) AS to_vehicle, CAST("at" // 7000 % 4 * 60 AS DOUBLE) AS to_stop, CAST("at" // 50000 % 3 * 250 AS DOUBLE) AS to_route FROM gps_fixes)"""


def _sql_held(rows: str, condition: str, seconds: int, also: str = "TRUE") -> str:
    return f"""SELECT session_id, leg, min("at") AS "at" FROM (SELECT *, min("at") OVER (PARTITION BY session_id, leg, island) AS since FROM (SELECT *, sum(CASE WHEN {condition} THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, leg ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS island FROM fx WHERE {rows}) WHERE {condition})
  WHERE "at" - since >= {seconds} AND {also} GROUP BY session_id, leg"""


@query(f"""+ {_FIXES}, m AS (SELECT session_id, leg, min("at") AS "at" FROM (SELECT session_id, leg, "at" FROM fx WHERE riding AND to_vehicle <= 85 + least(accuracy, 60) AND passed > alight
  UNION ALL {_sql_held('riding', 'to_vehicle <= 85 + least(accuracy, 60) AND passed >= alight', 45)}) GROUP BY ALL),
l AS ({_sql_held('riding AND passed >= 0 AND passed < alight', 'to_vehicle >= 160 + least(accuracy, 60)', 35, 'to_stop > 40 + least(accuracy, 60)')}),
f AS ({_sql_held('NOT riding', 'to_route > 300 + least(accuracy, 60)', 90)})
SELECT session_id, leg, "at", 'missed_alight' AS kind FROM m UNION ALL SELECT session_id, leg, "at", 'left_vehicle_early' FROM l UNION ALL SELECT session_id, leg, "at", 'off_route' FROM f""", "gps_fixes")
def track_deviations(spark: SparkSession, d: str) -> DataFrame:
    (f,) = fx(spark, d, "gps_fixes")
    e, step = F.col("event_id"), lambda n: F.floor(F.col("at") / n)
    third = step(3000) % 3
    riding = e % 3 != 1
    f = f.select(
        "session_id", (e % 3).alias("leg"), "at", "event_id", F.when(riding, "transit").otherwise("walk").alias("mode"), riding.alias("boarded"), F.when(third == 0, 5).when(third == 1, 4).otherwise(2).alias("passed"),
        F.lit(4).alias("alight"), "accuracy", (step(20000) % 3 * 150).cast("double").alias("to_vehicle"), (step(7000) % 4 * 60).cast("double").alias("to_stop"), (step(50000) % 3 * 250).cast("double").alias("to_route"),
    )
    return live.deviations(f)


_AHEAD = f"""ah AS (SELECT query_id, itinerary AS session_id, leg, mode, route_type, realtime AS has_rt, itinerary % 5 = 0 AND leg = 1 AS boarded, itinerary % 3 <> 0 AS fresh, itinerary % 7 = 0 AS live_mode, 3000 AS now, dep + 1200 AS depart, dep AS terminus_dep FROM lg)"""


def _ahead(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("itinerary")
    return _legs(spark, d).select(
        i.alias("session_id"), "leg", "mode", "route_type", F.col("realtime").alias("has_rt"), ((i % 5 == 0) & (F.col("leg") == 1)).alias("boarded"), (i % 3 != 0).alias("fresh"), (i % 7 == 0).alias("live_mode"),
        F.lit(3000).alias("now"), (F.col("dep") + 1200).alias("depart"), F.col("dep").alias("terminus_dep"),
    )


@query(f"""+ {_LEGS}, {_AHEAD}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY leg) AS n FROM ah WHERE mode = 'transit' AND NOT boarded AND route_type <> 1 AND NOT has_rt AND fresh)
SELECT session_id, leg, CASE WHEN now > terminus_dep + 180 THEN 'possibly_cancelled' ELSE 'no_rt_signal' END AS kind FROM o WHERE n = 1 AND (now > terminus_dep + 180 OR depart - now <= 600)""", "dims")
def schedule_guard(spark: SparkSession, d: str) -> DataFrame:
    return live.schedule_guard(_ahead(spark, d))


@query(f"""+ {_LEGS}, {_AHEAD} SELECT session_id, bool_or(live_mode) OR coalesce(arg_min(route_type = 1 OR has_rt, leg) FILTER (mode = 'transit'), FALSE) AS allowed FROM ah GROUP BY session_id""", "dims")
def reroute_allowed(spark: SparkSession, d: str) -> DataFrame:
    return live.reroute_allowed(_ahead(spark, d))


@query(f"""+ {_O} SELECT o AS session_id, CASE WHEN o % 4 <> 0 AND o * 7 % 90 <= 45 THEN 1.5 ELSE 2.5 END AS lat, CASE WHEN o % 4 <> 0 AND o * 7 % 90 <= 45 THEN 3.5 ELSE 4.5 END AS lon, CASE WHEN o % 3 = 0 THEN 5000 ELSE 4000 + o END AS arrive FROM o""", "dims")
def replan_points(spark: SparkSession, d: str) -> DataFrame:
    o, half = F.col("o"), lambda n: F.lit(n + 0.5)
    s = _orders(spark, d).select(
        o.alias("session_id"), F.lit(1000).alias("now"), F.when(o % 4 != 0, 1000 - o * 7 % 90).alias("fix_at"), half(1).alias("fix_lat"), half(3).alias("fix_lon"), half(2).alias("plan_lat"), half(4).alias("plan_lon"),
        F.when(o % 3 != 0, 4000 + o).alias("told_arrive"), F.lit(5000).cast("long").alias("plan_arrive"),
    )
    return live.replan_points(s)


@query(f"""+ {_O}, x AS (SELECT o, 1000 AS now, CASE WHEN o % 3 <> 0 THEN 1000 - o % 400 END AS last, CASE WHEN o % 5 <> 0 THEN 850 + o * 11 % 500 END AS dep, 9000 AS arrive, 8000 + o * 17 % 1200 AS offer FROM o)
SELECT o AS session_id, arrive - offer AS saves FROM x WHERE arrive - offer >= 300 AND (last IS NULL OR now - last >= 180) AND (dep IS NULL OR NOT (dep - now <= 180 AND dep > now - 60))""", "dims")
def better_arrival(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    s = _orders(spark, d).select(o.alias("session_id"), F.lit(1000).alias("now"), F.when(o % 3 != 0, 1000 - o % 400).alias("last_change"), F.when(o % 5 != 0, 850 + o * 11 % 500).alias("next_depart"), F.lit(9000).alias("arrive"), (8000 + o * 17 % 1200).alias("offer"))
    return live.better_arrival(s)


@query(f"""+ {_ITS}, t AS (SELECT *, 'it_' || substr(sha256('|10000|' || query_id || '|' || itinerary), 1, 16) AS token FROM its) SELECT itinerary, token FROM t WHERE itinerary % 3000 <= 1800""", "dims")
def itinerary_tokens(spark: SparkSession, d: str) -> DataFrame:
    cache = live.tokens(_itineraries(spark, d).select("query_id", "itinerary"), 10_000)
    asked = cache.select("token", (F.col("created") + F.col("itinerary") % 3000).alias("now"))
    return live.look_up(cache, asked).select("itinerary", "token")


@query("""SELECT 's' || event_id % 3 AS source, kind, count(*) AS entities, count(*) FILTER (t.trip IS NOT NULL) AS matched, count(*) FILTER (t.trip IS NULL) AS unmatched, count(*) FILTER (t.trip IS NOT NULL AND event_id % 5 = 0) AS cancelled, max(feed_ts) AS last_ts,
(SELECT max(feed_ts) FROM rt_entities) + 298 - max(feed_ts) <= 300 AS fresh FROM (SELECT *, trip * 3 AS key FROM rt_entities) e LEFT JOIN trips t ON t.trip = e.key GROUP BY ALL""", "rt_entities", "trips")
def rt_feed_status(spark: SparkSession, d: str) -> DataFrame:
    e, t = fx(spark, d, "rt_entities", "trips")
    now = e.agg(F.max("feed_ts")).first()[0] + 298
    k = F.col("event_id")
    return live.feed_status(e.select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), "kind", (F.col("trip") * 3).alias("trip"), (k % 5 == 0).alias("cancelled"), "feed_ts"), t, now)


@query("SELECT coalesce((SELECT arg_min(n_name, n_nationkey) FROM nation WHERE n_nationkey % 4 = 3), 'UTC') AS zone", "dims")
def network_zone(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    return live.network_zone(n.select(k.alias("ord"), F.when(k % 4 == 3, F.col("n_name")).when(k % 4 == 1, "").alias("zone")))


@query("""SELECT feed, n, text, "of" FROM (SELECT o_custkey % 20 AS feed, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS n, o_orderpriority AS text, count(*) OVER (PARTITION BY o_custkey % 20) AS "of" FROM orders) WHERE n <= 50""", "dims")
def first_warnings(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return live.first_warnings(o.select((F.col("o_custkey") % 20).alias("feed"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("text")))


_ORDERED = f"""{_ITS}, x AS (SELECT query_id, itinerary, CASE WHEN itinerary % 3 = 0 THEN 0 WHEN itinerary % 3 = 1 THEN 1 ELSE 2 END AS class, arrive, duration AS walk, row_number() OVER (PARTITION BY query_id ORDER BY itinerary) AS n FROM its)"""


@query(f"""+ {_ORDERED}, f(query_id, itinerary, class, arrive, walk, n) AS (SELECT * FROM x WHERE n = 1 UNION ALL
  SELECT x.query_id, CASE WHEN w THEN x.itinerary ELSE y.itinerary END, CASE WHEN w THEN x.class ELSE y.class END, CASE WHEN w THEN x.arrive ELSE y.arrive END, CASE WHEN w THEN x.walk ELSE y.walk END, x.n
  FROM (SELECT f.*, x.itinerary AS i2, CASE WHEN x.class <> f.class THEN x.class < f.class WHEN abs(x.arrive - f.arrive) > 60 THEN x.arrive < f.arrive ELSE x.walk < f.walk END AS w FROM f JOIN x ON x.query_id = f.query_id AND x.n = f.n + 1) y JOIN x ON x.query_id = y.query_id AND x.itinerary = y.i2)
SELECT query_id, arg_max(itinerary, n) AS itinerary FROM f GROUP BY query_id""", "dims", recursive=True)
def pick_best(spark: SparkSession, d: str) -> DataFrame:
    i = _itineraries(spark, d).withColumn("class", (F.col("itinerary") % 3).cast("int")).withColumnRenamed("duration", "walk")
    return itineraries.pick_best(i).select("query_id", "itinerary")


@query("""+ u AS (SELECT trip, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN seq END AS seq, CASE WHEN event_id % 2 = 1 THEN user_stop END AS stop FROM (SELECT e.*, t.stop_idx AS user_stop FROM rt_entities e JOIN timetable t ON t.trip = e.trip AND t.pos = e.event_id % 8)),
w AS (SELECT trip, min(ord) AS ord FROM u GROUP BY trip), o AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY ord) AS n FROM u),
m(trip, n, ord, pos, cur) AS (SELECT trip, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM w UNION ALL
  SELECT trip, n, ord, pos, coalesce(pos + 1, cur) FROM (SELECT o.trip, o.n, o.ord, m.cur, coalesce((SELECT min(t.pos) FROM timetable t WHERE t.trip = o.trip AND t.seq = o.seq), (SELECT min(t.pos) FROM timetable t WHERE t.trip = o.trip AND t.stop_idx = o.stop AND t.pos >= m.cur)) AS pos FROM m JOIN o ON o.trip = m.trip AND o.n = m.n + 1))
SELECT trip, ord, pos FROM m WHERE pos IS NOT NULL""", "rt_entities", "timetable", recursive=True)
def rt_match_by_stop(spark: SparkSession, d: str) -> DataFrame:
    e, t = fx(spark, d, "rt_entities", "timetable")
    k = F.col("event_id")
    at = t.select("trip", F.col("pos").alias("p"), F.col("stop_idx"))
    u = e.join(at, "trip").where(F.col("p") == k % 8).select("trip", k.alias("ord"), F.when(k % 2 == 0, F.col("seq")).alias("seq"), F.when(k % 2 == 1, F.col("stop_idx")).alias("stop_idx"))
    return realtime.match_by_stop(u, t)


@query("""+ sk AS (SELECT DISTINCT trip, seq // 10 - 1 AS pos FROM rt_entities WHERE kind = 'signup') SELECT t.trip, t.pos, CASE WHEN sk.trip IS NULL THEN t.arr ELSE -2147483648 END AS arr, CASE WHEN sk.trip IS NULL THEN t.dep ELSE -2147483648 END AS dep FROM timetable t LEFT JOIN sk ON sk.trip = t.trip AND sk.pos = t.pos""", "rt_entities", "timetable")
def skipped_stops(spark: SparkSession, d: str) -> DataFrame:
    e, t = fx(spark, d, "rt_entities", "timetable")
    skip = e.where("kind = 'signup'").select("trip", (F.floor(F.col("seq") / 10) - 1).cast("long").alias("pos"), F.lit(True).alias("skipped")).distinct()
    return timetable.without_skipped(t, skip).select("trip", "pos", "arr", "dep")


@query(f"+ {_ITS} SELECT query_id, itinerary FROM its WHERE itinerary % 3 = 0", "dims")
def live_subset(spark: SparkSession, d: str) -> DataFrame:
    return itineraries.live_subset(_itineraries(spark, d).withColumn("live", F.col("itinerary") % 3 == 0))[0].select("query_id", "itinerary")


@query("SELECT stop_idx, name, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, CAST(floor(lat_e7 / 7.0) AS BIGINT) AS distance_m, (lon_e7 % 1000) // 10 AS duration_s FROM stops", "stops")
def display_places(spark: SparkSession, d: str) -> DataFrame:
    (s,) = fx(spark, d, "stops")
    s = s.withColumn("meters", F.col("lat_e7") / 7.0).withColumn("ds", F.col("lon_e7") % 1000)
    return s.select("stop_idx", "name", *itineraries.place(F.col("lat_e7"), F.col("lon_e7")), *itineraries.step_display(F.col("meters"), F.col("ds")))


BASE = 1_783_641_600
_OVER = f"""u AS (SELECT trip, seq, event_id % 2 AS msg, min(event_id) AS ord, arg_min(kind, event_id) AS kind, arg_min(delay, event_id) AS delay FROM rt_entities WHERE kind IN ('click', 'purchase', 'signup') GROUP BY ALL),
can AS (SELECT DISTINCT trip FROM rt_entities WHERE kind = 'error'),
fst AS (SELECT trip, min(msg) AS msg FROM u WHERE trip NOT IN (SELECT trip FROM can) GROUP BY trip),
lv AS (SELECT u.trip, t.pos, t.arr AS s_arr, t.dep AS s_dep, u.kind, u.delay FROM u JOIN fst ON fst.trip = u.trip AND fst.msg = u.msg JOIN timetable t ON t.trip = u.trip AND t.seq = u.seq),
ca AS (SELECT t.trip, t.pos, CASE WHEN kind = 'purchase' THEN delay * 60 - t.arr END AS arr_delta, CASE WHEN kind = 'click' THEN delay WHEN kind = 'purchase' THEN delay * 60 - t.arr END AS e, t.trip % 90 AS own, lv.kind, {BASE} + delay * 60 AS event_time, t.dep FROM timetable t LEFT JOIN lv ON lv.trip = t.trip AND lv.pos = t.pos WHERE t.trip IN (SELECT trip FROM fst)),
sp AS (SELECT *, coalesce(arr_delta, last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), own) AS a, coalesce(last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), own) AS d FROM ca WINDOW w AS (PARTITION BY trip ORDER BY pos)),
gone AS (SELECT trip, max(pos) AS by_time FROM sp WHERE kind IS NOT NULL AND CASE WHEN kind = 'purchase' THEN event_time ELSE {BASE} + dep + d END <= {BASE + 43200} GROUP BY trip),
veh AS (SELECT v.trip, t.pos, v.status FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY event_id DESC) AS n FROM rt_entities WHERE kind = 'view') v JOIN timetable t ON t.trip = v.trip AND t.seq = v.seq WHERE n = 1)"""


def _overlay(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, t = fx(spark, d, "rt_entities", "timetable")
    null, k = F.lit(None).cast("long"), F.col("event_id")
    one = e.where("kind IN ('click', 'purchase', 'signup')").groupBy("trip", "seq", (k % 2).alias("msg")).agg(F.min(F.struct("event_id", "kind", "delay")).alias("m")).select("trip", "seq", "msg", "m.*")
    is_ = lambda kind: F.col("kind") == kind
    ups = one.select(
        "trip", "msg", k.alias("ord"), "seq", null.alias("stop_idx"), F.lit(False).alias("cancelled"), is_("signup").alias("skipped"), (F.col("trip") % 90).alias("trip_delay"), null.alias("arr_delay"),
        F.when(is_("click"), F.col("delay")).alias("dep_delay"), F.when(is_("purchase"), BASE + F.col("delay") * 60).alias("arr_time"), null.alias("dep_time"), F.lit(BASE).cast("long").alias("base"),
    )
    gone = e.where("kind = 'error'").select("trip", F.lit(9).cast("long").alias("msg"), k.alias("ord"), F.lit(True).alias("cancelled"))
    return realtime.overlay(ups.unionByName(gone, allowMissingColumns=True), realtime.vehicles(e.where("kind = 'view'"), t), t, BASE + 43_200)


@query(f"""+ {_OVER}, al AS (SELECT trip, FALSE AS cancelled FROM fst UNION ALL SELECT trip, TRUE FROM can)
SELECT coalesce(al.trip, veh.trip) AS trip, coalesce(al.cancelled, FALSE) AS cancelled, greatest(coalesce(gone.by_time, -1), coalesce(veh.pos - 1, -1)) AS passed, veh.pos AS veh_pos, veh.status FROM al FULL JOIN veh ON veh.trip = al.trip LEFT JOIN gone ON gone.trip = coalesce(al.trip, veh.trip)""", "rt_entities", "timetable")
def rt_overlay(spark: SparkSession, d: str) -> DataFrame:
    return _overlay(spark, d)[0]


@query(f"+ {_OVER} SELECT trip, pos, a AS arr_delta, d AS dep_delta, coalesce(kind = 'signup', FALSE) AS skipped FROM sp", "rt_entities", "timetable")
def rt_overlay_stops(spark: SparkSession, d: str) -> DataFrame:
    return _overlay(spark, d)[1]


@query(f"+ {_DAY}, {_rounds(5)}, pf AS ({_PARETO}) SELECT query_id, rides, arr, TRUE AS chained, TRUE AS runs, arr - dep_sec AS longest FROM pf JOIN requests USING (query_id)", *_NET)
def raptor_legs(spark: SparkSession, d: str) -> DataFrame:
    """Journeys whose legs are followed through the timetable: every ride runs as told, and legs join with their slack."""
    (r,) = fx(spark, d, "requests")
    day = _day(spark, d)
    j = _raptor(spark, d).join(r, "query_id")
    l = j.select("query_id", "rides", F.col("arr").alias("total"), "source", "target", "dep_sec", "egress_sec", F.posexplode("legs").alias("n", "l"))
    on = day.select(F.col("trip").alias("t"), F.col("pos").alias("p"), F.col("stop_idx").alias("s"), F.col("dep").alias("d"), F.lit(True).alias("on"))
    off = day.select(F.col("trip").alias("t"), F.col("pos").alias("p"), F.col("stop_idx").alias("s"), F.col("arr").alias("a"), F.lit(True).alias("off"))
    key = lambda x, pos, stop, time, col: (F.col("l.trip") == x["t"]) & (F.col(f"l.{pos}") == x["p"]) & (F.col(f"l.{stop}") == x["s"]) & (F.col(f"l.{time}") == x[col])
    l = l.join(on, key(on, "board_pos", "from_stop", "dep", "d"), "left").drop("t", "p", "s", "d").join(off, key(off, "alight_pos", "to_stop", "arr", "a"), "left").drop("t", "p", "s", "a")
    by = Window.partitionBy("query_id", "rides").orderBy("n")
    before = F.lag("l").over(by)
    wait = F.when((F.col("l.kind") == "ride") & (before["kind"] == "ride"), 90).otherwise(0)
    joins = F.when(before.isNull(), (F.col("l.from_stop") == F.col("source")) & (F.col("l.dep") >= F.col("dep_sec"))).otherwise((before["to_stop"] == F.col("l.from_stop")) & (F.col("l.dep") >= before["arr"] + wait))
    ends = F.when(F.lead("l").over(by).isNull(), (F.col("l.to_stop") == F.col("target")) & (F.col("l.arr") + F.col("egress_sec") == F.col("total"))).otherwise(True)
    l = l.withColumn("joined", joins & ends).withColumn("ran", (F.col("l.kind") == "foot") | (F.col("on") & F.col("off")))
    whole = l.groupBy("query_id", "rides").agg(F.first("total").alias("arr"), F.bool_and(F.coalesce("joined", F.lit(False))).alias("chained"), F.bool_and(F.coalesce("ran", F.lit(False))).alias("runs"), F.max(F.col("total") - F.col("dep_sec")).alias("longest"))
    return whole.select("query_id", "rides", "arr", "chained", "runs", "longest")


_ONE = f"{_DAY}, {_rounds(5)}, pf AS ({_PARETO})"


@query(f"+ {_ONE} SELECT query_id, rides, arr AS arrive, rides - 1 AS transfers FROM pf", *_NET)
def assemble_itineraries(spark: SparkSession, d: str) -> DataFrame:
    (r,) = fx(spark, d, "requests")
    asked = r.select("query_id", "dep_sec", F.lit(0).cast("long").alias("access_sec"), "egress_sec")
    return itineraries.assemble(_raptor(spark, d), asked).select("query_id", "rides", "arrive", "transfers")


@query(f"""+ {_OVER}, lg AS (SELECT trip, trip % 4 AS board_pos, trip % 4 + 3 AS alight_pos FROM trips) SELECT lg.trip, b.d AS dep_delay, a.a AS arr_delay, b.d IS NOT NULL OR a.a IS NOT NULL AS realtime FROM lg LEFT JOIN sp b ON b.trip = lg.trip AND b.pos = board_pos LEFT JOIN sp a ON a.trip = lg.trip AND a.pos = alight_pos""", "rt_entities", "timetable", "trips")
def leg_delays(spark: SparkSession, d: str) -> DataFrame:
    (t,) = fx(spark, d, "trips")
    legs = t.select("trip", (F.col("trip") % 4).alias("board_pos"), (F.col("trip") % 4 + 3).alias("alight_pos"))
    return itineraries.leg_delays(legs, _overlay(spark, d)[1]).select("trip", "dep_delay", "arr_delay", "realtime")
