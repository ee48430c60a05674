"""Queries of street paths, anchors and footpaths, and the SQL that answers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import paths, street
from .queries import _spread, fx, query

WALK = street.speed_factor(4.8)
_FOOT = f"CAST(floor(%s) AS BIGINT) * {WALK} >> 16"


def _dist(a: str, b: str) -> str:
    return f"sqrt(power(({b}lon - {a}lon) / 1e7 * cos(radians(({a}lat + {b}lat) / 2e7)), 2) + power(({b}lat - {a}lat) / 1e7, 2)) * 111194.9"


def _snaps(points: str, radius: int) -> str:
    """SQL: snaps(point, edge, src, dst, perp, along_u, along_v) of ``points`` (point, lat, lon), on foot."""
    return f"""p AS ({points}),
ge AS (SELECT e.edge, e.src, e.dst, a.lat_e7 AS alat, a.lon_e7 AS alon, b.lat_e7 AS blat, b.lon_e7 AS blon FROM g_edges e JOIN g_nodes a ON a.node = e.src JOIN g_nodes b ON b.node = e.dst WHERE e.src < e.dst AND e.flags & 4 <> 0),
sx AS (SELECT point, lat, lon, edge, src, dst, alat, alon, blat, blon, cos(radians(lat / 1e7)) AS k FROM p JOIN ge ON abs(lat - (alat + blat) / 2) < 90000 AND abs(lon - (alon + blon) / 2) < 120000),
st AS (SELECT *, greatest(0.0, least(1.0, ((lon - alon) * k * (blon - alon) * k + CAST(lat - alat AS DOUBLE) * (blat - alat)) / ((blon - alon) * k * (blon - alon) * k + CAST(blat - alat AS DOUBLE) * (blat - alat)))) AS t FROM sx),
sq AS (SELECT *, CAST(alat + round(t * (blat - alat)) AS BIGINT) AS qlat, CAST(alon + round(t * (blon - alon)) AS BIGINT) AS qlon FROM st),
sr AS (SELECT point, edge, src, dst, {_dist('', 'q')} AS perp, {_dist('a', 'q')} AS along_u, {_dist('q', 'b')} AS along_v FROM sq),
snaps AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY perp, edge) AS n FROM sr WHERE perp <= {radius}) WHERE n = 1)"""


_STOP_POINTS = "SELECT stop_idx AS point, lat_e7 + 3000 + stop_idx % 11 * 900 AS lat, lon_e7 + 5000 + stop_idx % 13 * 1100 AS lon FROM stops"


def _seeds(snaps: str, leaving: bool) -> str:
    """SQL: point, node, ds on foot; an even edge's twin is the next one."""
    far, near = (("dst", "along_v"), ("src", "along_u")) if leaving else (("src", "along_u"), ("dst", "along_v"))
    one = lambda node, along, edge: f"SELECT s.point, s.{node} AS node, {_FOOT % f's.{along} + s.perp'} AS ds FROM {snaps} s JOIN g_edges e ON e.edge = {edge} WHERE e.flags & 4 <> 0"
    return f"SELECT point, node, min(ds) AS ds FROM ({one(*far, 's.edge')} UNION ALL {one(*near, 's.edge + 1')}) GROUP BY ALL"


def _twins(e: DataFrame) -> DataFrame:
    return e.select("edge", F.col("edge").bitwiseXOR(F.lit(1)).alias("twin"))


def _stop_points(s: DataFrame) -> DataFrame:
    i = F.col("stop_idx")
    return s.select("stop_idx", (F.col("lat_e7") + 3000 + i % 11 * 900).alias("lat_e7"), (F.col("lon_e7") + 5000 + i % 13 * 1100).alias("lon_e7"))


@query(f"SELECT edge, CAST(floor(floor(meters * CAST(0.37 AS DOUBLE) * 36) / speed) AS BIGINT) AS car_ds, {_FOOT % 'meters * CAST(0.37 AS DOUBLE)'} AS foot_ds, least(meters * 300, 65535) AS clamped FROM g_edges", "g_edges")
def partial_cost(spark: SparkSession, d: str) -> DataFrame:
    (e,) = fx(spark, d, "g_edges")
    part = F.col("meters") * 0.37
    return e.select("edge", paths.partial_cost(part, F.col("speed"), "car").alias("car_ds"), paths.partial_cost(part, F.col("speed"), "foot", WALK).alias("foot_ds"), paths.clamped(F.col("meters") * 300).alias("clamped"))


@query(f"+ {_snaps(_STOP_POINTS, 300)}, o AS ({_seeds('snaps', True)}), i AS ({_seeds('snaps', False)}) SELECT point, node, ds, TRUE AS leaving FROM o UNION ALL SELECT point, node, ds, FALSE FROM i", "stops", "g_edges", "g_nodes")
def snap_seeds(spark: SparkSession, d: str) -> DataFrame:
    s, e, n = fx(spark, d, "stops", "g_edges", "g_nodes")
    snaps = street.snap(_stop_points(s).withColumnRenamed("stop_idx", "point"), e.where("src < dst"), n, street.FOOT)
    one = lambda leaving: paths.seeds(snaps, e, _twins(e), street.FOOT, "foot", WALK, leaving).withColumn("leaving", F.lit(leaving))
    return one(True).union(one(False))


_WAYS = "SELECT s_suppkey AS request, s_suppkey * 37 % (w * w) AS a, (s_suppkey * 131 + 77) % (w * w) AS b FROM supplier CROSS JOIN dims"
_LABELS = f"ways AS ({_WAYS}), {_spread('SELECT request AS origin, a AS node, CAST(0 AS BIGINT) AS ds FROM ways', 1 << 40)}"
#: The least edge of all that end a cheapest way, and the walk back along them.
_PATH = f"""{_LABELS}, fe AS (SELECT edge, src, dst, greatest(1, (meters * {WALK}) >> 16) AS cost FROM g_edges WHERE flags & 4 <> 0),
pred AS (SELECT m.origin, m.node, m.ds, min(fe.edge) AS edge, arg_min(fe.src, fe.edge) AS before FROM s l JOIN fe ON fe.src = l.node JOIN s m ON m.origin = l.origin AND m.node = fe.dst AND m.ds = l.ds + fe.cost WHERE m.ds > 0 GROUP BY ALL),
back(request, node, edge, ds) AS (SELECT w.request, p.before, p.edge, p.ds FROM ways w JOIN pred p ON p.origin = w.request AND p.node = w.b
  UNION ALL SELECT k.request, p.before, p.edge, p.ds FROM back k JOIN pred p ON p.origin = k.request AND p.node = k.node),
path AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY ds) - 1 AS pos, edge FROM back)"""


def _ways(spark: SparkSession, d: str) -> DataFrame:
    (dims,) = fx(spark, d, "dims")
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{d}/supplier.parquet").crossJoin(F.broadcast(dims))  # dims has one row
    return s.select(k.alias("request"), (k * 37 % (F.col("w") * F.col("w"))).alias("a"), ((k * 131 + 77) % (F.col("w") * F.col("w"))).alias("b"))


def _foot(spark: SparkSession, d: str) -> DataFrame:
    (e,) = fx(spark, d, "g_edges")
    return e.where("flags & 4 != 0").select("edge", "src", "dst", street.edge_cost(F.col("meters"), F.col("speed"), "foot", WALK).alias("cost"))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w, zero = _ways(spark, d), F.lit(0).cast("long").alias("ds")
    starts = w.select("request", F.col("a").alias("node"), zero)
    found, labels = paths.routes(_foot(spark, d), starts, w.select("request", F.col("b").alias("node"), zero))
    return found, labels, starts


@query(f"+ {_LABELS} SELECT request, ds FROM ways JOIN s ON s.origin = request AND s.node = b", "g_edges", "dims", recursive=True)
def street_routes(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[0].select("request", "ds")


def _path(spark: SparkSession, d: str) -> DataFrame:
    found, labels, starts = _found(spark, d)
    return paths.path_edges(paths.predecessors(labels, _foot(spark, d), starts), found)


@query(f"+ {_PATH} SELECT request, pos, edge FROM path", "g_edges", "dims", recursive=True)
def path_edges(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d)


@query(f"+ {_PATH}, whole AS (SELECT p.*, count(*) OVER (PARTITION BY request) AS n FROM path p) SELECT request, n - 1 - pos AS pos, CASE WHEN edge % 2 = 0 THEN edge + 1 ELSE edge - 1 END AS edge FROM whole", "g_edges", "dims", recursive=True)
def reverse_path(spark: SparkSession, d: str) -> DataFrame:
    (e,) = fx(spark, d, "g_edges")
    return paths.reverse_path(_path(spark, d), _twins(e))


@query(f"+ {_PATH}, pts AS (SELECT request, pos, dst AS node FROM path JOIN g_edges USING (edge) UNION ALL SELECT request, -1, src FROM path JOIN g_edges USING (edge) WHERE pos = 0) SELECT request, string_agg(lat_e7 || ' ' || lon_e7, ',' ORDER BY pos) AS points FROM pts JOIN g_nodes USING (node) GROUP BY request", "g_edges", "g_nodes", "dims", recursive=True)
def path_geometry(spark: SparkSession, d: str) -> DataFrame:
    e, n = fx(spark, d, "g_edges", "g_nodes")
    at = lambda k, name: n.select(F.col("node").alias(k), F.struct("lat_e7", "lon_e7").alias(name))
    geometry = e.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("edge", F.array("a", "b").alias("pts"))
    g = paths.path_geometry(_path(spark, d), geometry)
    return g.select("request", F.array_join(F.transform("pts", lambda p: F.concat_ws(" ", p["lat_e7"].cast("string"), p["lon_e7"].cast("string"))), ",").alias("points"))


_ENDS = """SELECT request * 2 AS point, lat_e7 + 1000 + request % 7 * 500 AS lat, lon_e7 + 900 + request % 5 * 700 AS lon FROM ways JOIN g_nodes ON node = a
UNION ALL SELECT request * 2 + 1, lat_e7 - 800 - request % 6 * 400, lon_e7 - 1100 - request % 8 * 300 FROM ways JOIN g_nodes ON node = b"""


@query(f"""+ ways AS ({_WAYS}), {_snaps(_ENDS, 300)}, s0 AS (SELECT * REPLACE (point // 2 AS point) FROM snaps WHERE point % 2 = 0), s1 AS (SELECT * REPLACE (point // 2 AS point) FROM snaps WHERE point % 2 = 1),
first AS ({_seeds('s0', True)}), last AS ({_seeds('s1', False)}), {_spread('SELECT point AS origin, node, ds FROM first WHERE point IN (SELECT point FROM last)', 1 << 40)},
total AS (SELECT origin, min(s.ds + l.ds) AS ds FROM s JOIN last l ON l.point = s.origin AND l.node = s.node GROUP BY origin)
SELECT origin AS request, ds // 10 AS duration_s FROM total""", "g_edges", "g_nodes", "dims", recursive=True)
def road_legs(spark: SparkSession, d: str) -> DataFrame:
    return _road_legs(spark, d)[0].select("request", "duration_s")


def _road_legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, n = fx(spark, d, "g_edges", "g_nodes")
    r = F.col("request")
    w = _ways(spark, d).join(n.withColumnRenamed("node", "a"), "a").select("request", "b", (F.col("lat_e7") + 1000 + r % 7 * 500).alias("lat_e7"), (F.col("lon_e7") + 900 + r % 5 * 700).alias("lon_e7"))
    w = w.join(n.select(F.col("node").alias("b"), F.col("lat_e7").alias("y"), F.col("lon_e7").alias("x")), "b")
    w = w.select("request", "lat_e7", "lon_e7", (F.col("y") - 800 - r % 6 * 400).alias("to_lat_e7"), (F.col("x") - 1100 - r % 8 * 300).alias("to_lon_e7"))
    return paths.road_legs(w, e, n, _twins(e), street.FOOT, "foot", WALK)


_ANCHORS = f"""anchors AS (SELECT node, stop, min(extra) AS extra FROM (SELECT src AS node, point AS stop, least(65535, {_FOOT % 'perp + along_u'}) AS extra FROM snaps UNION ALL SELECT dst, point, least(65535, {_FOOT % 'perp + along_v'}) FROM snaps) GROUP BY ALL)"""


@query(f"+ {_snaps(_STOP_POINTS, 250)}, {_ANCHORS} SELECT node, stop, extra FROM anchors", "stops", "g_edges", "g_nodes")
def stop_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    s, e, n = fx(spark, d, "stops", "g_edges", "g_nodes")
    return paths.stop_anchors(_stop_points(s), e, n, _twins(e), WALK)


_REACH = (400 * WALK) >> 16


@query(f"+ {_snaps(_STOP_POINTS, 250)}, {_ANCHORS}, {_spread('SELECT stop AS origin, node, extra AS ds FROM anchors WHERE extra <= ' + str(_REACH), _REACH)} SELECT s.origin AS from_stop, a.stop AS to_stop, min(s.ds + a.extra) AS ds FROM s JOIN anchors a ON a.node = s.node WHERE a.stop <> s.origin AND s.ds + a.extra <= {_REACH} GROUP BY ALL", "stops", "g_edges", "g_nodes", recursive=True)
def transfers(spark: SparkSession, d: str) -> DataFrame:
    return paths.stop_transfers(_anchors(spark, d), _foot(spark, d), WALK)


@query(f"""+ n AS (SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY idx) AS i, lat_e7 AS lat, lon_e7 AS lon FROM shapes),
gap AS (SELECT b.shape_id, b.i, {_dist('a.', 'b.')} AS d FROM n a JOIN n b ON b.shape_id = a.shape_id AND b.i = a.i + 1),
c(shape_id, i, start, meters, cut) AS (SELECT shape_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS DOUBLE), FALSE FROM n WHERE i = 1 UNION ALL
  SELECT g.shape_id, g.i, CASE WHEN c.meters + g.d > 1500 AND g.i - 1 > c.start THEN g.i - 1 ELSE c.start END, CASE WHEN c.meters + g.d > 1500 AND g.i - 1 > c.start THEN 0 ELSE c.meters END + g.d, FALSE FROM c JOIN gap g ON g.shape_id = c.shape_id AND g.i = c.i + 1)
SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY start) - 1 AS part, count(*) + 1 AS points FROM c WHERE i > 1 GROUP BY shape_id, start""", "shapes", recursive=True)
def split_chains(spark: SparkSession, d: str) -> DataFrame:
    (s,) = fx(spark, d, "shapes")
    g = s.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat_e7", "lon_e7"))).alias("pts"))
    return g.select("shape_id", F.posexplode(street.split_chain(F.col("pts"), 1500.0)).alias("part", "p")).select("shape_id", F.col("part").cast("long").alias("part"), F.size("p").cast("long").alias("points"))


@query("SELECT a.stop_idx AS a, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS m FROM (SELECT a.stop_idx, power(sin(radians((b.lat_e7 - a.lat_e7) / 1e7) / 2), 2) + cos(radians(a.lat_e7 / 1e7)) * cos(radians(b.lat_e7 / 1e7)) * power(sin(radians((b.lon_e7 - a.lon_e7) / 1e7) / 2), 2) AS h FROM stops a JOIN stops b ON b.stop_idx = (a.stop_idx * 7 + 3) % (SELECT n_stops FROM dims)) a", "stops", "dims")
def track_dist(spark: SparkSession, d: str) -> DataFrame:
    s, dims = fx(spark, d, "stops", "dims")
    b = s.select(F.col("stop_idx").alias("b"), F.col("lat_e7").alias("y"), F.col("lon_e7").alias("x"))
    j = s.crossJoin(F.broadcast(dims)).withColumn("b", (F.col("stop_idx") * 7 + 3) % F.col("n_stops")).join(b, "b")
    deg = lambda c: F.col(c) / F.lit(1e7)
    return j.select(F.col("stop_idx").alias("a"), F.round(geo.haversine_degrees(deg("lat_e7"), deg("lon_e7"), deg("y"), deg("x")), 3).alias("m"))
