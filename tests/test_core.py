"""Published cases, known vectors and random networks against independent Python."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfare import config
from wayfare.functions import geo, parse
from wayfare.operators import itineraries, paths, realtime, routing, street, timetable
from wayfare.sources import gtfs_rt, gtfs_zip, osm_change, osm_pbf
from wayfare.store import Snapshots


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    r = one(
        spark,
        geo.haversine(lit(419009000), lit(125013000), lit(418902000), lit(124922000)).alias("h"), geo.distance(lit(419009000), lit(125013000), lit(418902000), lit(124922000)).alias("d"),
        parse.gtfs_time(lit("25:01:00")).alias("t"), parse.gtfs_time(lit("7:61:00")).alias("bad"), parse.degrees_e7(lit("41.12345678")).alias("e"), parse.degrees_e7(lit("-181")).alias("far"),
        parse.day(lit("20260710")).alias("day"), parse.day(lit("bad")).alias("noday"), parse.sequence_path(lit(3901)).alias("p"), geo.e7_to_e5(lit(-419000050)).alias("e5"),
    )
    assert 1350 < r.h < 1500 and abs(r.h - r.d) < 2
    assert (r.t, r.bad, r.e, r.far, r.day, r.noday, r.p, r.e5) == (90060, None, 411234568, None, 20260710, None, "000/003/901", -4190001)


def test_polyline():
    points = [(3850000, -12020000), (4070000, -12095000), (4325200, -12645300)]
    assert geo.encode_polyline(points) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert geo.decode_polyline(geo.encode_polyline(points)) == points


def raptor_case(spark, source, at, target, egress, date=20260710, previous=20260709):
    rows = []
    for pattern, stops, first, every, n, night in ((0, [0, 1, 2], 25200, 900, 20, False), (1, [3, 4], 25500, 1200, 15, False), (2, [0, 5], 88200, 0, 1, True)):
        for t in range(n):
            for pos, stop in enumerate(stops):
                time = first + every * t + pos * (1200 if night else 600)
                rows.append((1000 * pattern + t, pattern, t, pos, stop, time, time, "1" if night else "0"))
    t = spark.createDataFrame(rows, "trip long, pattern long, trip_rank long, pos long, stop_idx long, arr long, dep long, service string")
    services = spark.createDataFrame([("0", 31, 20260101, 20261231), ("1", 31, 20260101, 20261231)], "service string, mask long, start_date long, end_date long")
    none = spark.createDataFrame([], "service string, date long, kind string")
    dates = spark.createDataFrame([(date,), (previous,)], "date long")
    active = timetable.active_services(services, none, dates)
    day = routing.layers(t, active, spark.createDataFrame([(date, previous)], "date long, previous long"))
    transfers = spark.createDataFrame([(1, 3, 1800), (3, 1, 1800)], "from_stop long, to_stop long, ds long")
    sources = spark.createDataFrame([(1, date, source, at)], "query_id long, date long, stop long, arr long")
    targets = spark.createDataFrame([(1, target, egress)], "query_id long, stop long, egress long")
    ride = routing.rides(day)
    return routing.pareto(routing.raptor(sources, targets, routing.boards(ride), ride, transfers, 4, 60)).collect()


@pytest.mark.parametrize(
    ("case", "arr", "rides", "legs"),
    [((0, 25320, 2, 60), 27360, 1, ["ride"]), ((0, 25200, 4, 0), 27300, 2, ["ride", "foot", "ride"]), ((0, 600, 5, 0), 3000, 1, ["ride"])],
)
def test_journeys(spark, case, arr, rides, legs):
    (j,) = raptor_case(spark, *case)
    assert (j.arr, j.rides, [x.kind for x in j.legs]) == (arr, rides, legs)


def test_no_journey_on_a_weekend(spark):
    assert raptor_case(spark, 0, 43200, 2, 0, 20260711, 20260711) == []


def test_interpolation_is_a_fold(spark):
    rows = [(1, i, i, i, a, a) for i, a in enumerate([0, None, None, None, 10, None])] + [(2, 0, 0, 0, None, None), (2, 1, 1, 1, 7, 9), (3, 0, 0, 0, None, None)]
    got = timetable.interpolate(spark.createDataFrame(rows, "trip long, pos long, seq long, stop_idx long, arr long, dep long")).orderBy("trip", "pos").collect()
    assert [(r.arr, r.dep) for r in got] == [(0, 0), (2, 2), (4, 4), (7, 7), (10, 10), (10, 10), (7, 7), (7, 9), (0, 0)]


def test_street_net(spark):
    ids = {100 + i: (i // 3 * 45000, i % 3 * 45000) for i in range(9)} | {900 + k: (-30000 - (8000 if k == 1 else 0), 15000 * k) for k in range(4)}
    nodes = spark.createDataFrame([(k, a, b) for k, (a, b) in ids.items()], "node long, lat_e7 long, lon_e7 long")
    ways = [(i, [100 + 3 * i + k for k in range(3)], 7, 7) for i in range(3)] + [(3 + i, [100 + i + 3 * k for k in range(3)], 7, 7) for i in range(3)]
    ways += [(6, [100, 104], 7, 4), (7, [900, 901, 902, 903], 4, 4)]
    w = spark.createDataFrame([(i, r, f, b, 30, "Via") for i, r, f, b in ways], "way_id long, refs array<long>, fwd int, bwd int, speed long, name string")
    e = street.graph_edges(w, nodes)
    assert e.where("src = 100 AND dst = 104").first().flags == 7 and e.where("src = 104 AND dst = 100").first().flags == 4
    curve = e.where("src = 900").first()
    back = e.where("src = 903").first()
    assert len(curve.pts) == 4 and [p.node for p in curve.pts] == [p.node for p in back.pts][::-1]
    cost = e.where("flags & 4 != 0").select("src", "dst", street.edge_cost(F.col("meters"), F.col("speed"), "foot", street.speed_factor(4.8)).alias("cost"))
    reached = routing.near_search(cost, spark.createDataFrame([(100, 100, 0)], "origin long, node long, ds long"), 60000)
    assert reached.count() == 9


def test_searches_agree_with_dijkstra(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 50)) for _ in range(240)]
    df = spark.createDataFrame(edges, "src long, dst long, cost long")
    best = {0: 0}
    for _ in range(60):
        for a, b, c in edges:
            if a in best and best[a] + c < best.get(b, 10**9):
                best[b] = best[a] + c
    got = {r.node: r.ds for r in routing.near_search(df, spark.createDataFrame([(1, 0, 0)], "origin long, node long, ds long"), 10**6).collect()}
    assert got == best
    whole = df.withColumn("edge", F.monotonically_increasing_id())
    starts = spark.createDataFrame([(n, 0, 0) for n in range(60)], "request long, node long, ds long")
    ends = spark.createDataFrame([(n, n, 0) for n in range(60)], "request long, node long, ds long")
    found, labels = paths.routes(whole, starts, ends, 20)
    assert {r.request: r.ds for r in found.collect()} == best
    cost = {r.edge: (r.src, r.dst, r.cost) for r in whole.collect()}
    steps = {}
    for r in paths.path_edges(paths.predecessors(labels, whole, starts), found).orderBy("request", "pos").collect():
        steps.setdefault(r.request, []).append(cost[r.edge])
    for n, way in steps.items():
        assert way[0][0] == 0 and way[-1][1] == n and sum(c for _, _, c in way) == best[n]
        assert all(a[1] == b[0] for a, b in zip(way, way[1:]))
    assert set(steps) == set(best) - {0}


def test_pick_best_is_in_order(spark):
    rows = [(1, 0, 2, 100, 50), (1, 1, 0, 500, 90), (1, 2, 0, 460, 95), (1, 3, 0, 430, 10), (2, 0, 1, 10, 5)]
    got = {r.query_id: r.itinerary for r in itineraries.pick_best(spark.createDataFrame(rows, "query_id long, itinerary long, class int, arrive long, walk long")).collect()}
    assert got == {1: 3, 2: 0}


def test_updates_without_sequence_follow_the_cursor(spark):
    calls = spark.createDataFrame([(1, p, 10 * (p + 1), s) for p, s in enumerate([5, 6, 5, 7])], "trip long, pos long, seq long, stop_idx long")
    ups = spark.createDataFrame([(1, 0, 10, None), (1, 1, None, 5), (1, 2, None, 99), (1, 3, None, 7)], "trip long, ord long, seq long, stop_idx long")
    assert [(r.ord, r.pos) for r in realtime.match_by_stop(ups, calls).orderBy("ord").collect()] == [(0, 0), (1, 2), (3, 3)]


def test_overlay(spark):
    t = spark.createDataFrame([(k, p, 10 * (p + 1), 50 + p, 1000 * k + 100 * p, 1000 * k + 100 * p) for k in (1, 2, 3, 4) for p in range(3)], "trip long, pos long, seq long, stop_idx long, arr long, dep long")
    schema = "trip long, msg long, ord long, seq long, stop_idx long, cancelled boolean, skipped boolean, trip_delay long, arr_delay long, dep_delay long, arr_time long, dep_time long, base long"
    rows = [
        (1, 0, 0, 10, None, False, False, None, None, 120, None, None, 0),
        (1, 5, 9, 20, None, False, False, None, None, 900, None, None, 0),  # a later message: the first one counts
        (2, 1, 1, 10, None, True, False, None, None, None, None, None, 0),
        (3, 2, 2, 20, None, False, True, 30, None, None, None, None, 0),
        (4, 3, 3, None, 51, False, False, None, 60, None, None, None, 0),  # by stop alone
    ]
    vehicle = realtime.vehicles(spark.createDataFrame([(3, 20, 2, 1, 419000000, 125000000), (4, None, 1, 2, 1, 2)], "trip long, seq long, status long, event_id long, lat_e7 long, lon_e7 long"), t)
    trips, stops = realtime.overlay(spark.createDataFrame(rows, schema), vehicle, t, 1130)
    got = {r.trip: (r.cancelled, r.passed, r.veh_pos, r.lat_e7) for r in trips.collect()}
    assert got == {1: (False, 0, None, None), 2: (True, -1, None, None), 3: (False, 0, 1, 419000000), 4: (False, -1, None, 1)}
    assert {(r.trip, r.pos): (r.arr_delta, r.dep_delta, r.skipped) for r in stops.collect()} == {
        (1, 0): (0, 120, False), (1, 1): (120, 120, False), (1, 2): (120, 120, False), (3, 0): (30, 30, False), (3, 1): (30, 30, True), (3, 2): (30, 30, False),
        (4, 0): (0, 0, False), (4, 1): (60, 60, False), (4, 2): (60, 60, False),
    }


def test_skipped_stops_are_neither_boarded_nor_left_at(spark):
    t = spark.createDataFrame([(1, 0, 0, p, 50 + p, 100 * p, 100 * p + 10, "s") for p in range(4)], "trip long, pattern long, trip_rank long, pos long, stop_idx long, arr long, dep long, service string")
    skip = spark.createDataFrame([(1, 0, True), (1, 2, True), (1, 3, False)], "trip long, pos long, skipped boolean")
    active = spark.createDataFrame([(20260710, "s")], "date long, service string")
    dates = spark.createDataFrame([(20260710, 20260709)], "date long, previous long")
    ride = routing.rides(routing.layers(timetable.without_skipped(t, skip), active, dates)).cache()
    ask = lambda a, b: routing.raptor(spark.createDataFrame([(1, 20260710, a, 0)], "query_id long, date long, stop long, arr long"), spark.createDataFrame([(1, b, 0)], "query_id long, stop long, egress long"), routing.boards(ride), ride, spark.createDataFrame([], "from_stop long, to_stop long, ds long"), 0).collect()
    assert [len(ask(a, b)) for a, b in ((50, 53), (51, 52), (51, 53))] == [0, 0, 1]


def test_long_chains_are_split(spark):
    ways = spark.createDataFrame([(1, 7, 7, 30, "long", [1, 2, 3, 4])], "way_id long, fwd long, bwd long, speed long, name string, refs array<long>")
    nodes = spark.createDataFrame([(n, 419000000, 125000000 + n * 4000000) for n in range(1, 5)], "node long, lat_e7 long, lon_e7 long")
    edges = street.graph_edges(ways, nodes).collect()
    assert len(edges) == 6 and max(e.meters for e in edges) < 65000


def test_realtime_bytes(spark, tmp_path):
    raw = gtfs_rt.encode(77, [{"trip_id": "a", "start_date": "20260710", "delay": -5, "stops": [{"seq": 1, "dep_delay": -120}, {"stop_id": "x", "arr_time": 9, "skipped": True}]}, {"trip_id": "b", "cancelled": True}], [{"trip_id": "a", "lat": 41.5, "lon": 12.25, "seq": 2, "status": 1}])
    (tmp_path / "feed.pb").write_bytes(raw)
    rows = gtfs_rt.decode_files(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("ord").collect()
    assert [(r.kind, r.trip_id, r.cancelled, r.seq, r.stop_id, r.skipped, r.arr_time, r.dep_delay, r.trip_delay) for r in rows[:2]] == [("trip", "a", False, 1, None, False, None, -120, -5), ("trip", "a", False, None, "x", True, 9, None, -5)]
    assert rows[2].cancelled and rows[2].trip_id == "b" and (rows[3].lat, rows[3].lon, rows[3].status, rows[3].feed_ts) == (41.5, 12.25, 1, 77)


def test_extract(spark, tmp_path):
    raw = osm_pbf.write([(1, 419000000, 125000000), (3, -419000001, -5), (9, 7, 0)], [(5, [1, 3, 9], {"highway": "path", "name": "Via é"})], (1, 2, 3, 4), 3901)
    (tmp_path / "x.pbf").write_bytes(raw)
    assert sorted(map(tuple, osm_pbf.read(spark, str(tmp_path), "nodes").collect())) == [(1, 419000000, 125000000), (3, -419000001, -5), (9, 7, 0)]
    (way,) = osm_pbf.read(spark, str(tmp_path), "ways").collect()
    assert (way.way_id, way.refs, way.tags) == (5, [1, 3, 9], {"highway": "path", "name": "Via é"})
    assert osm_pbf.read_header(raw) == {"min_lat": 1, "min_lon": 2, "max_lat": 3, "max_lon": 4, "seq": 3901}


def test_change_and_state(spark, tmp_path):
    (tmp_path / "c.osc").write_text('<osmChange><modify><node id="5" lat="41.9" lon="12.5"/></modify><delete><way id="7"/></delete><create><way id="8"><nd ref="5"/><nd ref="6"/><tag k="highway" v="residential"/></way></create></osmChange>')
    got = {(r.kind, r.op, r.id): (r.lat_e7, r.refs, r.tags) for r in osm_change.read(spark, str(tmp_path / "c.osc")).collect()}
    assert got[("node", "modify", 5)][0] == 419000000 and got[("way", "modify", 8)][1:] == ([5, 6], {"highway": "residential"}) and ("way", "delete", 7) in got
    assert osm_change.state("#x\ntimestamp=2026-07-10T00\\:00\\:00Z\nsequenceNumber=3901\n") == {"seq": 3901, "timestamp": "2026-07-10T00:00:00Z"}
    with pytest.raises(ValueError):
        osm_change.state("timestamp=1")


def test_feed_zip(spark, tmp_path):
    files = {
        "stops": "﻿stop_id,stop_name,stop_lat,stop_lon,location_type\r\na,\"x,\"\"y\",41.5,12.5,\r\nb,B,41.6,12.6,0\r\na,again,1,1,0\r\ns,Station,41,12,1\r\nc,C,bad,12,\r\n",
        "routes": "route_id,route_short_name,route_type\nr,R,3\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nw,1,1,1,1,1,0,0,20260101,20261231\n",
        "calendar_dates": "service_id,date,exception_type\nw,20260710,2\nx,20260711,1\n",
        "trips": "route_id,service_id,trip_id\nr,w,t1\nr,nope,t2\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,08:00:00,,a,1\nt1,,,c,2\nt1,08:10:00,08:11:00,b,3\nt9,08:00:00,08:00:00,a,1\n",
    }
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for name, text in files.items():
            z.writestr(f"feed/{name}.txt", text)
    path = str(tmp_path / "f.zip")
    assert [(r.stop_id, r.name, r.lat_e7, r.ok) for r in gtfs_zip.stops(spark, path).orderBy("stop_id").collect()] == [("a", 'x,"y', 415000000, True), ("b", "B", 416000000, True), ("c", "C", 0, False)]
    assert [r.trip_id for r in gtfs_zip.trips(spark, path).collect()] == ["t1"]
    assert [(r.pos, r.seq, r.stop_id, r.arr, r.dep) for r in gtfs_zip.stop_times(spark, path).orderBy("pos").collect()] == [(0, 1, "a", 28800, 28800), (1, 2, "c", 29100, 29100), (2, 3, "b", 29400, 29460)]
    services, exceptions = gtfs_zip.services(spark, path)
    dates = spark.createDataFrame([(20260709,), (20260710,), (20260711,)], "date long")
    assert sorted((r.date, r.service) for r in timetable.active_services(services, exceptions, dates).collect()) == [(20260709, "w"), (20260711, "x")]


def test_config():
    text = 'osm_url = "x.pbf"\nrt_poll = "30s"\n[search]\nmax_transfers = 3\n[[feed]]\nname = "a"\nurl = "a.zip"\npoll = "1m30s"\n'
    c = config.parse(text)
    assert (c.rt_poll, c.max_transfers, c.feeds[0].poll, c.feeds[0].local, c.epsilon) == (30, 3, 90, True, 1.2)
    for bad in ("", 'osm_url = "x"', text + '[[feed]]\nname = "a"\nurl = "b"\n', text.replace("= 3", "= 9"), text.replace("a.zip", "http://a"), "nope = 1\n" + text):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert s.latest("t") is None
    assert [s.publish("t", spark.range(n)) for n in (1, 2)] == [1, 2]
    assert (s.read("t").count(), s.read("t", 1).count()) == (2, 1)


def test_arrive_by_takes_the_latest_minute(spark):
    from wayfare.plans import queries as q

    d = "/root/testdata/sf0.001"
    requests = {r.query_id: r for r in q.fx(spark, d, "requests")[0].collect()}
    got = {r.query_id: r for r in q.arrive_by(spark, d).collect()}
    assert len(got) >= 8 and any((requests[i].dep_sec + 7200 - r.dep_sec) % 120 for i, r in got.items())
    # forward: the departure found meets the deadline, the next minute's does not
    probes = [(2 * i + k, requests[i].source, requests[i].target, r.dep_sec + 60 * k, requests[i].egress_sec) for i, r in got.items() for k in (0, 1)]
    tries = spark.createDataFrame(probes, "query_id long, source long, target long, dep_sec long, egress_sec long")
    arr = {r.query_id: r.arr for r in q._raptor(spark, d, requests=tries).groupBy("query_id").agg(F.min("arr").alias("arr")).collect()}
    for i, r in got.items():
        deadline = requests[i].dep_sec + 7200
        assert arr[2 * i] == r.arr <= deadline
        assert r.dep_sec == deadline or arr.get(2 * i + 1, deadline + 1) > deadline


def test_every_query_has_rows(spark):
    import __spark_entry__ as entry
    from wayfare.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("patterns", "raptor", "components", "rt_overlay"):
        assert QUERIES[name](spark, d).count() > 0, name
