"""Streams over ordered files with clocks of their own, and the planner over versioned tables."""

import json
import os

from pyspark.sql import functions as F

from wayfare.engine import Engine
from wayfare.fixtures import fixture
from wayfare.sources import gtfs_rt
from wayfare.store import Snapshots
from wayfare.streaming import overlay, tracking

LEGS = [
    {"mode": "foot", "from": "home", "to": "SA", "dep": 0, "arr": 300, "to_at": [41.9, 12.5]},
    {"mode": "transit", "trip": 1, "from": "SA", "to": "SB", "dep": 400, "arr": 900, "board_pos": 0, "alight_pos": 1, "to_at": [41.91, 12.5]},
]


def play(spark, tmp_path, rows):
    tracking_dir = tmp_path / "in"
    tracking_dir.mkdir()
    for n, r in enumerate(rows):
        at = tracking_dir / f"{n:03}.json"
        at.write_text(json.dumps({"session_id": "s", **r}))
        os.utime(at, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in the order of their times
    source = spark.readStream.schema(tracking.INPUT).option("maxFilesPerTrigger", 4).json(str(tracking_dir))
    name = f"events_{tmp_path.name}".replace("-", "_")
    q = tracking.track(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [(r.event, json.loads(r.detail)) for r in spark.table(name).orderBy("at").collect()]


def test_a_journey_is_followed(spark, tmp_path):
    over = lambda **o: json.dumps({"1": o})
    rows = [
        {"at": 0, "kind": "plan", "payload": json.dumps({"legs": LEGS})},
        {"at": 10, "kind": "fix", "lat": 41.898, "lon": 12.5, "accuracy_m": 10.0},
        {"at": 20, "kind": "fix", "lat": 0.0, "lon": 0.0, "accuracy_m": 10.0},
        {"at": 60, "kind": "overlay", "payload": over(dep_delay=540, arr_delay=540)},
        {"at": 301, "kind": "tick"},
        {"at": 950, "kind": "overlay", "payload": over(dep_delay=540, arr_delay=540, passed=0)},
        {"at": 1500, "kind": "overlay", "payload": over(dep_delay=540, arr_delay=540, passed=1)},
    ]
    events = play(spark, tmp_path, rows)
    names = [e if e != "progress" else d["phase"] for e, d in events]
    assert names == ["hello", "walking", "delay", "replan", "waiting", "boarded", "alighted", "arrived"]
    assert dict(events)["delay"]["arrive_delta_s"] == 540 and dict(events)["replan"]["reason"] == "better_arrival"


def test_cancelled_trips_warn_once_and_ask_again(spark, tmp_path):
    gone = json.dumps({"1": {"cancelled": True}})
    rows = [{"at": 0, "kind": "plan", "payload": json.dumps({"legs": LEGS})}] + [{"at": t, "kind": "overlay", "payload": gone} for t in (5, 8, 20)]
    rows.append({"at": 30, "kind": "plan", "payload": json.dumps({"reason": "cancelled", "legs": [LEGS[0], {**LEGS[1], "trip": 2}]})})
    events = play(spark, tmp_path, rows)
    assert [e for e, _ in events] == ["hello", "warning", "replan", "replan", "reroute"]
    assert events[-1][1] == {"reason": "cancelled", "changed_legs": [1]}


def test_overlay_versions(spark, tmp_path):
    t = spark.createDataFrame([(k, p, 10 * (p + 1), 100 * p, 100 * p) for k in (1, 2) for p in range(3)], "trip long, pos long, seq long, arr long, dep long").withColumn("stop_idx", F.col("pos") + 50)
    trips = spark.createDataFrame([(1, "a"), (2, "b")], "trip long, trip_id string")
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.pb").write_bytes(gtfs_rt.encode(1, [{"trip_id": "a", "stops": [{"seq": 10, "dep_delay": 60}]}, {"trip_id": "b", "cancelled": True}], [{"trip_id": "a", "seq": 20, "status": 1}]))
    snaps = Snapshots(spark, str(tmp_path / "tables"))
    q = overlay.publish_overlay(overlay.feed(spark, str(tmp_path / "feed")), t, trips, snaps, str(tmp_path / "cp"), 0, lambda: 10, {"availableNow": True})
    q.awaitTermination()
    assert {(r.trip, r.pos): r.dep_delta for r in snaps.read("rt_stops").collect()} == {(1, 0): 60, (1, 1): 60, (1, 2): 60}
    assert {r.trip: (r.cancelled, r.passed) for r in snaps.read("rt_trips").collect()} == {1: (False, 0), 2: (True, -1)}


def test_overlay_keeps_what_other_files_said(spark, tmp_path):
    """Updates and vehicles in files of their own, and updates that name stops alone."""
    t = spark.createDataFrame([(k, p, 10 * (p + 1), 50 + p, 100 * p, 100 * p) for k in (1, 2) for p in range(3)], "trip long, pos long, seq long, stop_idx long, arr long, dep long")
    trips = spark.createDataFrame([(1, "a"), (2, "b")], "trip long, trip_id string")
    stops = spark.createDataFrame([(f"s{n}", n) for n in range(50, 53)], "stop_id string, stop_idx long")
    snaps = Snapshots(spark, str(tmp_path / "tables"))
    feed = tmp_path / "feed"
    feed.mkdir()

    def publish():
        overlay.publish_overlay(overlay.feed(spark, str(feed)), t, trips, snaps, str(tmp_path / "cp"), 0, lambda: 10, {"availableNow": True}, stops).awaitTermination()
        return {(r.trip, r.pos): r.dep_delta for r in snaps.read("rt_stops").collect()}, {r.trip: r.veh_pos for r in snaps.read("rt_trips").collect()}

    (feed / "updates.pb").write_bytes(gtfs_rt.encode(1, [{"trip_id": "a", "stops": [{"stop_id": "s51", "dep_delay": 60}]}]))
    assert publish() == ({(1, 0): 0, (1, 1): 60, (1, 2): 60}, {1: None})
    (feed / "vehicles.pb").write_bytes(gtfs_rt.encode(2, [], [{"trip_id": "b", "lat": 41.5, "lon": 12.5, "seq": 20, "status": 1}]))
    assert publish() == ({(1, 0): 0, (1, 1): 60, (1, 2): 60}, {1: None, 2: 1})
    (feed / "updates2.pb").write_bytes(gtfs_rt.encode(3, [{"trip_id": "b", "stops": [{"seq": 10, "dep_delay": 30}]}]))
    assert publish() == ({(2, 0): 30, (2, 1): 30, (2, 2): 30}, {2: 1})


def test_engine_plans_on_published_tables(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    engine = Engine(spark, str(tmp_path))
    assert not engine.ready
    engine.publish(**{n: fixture(spark, d, n) for n in ("timetable", "services", "service_exceptions", "stops", "transfers")})
    assert engine.ready and engine.status().count() == 5
    dates = spark.createDataFrame([(20260710, 20260709)], "date long, previous long")
    requests = fixture(spark, d, "requests").where("query_id < 6").join(F.broadcast(dates))
    got = engine.plan(requests)
    assert got.select("query_id").distinct().count() == 6
    legs = engine.legs(got, dates)
    assert legs.where("name IS NULL").count() == 0 and legs.count() > 0
