"""Requests, responses, remote files and the command line."""

import hashlib
import http.server
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfare import cli, config
from wayfare.engine import Engine
from wayfare.operators import requests
from wayfare.sources import fetch


def test_requests_are_checked(spark):
    rows = [
        (1, 41.9, 12.5, 41.95, 12.55, "transit", "2026-07-10T08:30:05", 0), (2, 91.0, 0.0, 0.0, 0.0, "walk", "2026-07-10T08:30", 1), (3, 1.0, 1.0, 1.0, 1.0, "boat", "2026-07-10T08:30", 1),
        (4, 1.0, 1.0, 1.0, 1.0, "car", "soon", 1), (5, -41.12345678, 1.0, 1.0, 1.0, "car", "2026-07-09T23:30:00Z", 3), (6, 1.0, 1.0, 1.0, 1.0, "car", "2026-07-10 08:30", 11), (7, None, 1.0, 1.0, 1.0, "car", "2026-07-10 08:30", 1),
    ]
    ok, bad = requests.checked(spark.createDataFrame(rows, "query_id long, from_lat double, from_lon double, to_lat double, to_lon double, mode string, when string, num int"), "Europe/Rome")
    got = {r.query_id: (r.date, r.previous, r.dep_sec, r.num, r.from_lat_e7) for r in ok.collect()}
    assert got == {1: (20260710, 20260709, 30605, 4, 419000000), 5: (20260710, 20260709, 5400, 3, -411234567)}
    assert {r.query_id: r.reason for r in bad.collect()} == {2: "place out of range", 3: "unknown mode", 4: "no time", 6: "num is above 10", 7: "place out of range"}


def test_responses_and_dispatch(spark):
    its = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id long, rank long, sig string")
    assert json.loads(requests.responses(its).first().body) == {"itineraries": [{"rank": 1, "sig": "a"}, {"rank": 2, "sig": "b"}]}
    r = spark.createDataFrame([(1, "walk"), (2, "car"), (3, "walk")], "query_id long, mode string")
    out = requests.by_mode(r, {"walk": lambda d: d.withColumn("by", F.lit("w")), "car": lambda d: d.withColumn("by", F.lit("c"))})
    assert {x.query_id: x.by for x in out.collect()} == {1: "w", 2: "c", 3: "w"}


def test_conditional_requests_and_landing(tmp_path):
    body = {"data": b"one"}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            tag = hashlib.md5(body["data"]).hexdigest()
            if self.headers.get("If-None-Match") == tag:
                self.send_response(304)
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("ETag", tag)
            self.end_headers()
            self.wfile.write(body["data"])

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    land = fetch.Landing(str(tmp_path))
    assert [land.refresh("x", url), land.refresh("x", url)] == [True, False]
    body["data"] = b"two"
    assert land.refresh("x", url) and (tmp_path / "x").read_bytes() == b"two"
    assert land.meta("x", url)["sha"] == hashlib.sha256(b"two").hexdigest() and land.meta("x", url + "?") == {}
    server.shutdown()
    waits = []
    with pytest.raises(OSError):
        fetch.retried(lambda: fetch.get("http://127.0.0.1:9/", timeout=1), times=4, sleep=waits.append)
    assert waits == [15, 30, 60]


def test_command_line_loads_a_feed(spark, tmp_path):
    cli.main(["init", str(tmp_path / "c.toml")])
    assert config.load(str(tmp_path / "c.toml")).feeds[0].name == "city"
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon\na,A,41.5,12.5\nb,B,41.6,12.6\n",
        "routes": "route_id,route_short_name,route_type\nr,R,3\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nw,1,1,1,1,1,1,1,20260101,20261231\n",
        "trips": "route_id,service_id,trip_id\nr,w,t1\nr,w,t2\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,08:00:00,08:00:00,a,1\nt1,08:10:00,08:10:00,b,2\nt2,09:00:00,09:00:00,a,1\nt2,09:10:00,09:10:00,b,2\n",
    }
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for name, text in files.items():
            z.writestr(f"{name}.txt", text)
    c = config.parse(f'osm_url = "x"\n[[feed]]\nname = "city"\nurl = "{tmp_path}/f.zip"\n')
    engine = Engine(spark, str(tmp_path / "tables"), c)
    cli.load_feeds(spark, engine, c)
    engine.publish(transfers=spark.createDataFrame([], "from_stop long, to_stop long, ds long"))
    ids = {r.stop_id: r.stop_idx for r in engine.tables.read("stops").collect()}
    asked = spark.createDataFrame([(1, 20260710, 20260709, ids["city:a"], 30000, ids["city:b"], 60)], "query_id long, date long, previous long, source long, dep_sec long, target long, egress_sec long")
    (j,) = engine.plan(asked).collect()
    assert (j.arr, j.rides) == (9 * 3600 + 600 + 60, 1)
