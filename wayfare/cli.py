"""Command line: write an example configuration, load feeds, plan a file of requests, show the status."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .engine import Engine
from .sources import gtfs_zip

EXAMPLE = """osm_url = "extract.osm.pbf"

[search]
walk_kmh = 4.8
max_transfers = 4
transfer_slack = "90s"

[[feed]]
name = "city"
url = "gtfs.zip"
poll = "1m"
"""


def load_feeds(spark: SparkSession, engine: Engine, c: config.Config) -> None:
    """Publish stops, services, exceptions and timetable of all feeds under dense numbers."""
    from .operators import timetable

    per = {f.name: gtfs_zip.Feed(spark, config.local_path(f.url)) for f in c.feeds}
    stops = timetable.merge_feeds({n: gtfs_zip.stops(spark, p) for n, p in per.items()}, "stop_id")
    # numbers come from a hash, not from a global sort; collisions among stops show as duplicate numbers
    stops = stops.withColumn("stop_idx", F.xxhash64("stop_id"))
    services = [gtfs_zip.services(spark, p) for p in per.values()]
    key = lambda n, col: F.concat_ws(":", F.lit(n), col)
    named = list(zip(per, services, strict=True))
    cal = [s.withColumn("service", key(n, "service")) for n, (s, _) in named]
    exc = [e.withColumn("service", key(n, "service")) for n, (_, e) in named]
    rows = []
    for n, p in per.items():
        t = gtfs_zip.trips(spark, p).select(key(n, "trip_id").alias("trip_id"), key(n, "route_id").alias("route_id"), key(n, "service").alias("service"))
        st = gtfs_zip.stop_times(spark, p).select(key(n, "trip").alias("trip_id"), key(n, "stop_id").alias("stop_id"), "pos", "seq", "arr", "dep")
        rows.append(st.join(t, "trip_id"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]), allowMissingColumns=True)
    t = union(rows).withColumn("stop_idx", F.xxhash64("stop_id")).withColumn("trip", F.xxhash64("trip_id"))
    sequence = t.groupBy("trip", "route_id").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_idx"))), lambda x: x["stop_idx"])).alias("s")).select("trip", F.xxhash64("route_id", "s").alias("pattern"))
    t = t.join(sequence, "trip")
    t = t.join(timetable.trip_rank(t).select("trip", "trip_rank"), "trip")
    engine.publish(stops=stops, services=union(cal), service_exceptions=union(exc), timetable=t.select("trip", "pattern", "trip_rank", "pos", "stop_idx", "arr", "dep", "seq", "service"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wayfare")
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("init").add_argument("path")
    for name in ("load", "plan", "status"):
        p = todo.add_parser(name)
        p.add_argument("--tables", required=True)
        p.add_argument("--config")
        if name == "plan":
            p.add_argument("requests", help="Parquet of query_id, date, previous, source, dep_sec, target, egress_sec")
            p.add_argument("out")
    a = parser.parse_args(argv)
    if a.todo == "init":
        with open(a.path, "x", encoding="utf-8") as f:
            f.write(EXAMPLE)
        return
    spark = SparkSession.builder.getOrCreate()
    c = config.load(a.config) if a.config else config.Config()
    engine = Engine(spark, a.tables, c)
    if a.todo == "load":
        load_feeds(spark, engine, c)
    elif a.todo == "plan":
        engine.plan(spark.read.parquet(a.requests)).write.parquet(a.out)
    else:
        engine.status().show(truncate=False)


if __name__ == "__main__":
    main()
