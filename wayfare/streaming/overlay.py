"""Realtime feeds as a stream: every micro-batch publishes the next version of the overlay."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import realtime
from ..sources import gtfs_rt
from ..store import Snapshots, materialize

#: Columns of the files that a feed folder gets, one file for each poll.
FILES = "path string, modificationTime timestamp, length long, content binary"


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Feed messages that arrive as files; equal bytes count once, whatever file they are in."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    return files.withColumn("sha", F.sha2("content", 256)).withWatermark("modificationTime", "1 hour").dropDuplicatesWithinWatermark(["sha"])


def updates(entities: DataFrame, trips: DataFrame, base: int, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decoded ``entities(source, ...)`` as the inputs of the overlay: trip updates and vehicles with the timetable's numbers.

    Sources count in the order of their names, messages inside one in the order of the feed. ``stops(stop_id,
    stop_idx)`` lets updates without a sequence find their call.
    """
    known = entities.join(trips.select("trip_id", "trip"), "trip_id")
    if stops is not None:
        known = known.join(stops.select("stop_id", "stop_idx"), "stop_id", "left")
    else:
        known = known.withColumn("stop_idx", F.lit(None).cast("long"))
    first = Window.partitionBy("source", "trip").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ups = known.where("kind = 'trip'").select(
        "trip", F.struct("source", F.first("ord").over(first).alias("ord")).alias("msg"), F.col("ord").cast("long").alias("ord"), "seq", "stop_idx", F.coalesce("cancelled", F.lit(False)).alias("cancelled"),
        F.coalesce("skipped", F.lit(False)).alias("skipped"), "trip_delay", "arr_delay", "dep_delay", "arr_time", "dep_time", F.lit(base).cast("long").alias("base"),
    )
    e7 = lambda c: (F.col(c) * 1e7).cast("long").alias(f"{c}_e7")
    return ups, known.where("kind = 'vehicle'").select("trip", "seq", "status", F.struct("source", "ord").alias("event_id"), e7("lat"), e7("lon"))


def latest_entities(entities: DataFrame, files: DataFrame, before: DataFrame | None) -> DataFrame:
    """What counts of all feeds so far: for each source (the file's folder) and kind of entity, the rows of its latest file.

    Feeds are full states: a later file replaces what an earlier one of its source said of the kinds that it holds, and
    leaves other kinds and sources as they are, so feeds for updates and vehicles may come apart or mixed.
    """
    at = files.select("path", F.col("modificationTime").alias("file_time"))
    e = entities.join(at, "path").withColumn("source", F.regexp_extract("path", "([^/]+)/[^/]*$", 1))
    if before is not None:
        e = e.unionByName(before.select(*e.columns))
    last = e.groupBy("source", "kind").agg(F.max(F.struct("file_time", "path")).alias("m")).select("source", "kind", "m.*")
    return e.join(last, ["source", "kind", "file_time", "path"], "left_semi")


def publish_overlay(source: DataFrame, timetable: DataFrame, trips: DataFrame, snapshots: Snapshots, checkpoint: str, base: int, now: Callable[[], int] = lambda: int(time.time()), trigger: dict | None = None, stops: DataFrame | None = None) -> StreamingQuery:
    """Start the stream; versions go to the tables rt_trips and rt_stops of ``snapshots``, the feeds' state to rt_entities."""

    def batch(files: DataFrame, _: int) -> None:
        entities = materialize(gtfs_rt.decode_files(files), "rt")
        before = snapshots.read("rt_entities") if snapshots.latest("rt_entities") else None
        if entities.isEmpty() and before is None:
            return
        snapshots.publish("rt_entities", latest_entities(entities, files, before))
        ups, vehicles = updates(snapshots.read("rt_entities"), trips, base, stops)
        over_trips, over_stops = realtime.overlay(ups, realtime.vehicles(vehicles, timetable), timetable, now())
        snapshots.publish("rt_stops", over_stops)
        snapshots.publish("rt_trips", over_trips)  # last: readers look for its version first

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "20 seconds"})).start()
