"""GTFS feeds: members of zip files as text rows, then typed tables."""

from __future__ import annotations

import csv
import io
import itertools
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import timetable
from ..store import shared_dir

#: The members that are read, and the columns that are kept of each.
MEMBERS = {
    "agency": ["agency_id", "agency_timezone"],
    "stops": ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "location_type"],
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type", "route_color", "route_text_color"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
    "trips": ["route_id", "service_id", "trip_id", "trip_headsign", "direction_id", "shape_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
}
NEEDED = ("stops", "routes", "trips", "stop_times")


def records(lines: Iterable[str]) -> Iterator[dict[str, str]]:
    """Rows by header name: byte order mark and blanks around names go, blank lines are skipped, short rows are filled."""
    rows = csv.reader(lines)
    head = [h.removeprefix("\ufeff").strip() for h in next(rows, [])]
    for r in rows:
        if r and r != [""]:
            yield dict(zip(head, r))


class Feed:
    """The members of a zip file, read and parsed once: a written table of rows, one partition for each member."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = f"{shared_dir(spark)}/gtfs-{uuid.uuid4().hex}"
        rows = _parsed(spark.read.format("binaryFile").load(path).select("content"))
        rows.write.partitionBy("member").parquet(self.at)
        self.rows = spark.read.schema("file_pos long, cells map<string,string>, member string").parquet(self.at)


def _parsed(files: DataFrame) -> DataFrame:
    """file_pos, cells and member of all rows of the members that are read; the first member of a base name counts."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    found: dict[str, str] = {}
                    for full in z.namelist():
                        found.setdefault(full.rsplit("/", 1)[-1], full)
                    missing = [n for n in NEEDED if f"{n}.txt" not in found]
                    if missing:
                        raise ValueError(f"the feed lacks {', '.join(missing)}")
                    for name, columns in MEMBERS.items():
                        if f"{name}.txt" not in found:
                            continue
                        with z.open(found[f"{name}.txt"]) as raw:
                            lines = io.TextIOWrapper(raw, "utf-8", "replace", newline="")
                            yield from _batches(name, columns, records(lines))

    return files.mapInArrow(run, "file_pos long, cells map<string,string>, member string")


def _batches(name: str, columns: list[str], rows: Iterator[dict[str, str]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    numbered = enumerate(rows)
    while part := list(itertools.islice(numbered, most)):
        cells = pa.array([[(c, r[c]) for c in columns if c in r] for _, r in part], pa.map_(pa.string(), pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), cells, pa.array([name] * len(part))], names=["file_pos", "cells", "member"])


def opened(spark: SparkSession, feed: str | Feed) -> Feed:
    """A feed, or the one in the zip file at a path; what needs several members opens it once."""
    return feed if isinstance(feed, Feed) else Feed(spark, feed)


def member(spark: SparkSession, feed: str | Feed, name: str) -> DataFrame:
    """file_pos and the text columns of one member."""
    rows = opened(spark, feed).rows
    return rows.where(F.col("member") == name).select("file_pos", *[F.element_at("cells", F.lit(c)).alias(c) for c in MEMBERS[name]])


def stops(spark: SparkSession, path: str | Feed) -> DataFrame:
    """stop_id, code, name, lat_e7, lon_e7, ok: platforms alone; bad coordinates are 0, 0 and not ok."""
    s = member(spark, path, "stops").where("coalesce(stop_id, '') != '' AND (coalesce(location_type, '') = '' OR location_type LIKE '0%')")
    lat, lon = parse.degrees_e7(F.col("stop_lat")), parse.degrees_e7(F.col("stop_lon"))
    ok = lat.isNotNull() & lon.isNotNull()
    s = timetable.first_of(s, "stop_id", "file_pos")
    zero = F.lit(0).cast("long")
    return s.select("stop_id", F.col("stop_code").alias("code"), F.col("stop_name").alias("name"), F.when(ok, lat).otherwise(zero).alias("lat_e7"), F.when(ok, lon).otherwise(zero).alias("lon_e7"), ok.alias("ok"))


def routes(spark: SparkSession, path: str | Feed) -> DataFrame:
    r = timetable.first_of(member(spark, path, "routes").where("coalesce(route_id, '') != ''"), "route_id", "file_pos")
    return r.select("route_id", F.col("route_short_name").alias("short"), F.col("route_long_name").alias("long"), "agency_id", F.coalesce(parse.unsigned(F.col("route_type")), F.lit(-1).cast("long")).alias("type"))


def services(spark: SparkSession, path: str | Feed) -> tuple[DataFrame, DataFrame]:
    path = opened(spark, path)
    days = MEMBERS["calendar"][1:8]
    c = member(spark, path, "calendar")
    mask = sum((F.when(F.col(d) == "1", 1 << i).otherwise(0) for i, d in enumerate(days)), F.lit(0)).cast("long")
    c = c.select(F.col("service_id").alias("service"), mask.alias("mask"), parse.day(F.col("start_date")).alias("start_date"), parse.day(F.col("end_date")).alias("end_date"))
    d = member(spark, path, "calendar_dates").select(F.col("service_id").alias("service"), parse.day(F.col("date")).alias("date"), "exception_type").where("date IS NOT NULL")
    return timetable.calendars(c, d)


def trips(spark: SparkSession, path: str | Feed) -> DataFrame:
    """Trips of known routes and services."""
    path = opened(spark, path)
    t = timetable.first_of(member(spark, path, "trips"), "trip_id", "file_pos")
    t = t.join(routes(spark, path).select("route_id"), "route_id", "left_semi").join(services(spark, path)[0].select(F.col("service").alias("service_id")), "service_id", "left_semi")
    return t.select("trip_id", "route_id", F.col("service_id").alias("service"), "shape_id", F.col("trip_headsign").alias("headsign"))


def shapes(spark: SparkSession, path: str | Feed) -> DataFrame:
    s = member(spark, path, "shapes").select("shape_id", parse.unsigned(F.col("shape_pt_sequence")).alias("idx"), parse.degrees_e7(F.col("shape_pt_lat")).alias("lat_e7"), parse.degrees_e7(F.col("shape_pt_lon")).alias("lon_e7"))
    return s.dropna()


def stop_times(spark: SparkSession, path: str | Feed) -> DataFrame:
    """trip, pos, seq, stop_idx (ids as text), arr, dep: known trips and stops, in order, without gaps, never running back."""
    path = opened(spark, path)
    t = member(spark, path, "stop_times")
    t = t.join(trips(spark, path).select("trip_id"), "trip_id", "left_semi").join(stops(spark, path).select("stop_id"), "stop_id", "left_semi")
    arr, dep = parse.gtfs_time(F.col("arrival_time")), parse.gtfs_time(F.col("departure_time"))
    t = t.select(F.col("trip_id").alias("trip"), "stop_id", parse.unsigned(F.col("stop_sequence")).alias("seq"), "file_pos", F.coalesce(arr, dep).alias("arr"), F.coalesce(dep, arr).alias("dep")).where("seq IS NOT NULL")
    placed = timetable.in_stop_order(t)
    filled = timetable.interpolate(placed.withColumn("stop_idx", F.col("pos")))
    return timetable.monotonic(filled).join(placed.select("trip", "pos", "seq", "stop_id"), ["trip", "pos"])


def timezone(spark: SparkSession, path: str | Feed, default: str = "Europe/Rome") -> str:
    row = member(spark, path, "agency").orderBy("file_pos").first()
    return (row and row.agency_timezone) or default
