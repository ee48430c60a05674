"""Timetable operators: normalisation of stop times, calendars, patterns, coverage, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def in_stop_order(stop_times: DataFrame) -> DataFrame:
    """Adds pos: rows of a trip by sequence, rows of one sequence in file order."""
    by = Window.partitionBy("trip").orderBy("seq", "file_pos")
    return stop_times.withColumn("pos", (F.row_number().over(by) - 1).cast("long"))


def interpolate(stop_times: DataFrame) -> DataFrame:
    """Fills missing times trip by trip.

    A leading gap takes the next arrival, a trailing one the previous departure, a trip without times is 0. An
    inner gap is filled stop by stop: each value starts from the one filled before, with integer division, so
    it is a fold and not a straight line. A next time before the previous one counts as equal to it.
    """
    g = stop_times.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("pos", "seq", "stop_idx", "arr", "dep"))).alias("rows"))
    # one pass back gives each row the distance to the next known arrival, and that arrival
    ahead = F.aggregate(
        F.reverse("rows"),
        F.struct(F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("gap"), F.array().cast("array<struct<next:bigint,gap:bigint>>").alias("out")),
        lambda s, x: F.struct(
            F.coalesce(x["arr"], s["next"]).alias("next"),
            F.when(x["arr"].isNotNull(), F.lit(0).cast("long")).otherwise(s["gap"] + 1).alias("gap"),
            F.concat(s["out"], F.array(F.struct(s["next"].alias("next"), (s["gap"] + 1).alias("gap")))).alias("out"),
        ),
        lambda s: F.reverse(s["out"]),
    )
    rows = F.zip_with("rows", ahead, lambda r, a: F.struct(r["pos"].alias("pos"), r["seq"].alias("seq"), r["stop_idx"].alias("stop_idx"), r["arr"].alias("arr"), r["dep"].alias("dep"), a["next"].alias("next"), a["gap"].alias("gap")))

    def fill(s: Column, x: Column) -> Column:
        step = F.greatest(x["next"] - s["last"], F.lit(0).cast("long"))
        value = (
            F.when(x["arr"].isNotNull(), x["arr"])
            .when(s["last"].isNull(), F.coalesce(x["next"], F.lit(0).cast("long")))
            .when(x["next"].isNull(), s["last"])
            .otherwise(s["last"] + F.floor(step / (x["gap"] + 1)))
        )
        dep = F.when(x["arr"].isNotNull(), F.coalesce(x["dep"], x["arr"])).otherwise(value)
        # behind a leading gap nothing is known yet: the next stop of the gap takes the next arrival too
        last = F.when(x["arr"].isNull() & s["last"].isNull() & x["next"].isNotNull(), s["last"]).otherwise(dep)
        return F.struct(last.alias("last"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), x["seq"].alias("seq"), x["stop_idx"].alias("stop_idx"), value.alias("arr"), dep.alias("dep")))).alias("out"))

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<pos:bigint,seq:bigint,stop_idx:bigint,arr:bigint,dep:bigint>>").alias("out"))
    return g.select("trip", F.explode(F.aggregate(rows, start, fill, lambda s: s["out"])).alias("r")).select("trip", "r.*")


def monotonic(stop_times: DataFrame) -> DataFrame:
    """Times that never run back (W3): arrivals not before the previous departure, departures not before arrivals."""
    by = Window.partitionBy("trip").orderBy("pos")
    g = F.when(F.col("pos") == F.min("pos").over(Window.partitionBy("trip")), F.col("dep")).otherwise(F.greatest("arr", "dep"))
    fixed = stop_times.withColumn("g", g).withColumn("fixed_dep", F.max("g").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return fixed.withColumn("fixed_arr", F.greatest(F.col("arr"), F.lag("fixed_dep").over(by))).select("trip", "pos", F.col("fixed_arr").alias("arr"), F.col("fixed_dep").alias("dep"))


def active_services(services: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """date, service of ``dates(date)``: removals before additions before weekday mask and range."""
    kinds = exceptions.groupBy("service", "date").agg(F.max(F.col("kind") == "remove").alias("removed"), F.max(F.col("kind") == "add").alias("added"))
    runs = F.expr("shiftright(cast(mask AS int), weekday(to_date(cast(date AS string), 'yyyyMMdd'))) & 1") == 1
    each = services.join(F.broadcast(dates)).join(kinds, ["service", "date"], "left")
    on = F.when(F.coalesce("removed", F.lit(False)), False).when(F.coalesce("added", F.lit(False)), True).otherwise(runs & F.col("date").between(F.col("start_date"), F.col("end_date")))
    return each.where(on).select("date", "service")


def calendars(calendar: DataFrame, calendar_dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """services(service, mask, start_date, end_date) and service_exceptions of both calendar files."""
    masks = calendar.groupBy("service").agg(F.bit_or("mask").alias("mask"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
    named = calendar_dates.select("service").distinct()
    services = masks.join(named, "service", "full_outer").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    return services, calendar_dates.select("service", "date", F.when(F.col("exception_type").startswith("2"), "remove").otherwise("add").alias("kind"))


def patterns(timetable: DataFrame, trips: DataFrame) -> DataFrame:
    """pattern_key, route_id, stops, n_trips: trips of one route with one stop sequence (A3); trips of one stop go."""
    seqs = timetable.groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_idx"))), lambda x: x["stop_idx"]).alias("stops")).where(F.size("stops") >= 2)
    return seqs.join(trips, "trip").groupBy("route_id", "stops").agg(F.count(F.lit(1)).alias("n_trips"), F.min("trip").alias("first_trip"))


def trip_rank(timetable: DataFrame) -> DataFrame:
    """Rank of each trip in its pattern by first departure."""
    first = timetable.groupBy("pattern", "trip").agg(F.min_by("dep", "pos").alias("first_dep"))
    by = Window.partitionBy("pattern").orderBy("first_dep", "trip")
    return first.withColumn("trip_rank", (F.row_number().over(by) - 1).cast("long"))


def shape_distance(shapes: DataFrame) -> DataFrame:
    """Decimetres from the start of each shape, cut from the running sum."""
    by = Window.partitionBy("shape_id").orderBy("idx")
    step = geo.distance(F.lag("lat_e7").over(by), F.lag("lon_e7").over(by), F.col("lat_e7"), F.col("lon_e7"))
    run = F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return shapes.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("cum_dm", F.floor(run * 10).cast("long")).drop("step")


def shape_slice(shapes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points of ``wanted(leg, shape_id, from_idx, to_idx)``."""
    return wanted.join(shapes, "shape_id").where(F.col("idx").between(F.col("from_idx"), F.col("to_idx"))).select("leg", "shape_id", "idx", "lat_e7", "lon_e7")


def shape_anchors(pattern_stops: DataFrame, shapes: DataFrame) -> DataFrame:
    """shape_idx for each stop of a pattern: the nearest shape point not before that of the stop before."""
    points = shapes.groupBy(F.col("shape_id").alias("pattern")).agg(F.array_sort(F.collect_list(F.struct("idx", "lat_e7", "lon_e7"))).alias("points"))
    stops = pattern_stops.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_idx", "lat_e7", "lon_e7"))).alias("stops"))

    def near(s: Column, x: Column) -> Column:
        later = F.filter("points", lambda p: p["idx"] >= s["at"])
        best = F.array_min(F.transform(later, lambda p: F.struct(geo.distance(x["lat_e7"], x["lon_e7"], p["lat_e7"], p["lon_e7"]).alias("d"), p["idx"].alias("idx"))))["idx"]
        return F.struct(best.alias("at"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), x["stop_idx"].alias("stop_idx"), best.alias("shape_idx")))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<pos:bigint,stop_idx:bigint,shape_idx:bigint>>").alias("out"))
    return stops.join(points, "pattern").select("pattern", F.explode(F.aggregate("stops", start, near, lambda s: s["out"])).alias("r")).select("pattern", "r.*")


def covered_stops(stops: DataFrame, box: DataFrame, margin_m: float = 2000) -> DataFrame:
    """Stops inside the one row of ``box(min_lat, min_lon, max_lat, max_lon)``, widened."""
    ok = geo.inside(F.col("lat_e7"), F.col("lon_e7"), *[F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")], margin_m)
    return stops.join(F.broadcast(box.limit(1))).where(ok).select(*stops.columns)


def exclusions(timetable: DataFrame, trips: DataFrame, covered: DataFrame, top: int = 12) -> DataFrame:
    """route_id, short, trips excluded because a stop lies outside, most first (A4, K7)."""
    outside = timetable.join(covered.select("stop_idx"), "stop_idx", "left_anti").select("trip").distinct()
    return outside.join(trips, "trip").groupBy("route_id", "short").agg(F.count(F.lit(1)).alias("excluded")).orderBy(F.desc("excluded"), "route_id").limit(top)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in file order."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def merge_feeds(feeds: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of all feeds under keys feed:id."""
    parts = [df.withColumn("feed", F.lit(name)).withColumn(key, F.concat_ws(":", F.lit(name), F.col(key).cast("string"))) for name, df in feeds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def trips_enriched(trips: DataFrame, routes: DataFrame, services: DataFrame) -> DataFrame:
    """Trips of known routes and services, with both."""
    return trips.join(routes, "pattern").join(services.select("service", "mask"), "service")


def scheduled_with_realtime(timetable: DataFrame, overlay: DataFrame) -> DataFrame:
    """Times through the overlay, never below 0."""
    t = timetable.join(overlay.select("trip", "pos", "arr_delta", "dep_delta"), ["trip", "pos"], "left")
    late = lambda c, d: F.greatest(F.lit(0).cast("long"), F.col(c) + F.coalesce(F.col(d), F.lit(0).cast("long"))).alias(c)
    return t.select("trip", "pos", "stop_idx", late("arr", "arr_delta"), late("dep", "dep_delta"))


#: A time before all days: stops that are skipped can't be boarded or left at.
NEVER = -(1 << 31)


def without_skipped(timetable: DataFrame, stops: DataFrame) -> DataFrame:
    """``timetable`` whose calls in ``stops(trip, pos, skipped)`` have no times to board or alight at."""
    j = timetable.join(stops.where("skipped").select("trip", "pos", F.lit(True).alias("__skip")), ["trip", "pos"], "left")
    for c in ("arr", "dep"):
        j = j.withColumn(c, F.when(F.col("__skip"), F.lit(NEVER).cast("long")).otherwise(F.col(c)))
    return j.drop("__skip")
