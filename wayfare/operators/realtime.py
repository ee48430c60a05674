"""Realtime operators: projecting trip updates and vehicles onto the timetable as an overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_updates(updates: DataFrame) -> DataFrame:
    """The rows of each trip's first message by ``msg`` (A15): sources and messages that come later add nothing to a trip."""
    return updates.withColumn("__m", F.min("msg").over(Window.partitionBy("trip"))).where("msg = __m").drop("__m")


def match_stats(entities: DataFrame, trips: DataFrame) -> DataFrame:
    """kind, entities, matched, unmatched, last_ts."""
    known = trips.select("trip", F.lit(True).alias("known"))
    hit = F.coalesce("known", F.lit(False))
    return entities.join(known, "trip", "left").groupBy("kind").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), F.max("feed_ts").alias("last_ts")
    )


def stu_deltas(updates: DataFrame, timetable: DataFrame) -> DataFrame:
    """trip, pos, arr_delta, dep_delta: given delays, or absolute times less the schedule (R3, J5 by sequence).

    ``updates(trip, seq, arr_delay, dep_delay, arr_time, dep_time, base)``; times in seconds, base is the midnight
    of the service day.
    """
    t = timetable.select("trip", "seq", "pos", F.col("arr").alias("s_arr"), F.col("dep").alias("s_dep"))
    d = lambda p: F.coalesce(f"{p}_delay", F.col(f"{p}_time") - (F.col("base") + F.col(f"s_{p}")))
    return updates.join(t, ["trip", "seq"]).select("trip", "pos", d("arr").alias("arr_delta"), d("dep").alias("dep_delta"))


def match_by_stop(updates: DataFrame, stops: DataFrame) -> DataFrame:
    """trip, ord, pos of updates without a usable sequence: the first call at the stop not before the cursor.

    ``updates(trip, ord, seq, stop_idx)`` in feed order; the cursor stands behind the position matched before.
    Sequences win, and may set the cursor back; updates that match nothing are left out.
    """
    calls = stops.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("pos", "seq", "stop_idx"))).alias("calls"))
    ups = updates.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("ord", "seq", "stop_idx"))).alias("ups"))

    def step(s, u):
        by_seq = F.filter("calls", lambda c: c["seq"] == u["seq"])
        by_stop = F.filter("calls", lambda c: (c["stop_idx"] == u["stop_idx"]) & (c["pos"] >= s["cursor"]))
        pos = F.coalesce(F.get(by_seq, F.lit(0))["pos"], F.get(by_stop, F.lit(0))["pos"])
        return F.struct(F.coalesce(pos + 1, s["cursor"]).alias("cursor"), F.when(pos.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(u["ord"].alias("ord"), pos.alias("pos"))))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("cursor"), F.array().cast("array<struct<ord:bigint,pos:bigint>>").alias("out"))
    return ups.join(calls, "trip").select("trip", F.explode(F.aggregate("ups", start, step, lambda s: s["out"])).alias("r")).select("trip", "r.*")


def propagate(deltas: DataFrame, calls: DataFrame) -> DataFrame:
    """trip, pos, arr_delta, dep_delta at every call of the trips in ``deltas(trip, pos, arr_delta, dep_delta, trip_delay)``.

    A delay holds until the next update; before the first one the trip's own delay holds. The last of several
    updates of one call, by its values, counts.
    """
    one = deltas.groupBy("trip", "pos").agg(F.max(F.struct("dep_delta", "arr_delta")).alias("u"))
    trip = deltas.groupBy("trip").agg(F.max("trip_delay").alias("trip_delay"))
    by = Window.partitionBy("trip").orderBy("pos")
    j = calls.select("trip", "pos").join(trip, "trip").join(one, ["trip", "pos"], "left")
    j = j.withColumn("e", F.coalesce("u.dep_delta", "u.arr_delta"))
    run = F.coalesce(F.last("e", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col("trip_delay"), F.lit(0).cast("long"))
    before = F.coalesce(F.last("e", True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("trip_delay"), F.lit(0).cast("long"))
    return j.select("trip", "pos", F.coalesce(F.col("u.arr_delta"), before).alias("arr_delta"), run.alias("dep_delta"))


def last_of(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each trip by ``order``."""
    by = Window.partitionBy("trip").orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def vehicles(entities: DataFrame, timetable: DataFrame) -> DataFrame:
    """trip, pos, status, passed and place of the last vehicle of each trip (R5); without a known sequence pos and passed are null."""
    at = timetable.select("trip", "seq", "pos")
    place = [c for c in ("lat_e7", "lon_e7") if c in entities.columns]
    return last_of(entities, "event_id").join(at, ["trip", "seq"], "left").select("trip", "pos", "status", (F.col("pos") - 1).alias("passed"), *place)


def resolve(updates: DataFrame, timetable: DataFrame) -> DataFrame:
    """Adds ``pos`` to ``updates(trip, ord, seq, stop_idx, ...)``, null where an update is of no call."""
    some = updates.where("seq IS NOT NULL OR stop_idx IS NOT NULL").select("trip", "ord", "seq", "stop_idx")
    return updates.join(match_by_stop(some, timetable), ["trip", "ord"], "left")


def overlay(updates: DataFrame, vehicle: DataFrame, timetable: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Overlay of trips (trip, cancelled, passed, veh_pos, status, place) and of stops (trip, pos, deltas, skipped).

    ``updates(trip, msg, ord, seq, stop_idx, cancelled, skipped, trip_delay, arr_delay, dep_delay, arr_time, dep_time,
    base)`` of all sources: msg numbers messages in the order in which they count, ord the rows inside one, and base is
    the midnight of the service day. The first message of a trip counts; a cancelled
    trip has no deltas. A stop has passed when its event (departure, else arrival, else schedule and
    delay) is not after ``now``, or a vehicle stands beyond it.
    """
    cancelled = updates.groupBy("trip").agg(F.max("cancelled").alias("cancelled"))
    live = first_updates(updates.join(cancelled.where("cancelled").select("trip"), "trip", "left_anti"))
    placed = resolve(live, timetable)
    t = timetable.select("trip", "pos", F.col("arr").alias("s_arr"), F.col("dep").alias("s_dep"))
    delta = lambda p: F.coalesce(f"{p}_delay", F.col(f"{p}_time") - (F.col("base") + F.col(f"s_{p}"))).alias(f"{p}_delta")
    d = placed.join(t, ["trip", "pos"], "left").select("trip", "pos", delta("arr"), delta("dep"), "trip_delay")
    spread = propagate(d, timetable)
    flags = placed.where("pos IS NOT NULL").join(timetable.select("trip", "pos", "dep"), ["trip", "pos"])
    flags = flags.groupBy("trip", "pos").agg(*[F.max(c).alias(c) for c in ("skipped", "dep_time", "arr_time", "base", "dep")])
    stops = spread.join(flags, ["trip", "pos"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    event = F.coalesce("dep_time", "arr_time", F.col("base") + F.col("dep") + F.col("dep_delta"))
    gone = stops.where(F.col("base").isNotNull() & (event > 0) & (event <= now)).groupBy("trip").agg(F.max("pos").alias("by_time"))
    place = [c for c in ("lat_e7", "lon_e7") if c in vehicle.columns]
    seen = vehicle.select("trip", F.col("pos").alias("veh_pos"), "status", F.col("passed").alias("by_vehicle"), *place)
    trips = cancelled.select("trip", "cancelled").join(seen, "trip", "full_outer").join(gone, "trip", "left")
    trips = trips.select("trip", F.coalesce("cancelled", F.lit(False)).alias("cancelled"), F.greatest("by_time", "by_vehicle", F.lit(-1).cast("long")).alias("passed"), "veh_pos", "status", *place)
    return trips, stops.select("trip", "pos", "arr_delta", "dep_delta", "skipped")


def hold_persistence(fixes: DataFrame, condition, seconds: int) -> DataFrame:
    """session_id, since, until, fixes of the stretches over which ``condition`` holds for ``seconds`` at least."""
    by = Window.partitionBy("session_id").orderBy("at", "event_id")
    f = fixes.withColumn("ok", condition)
    f = f.withColumn("island", F.sum((~F.col("ok")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = f.where("ok").groupBy("session_id", "island").agg(F.min("at").alias("since"), F.max("at").alias("until"), F.count(F.lit(1)).alias("fixes"))
    return runs.where(F.col("until") - F.col("since") >= seconds).drop("island")
