"""Rules of live journeys as batch operators: service days, rides of legs, vehicles, deviations, guards, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .itineraries import is_metro

#: Seconds after which a fix is no evidence, a fix may lie ahead, and metres of accuracy that are too many.
STALE, AHEAD, ACCURACY = 45, 30, 150.0
#: Base radii in metres on a vehicle, off it, near a stop, off the route; the error of a vehicle's position.
ON_VEHICLE, OFF_VEHICLE, NEAR_STOP, OFF_ROUTE, VEHICLE_ERROR = 55.0, 130.0, 40.0, 300.0, 30.0
#: Seconds that a state must hold for a missed alighting, a vehicle left early, a left route.
MISSED_HOLD, LEFT_HOLD, OFF_HOLD = 45, 35, 90
#: Seconds behind the terminus departure without a trace, and before a departure without confirmation.
BLIND, CONFIRM = 180, 600
#: Seconds that an itinerary's token lives, and how many are kept before old ones go.
TOKEN_TTL, TOKENS = 1800, 4096


def local_midnight(epoch: Column, zone: str) -> Column:
    """Epoch of the midnight that begins the local day of ``epoch``."""
    day = F.date_trunc("day", F.from_utc_timestamp(F.timestamp_seconds(epoch), zone))
    return F.unix_timestamp(F.to_utc_timestamp(day, zone))


def service_base(start_date: Column, now: Column, zone: str) -> Column:
    """Epoch of the midnight of a trip's service day (F18): its date yyyymmdd if that is one, else the local day of ``now``."""
    day = F.when(start_date.rlike("^[0-9]{8}$") & (F.substring(start_date, 1, 4) > "2000"), F.try_to_timestamp(start_date, F.lit("yyyyMMdd")))
    return F.coalesce(F.unix_timestamp(F.to_utc_timestamp(day, zone)), local_midnight(now, zone))


def ride_base(departure: Column, scheduled: Column, zone: str) -> Column:
    """Midnight of the ride's service day (F19): that of the departure's day, the day before or the next, whichever brings
    the scheduled seconds nearest to it; in ties this day, then the one before."""
    here = F.date_trunc("day", F.from_utc_timestamp(F.timestamp_seconds(departure), zone))
    base = lambda days: F.unix_timestamp(F.to_utc_timestamp(F.date_add(here, days).cast("timestamp"), zone))
    each = [F.struct(F.abs(base(d) + scheduled - departure).alias("off"), F.lit(i).alias("order"), base(d).alias("base")) for i, d in enumerate((0, -1, 1))]
    return F.array_min(F.array(*each))["base"]


def signature(mode: Column, trip: Column, from_stop: Column, to_stop: Column, from_lat: Column, from_lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """What two legs have in common when they are the same (F21): trip and stops of a ride, else mode and rounded ends."""
    return F.when(mode == "transit", F.concat_ws("|", F.lit("t"), trip, from_stop, to_stop)).otherwise(F.format_string("%s|%.4f,%.4f|%.4f,%.4f", mode, from_lat, from_lon, to_lat, to_lon))


def virtual_point(mode: Column, depart: Column, arrive: Column, now: Column, a: Column, b: Column) -> Column:
    """One coordinate of where a traveller is by plan (F22): on a straight line between a leg's ends, at its stop before a ride."""
    part = F.when(arrive > depart, (now - depart) / (arrive - depart)).otherwise(0.0)
    return F.when((mode == "transit") | (part <= 0), a).when(part >= 1, b).otherwise(a + (b - a) * part)


def resolve_rides(legs: DataFrame, calls: DataFrame) -> DataFrame:
    """leg, trip, board, alight of ``legs(leg, trip, from_stop, to_stop)`` in ``calls(trip, pos, stop)``.

    The first call at the boarding stop counts, and the first one behind it at the other; legs without both are left out.
    """
    on = legs.join(calls.select("trip", F.col("stop").alias("from_stop"), F.col("pos").alias("board")), ["trip", "from_stop"])
    on = on.groupBy("leg", "trip", "to_stop").agg(F.min("board").alias("board"))
    off = on.join(calls.select("trip", F.col("stop").alias("to_stop"), F.col("pos").alias("alight")), ["trip", "to_stop"]).where("alight > board")
    return off.groupBy("leg", "trip", "board").agg(F.min("alight").alias("alight"))


def walk_seconds(legs: DataFrame) -> DataFrame:
    """query_id, itinerary, walk: seconds off vehicles."""
    return legs.groupBy("query_id", "itinerary").agg(F.coalesce(F.sum(F.when(F.col("mode") != "transit", F.col("duration"))), F.lit(0)).cast("long").alias("walk"))


def plausible(fixes: DataFrame) -> DataFrame:
    """Fixes of ``fixes(session_id, event_id, at, received, lat_e7, lon_e7, accuracy)`` that are evidence, with their time.

    A time that is missing or lies ahead becomes that of receipt; fixes without a place, too inaccurate, stale, or older
    than one accepted before are left out.
    """
    at = F.when(F.col("at").isNull() | (F.col("at") > F.col("received") + AHEAD), F.col("received")).otherwise(F.col("at"))
    f = fixes.withColumn("at", at).where(~((F.col("lat_e7") == 0) & (F.col("lon_e7") == 0)) & (F.col("accuracy") <= ACCURACY) & (F.col("received") - F.col("at") <= STALE))
    before = F.max("at").over(Window.partitionBy("session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return f.withColumn("__before", before).where("__before IS NULL OR at >= __before").drop("__before")


def vehicle_place(vehicles: DataFrame, calls: DataFrame) -> DataFrame:
    """trip, pos, status, lat_e7, lon_e7: vehicles without coordinates stand at their stop (P22); without both they are left out.

    ``vehicles(trip, pos, status, lat_e7, lon_e7)``, ``calls(trip, pos, lat_e7, lon_e7)``.
    """
    at = calls.select("trip", "pos", F.col("lat_e7").alias("s_lat"), F.col("lon_e7").alias("s_lon"))
    bare = (F.coalesce("lat_e7", F.lit(0)) == 0) & (F.coalesce("lon_e7", F.lit(0)) == 0)
    j = vehicles.join(at, ["trip", "pos"], "left")
    return j.select("trip", "pos", "status", F.when(bare, F.col("s_lat")).otherwise(F.col("lat_e7")).alias("lat_e7"), F.when(bare, F.col("s_lon")).otherwise(F.col("lon_e7")).alias("lon_e7")).where("lat_e7 IS NOT NULL")


def with_vehicle(lat: Column, lon: Column, v_lat: Column, v_lon: Column, accuracy: Column) -> Column:
    """Whether a fix is near a vehicle, both errors allowed for (P22); coordinates in degrees."""
    return geo.haversine_degrees(lat, lon, v_lat, v_lon) <= ON_VEHICLE + F.least(accuracy, F.lit(60.0)) + VEHICLE_ERROR


def vehicle_events(states: DataFrame) -> DataFrame:
    """Events of the vehicle next relevant to each session (X4): the first ride ahead, and only what changed.

    ``states(session_id, at, leg, trip, boarded, board, alight, pos, status, lat_e7, lon_e7, delay)`` has a row for each
    ride ahead of a session at a time; vehicles without a position have none. stops_away counts to the alighting
    on board, else to the boarding, and is never negative.
    """
    first = Window.partitionBy("session_id", "at").orderBy("leg")
    away = F.greatest(F.when(F.col("boarded"), F.col("alight")).otherwise(F.col("board")) - F.col("pos"), F.lit(0).cast("long"))
    word = F.element_at(F.create_map(F.lit(0), F.lit("incoming_at"), F.lit(1), F.lit("stopped_at"), F.lit(2), F.lit("in_transit_to")), F.col("status").cast("int"))
    s = states.withColumn("__n", F.row_number().over(first)).where("__n = 1 AND pos IS NOT NULL")
    s = s.select("session_id", "at", "leg", "trip", "boarded", F.coalesce(word, F.lit("unknown")).alias("status"), away.alias("stops_away"), "lat_e7", "lon_e7", "delay")
    seen = F.struct("boarded", "status", "stops_away", "lat_e7", "lon_e7", "delay")
    last = F.lag(seen).over(Window.partitionBy("session_id").orderBy("at"))
    return s.withColumn("__last", last).where(F.col("__last").isNull() | (F.col("__last") != seen)).drop("__last")


def _first_held(df: DataFrame, condition: Column, seconds: int, also: Column) -> DataFrame:
    """session_id, leg, at: the first row of each leg at which ``condition`` has held for ``seconds`` and ``also`` holds."""
    by = Window.partitionBy("session_id", "leg").orderBy("at", "event_id")
    f = df.withColumn("__ok", F.coalesce(condition, F.lit(False)))
    f = f.withColumn("__island", F.sum((~F.col("__ok")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min("at").over(Window.partitionBy("session_id", "leg", "__island"))
    f = f.where("__ok").withColumn("__since", since).where((F.col("at") - F.col("__since") >= seconds) & F.coalesce(also, F.lit(True)))
    return f.groupBy("session_id", "leg").agg(F.min("at").alias("at"))


def deviations(fixes: DataFrame) -> DataFrame:
    """session_id, leg, at, kind: departures from the plan that are certain, once a leg each.

    ``fixes(session_id, leg, at, event_id, mode, boarded, passed, alight, accuracy, to_vehicle, to_stop, to_route)``: distances
    in metres to the vehicle, the alighting stop and the nearest part of the plan; passed is the last call that the
    feed confirms.

    missed_alight: on board, with the vehicle, and it has passed the stop, or stands there for long.
    left_vehicle_early: clearly apart from a vehicle that hasn't reached the stop, for long, and not at the stop.
    off_route: on foot or waiting, far from all of the plan, for long.
    """
    riding = fixes.where("mode = 'transit' AND boarded")
    acc = F.least("accuracy", F.lit(60.0))
    near = F.col("to_vehicle") <= ON_VEHICLE + acc + VEHICLE_ERROR
    beyond = riding.where(near & (F.col("passed") > F.col("alight"))).groupBy("session_id", "leg").agg(F.min("at").alias("at"))
    stood = _first_held(riding, near & (F.col("passed") >= F.col("alight")), MISSED_HOLD, F.lit(True))
    missed = beyond.union(stood).groupBy("session_id", "leg").agg(F.min("at").alias("at")).withColumn("kind", F.lit("missed_alight"))
    ahead = riding.where("passed >= 0 AND passed < alight AND to_vehicle IS NOT NULL")
    left = _first_held(ahead, F.col("to_vehicle") >= OFF_VEHICLE + acc + VEHICLE_ERROR, LEFT_HOLD, F.col("to_stop") > NEAR_STOP + acc).withColumn("kind", F.lit("left_vehicle_early"))
    foot = fixes.where("NOT (mode = 'transit' AND boarded)")
    off = _first_held(foot, F.col("to_route") > OFF_ROUTE + acc, OFF_HOLD, F.lit(True)).withColumn("kind", F.lit("off_route"))
    return missed.unionByName(left).unionByName(off)


def schedule_guard(legs: DataFrame) -> DataFrame:
    """session_id, leg, kind: the nearest boarding without confirmation.

    ``legs(session_id, leg, now, mode, route_type, boarded, has_rt, fresh, terminus_dep, depart)`` holds the legs ahead;
    metros never have updates, and feeds that aren't fresh tell nothing. A trip that should be under way is
    possibly cancelled, one that leaves soon has no signal; of later ones nothing is said.
    """
    open_ = legs.where((F.col("mode") == "transit") & ~F.col("boarded") & ~is_metro(F.col("route_type")) & ~F.col("has_rt") & F.col("fresh"))
    first = open_.withColumn("__n", F.row_number().over(Window.partitionBy("session_id").orderBy("leg"))).where("__n = 1")
    kind = F.when(F.col("now") > F.col("terminus_dep") + BLIND, "possibly_cancelled").when(F.col("depart") - F.col("now") <= CONFIRM, "no_rt_signal")
    return first.select("session_id", "leg", kind.alias("kind")).where("kind IS NOT NULL")


def reroute_allowed(legs: DataFrame) -> DataFrame:
    """session_id, allowed: live sessions always, others where the next ride is a metro or has updates.

    ``legs(session_id, leg, live_mode, mode, route_type, has_rt)`` holds the legs ahead.
    """
    rides = legs.where("mode = 'transit'").groupBy("session_id").agg(F.min_by(is_metro(F.col("route_type")) | F.col("has_rt"), "leg").alias("ground"))
    modes = legs.groupBy("session_id").agg(F.bool_or("live_mode").alias("live_mode"))
    return modes.join(rides, "session_id", "left").select("session_id", (F.col("live_mode") | F.coalesce("ground", F.lit(False))).alias("allowed"))


def replan_points(sessions: DataFrame) -> DataFrame:
    """session_id, lat, lon, arrive: where a new plan starts, and the arrival that it must beat.

    The fix while it is fresh, else the planned place; the last arrival that was told, else the plan's.
    ``sessions(session_id, now, fix_at, fix_lat, fix_lon, plan_lat, plan_lon, told_arrive, plan_arrive)``.
    """
    fresh = F.coalesce(F.col("now") - F.col("fix_at") <= STALE, F.lit(False))
    pick = lambda c: F.when(fresh, F.col(f"fix_{c}")).otherwise(F.col(f"plan_{c}")).alias(c)
    return sessions.select("session_id", pick("lat"), pick("lon"), F.coalesce("told_arrive", "plan_arrive").alias("arrive"))


def better_arrival(sessions: DataFrame, cooldown: int = 180, saving: int = 300, imminent: int = 180, gone: int = 60) -> DataFrame:
    """session_id, saves: offers worth a change (X8): early by ``saving``, not within ``cooldown`` of the last change, and
    not while a departure that waits to be boarded is at most ``imminent`` seconds ahead or less than ``gone`` behind.

    ``sessions(session_id, now, last_change, next_depart, arrive, offer)``; next_depart is null on board.
    """
    soon = (F.col("next_depart") - F.col("now") <= imminent) & (F.col("next_depart") > F.col("now") - gone)
    ok = (F.col("arrive") - F.col("offer") >= saving) & F.coalesce(F.col("now") - F.col("last_change") >= cooldown, F.lit(True)) & ~F.coalesce(soon, F.lit(False))
    return sessions.where(ok).select("session_id", (F.col("arrive") - F.col("offer")).alias("saves"))


def tokens(itineraries: DataFrame, now: int, salt: str = "") -> DataFrame:
    """``itineraries(query_id, itinerary, ...)`` with ``token`` and ``created`` (G22). A token is drawn from both ids, time and salt."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), F.lit(now).cast("string"), F.col("query_id").cast("string"), F.col("itinerary").cast("string")), 256)
    return itineraries.withColumn("token", F.concat(F.lit("it_"), F.substring(digest, 1, 16))).withColumn("created", F.lit(now).cast("long"))


def remember(cache: DataFrame, new: DataFrame, now: int, most: int = TOKENS) -> DataFrame:
    """The cache with ``new`` tokens; old ones go once more than ``most`` are kept."""
    kept = cache.where(F.col("created") >= now - TOKEN_TTL) if cache.limit(most + 1).count() > most else cache
    return kept.unionByName(new.select(*cache.columns))


def look_up(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the cache for ``asked(token, now)`` that have not run out."""
    return asked.join(cache, "token").where(F.col("now") - F.col("created") <= TOKEN_TTL)


def feed_status(entities: DataFrame, trips: DataFrame, now: int, window: int = 300) -> DataFrame:
    """source, kind, entities, matched, unmatched, cancelled, last_ts, fresh of ``entities(source, kind, trip, cancelled, feed_ts)``."""
    known = trips.select("trip", F.lit(True).alias("__known"))
    hit = F.coalesce("__known", F.lit(False))
    g = entities.join(known, "trip", "left").groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"),
        F.count_if(hit & F.coalesce("cancelled", F.lit(False))).alias("cancelled"), F.max("feed_ts").alias("last_ts"),
    )
    return g.withColumn("fresh", F.coalesce(F.lit(now) - F.col("last_ts") <= window, F.lit(False)))


def network_zone(feeds: DataFrame) -> DataFrame:
    """zone: that of the first feed by order that names one, else UTC (P21); ``feeds(ord, zone)``."""
    return feeds.agg(F.coalesce(F.min_by("zone", F.when(F.col("zone").isNotNull() & (F.col("zone") != ""), F.col("ord"))), F.lit("UTC")).alias("zone"))


def first_warnings(warnings: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` of ``warnings(feed, ord, text)`` for each feed (A16), and how many there are."""
    by = Window.partitionBy("feed")
    w = warnings.withColumn("n", F.row_number().over(by.orderBy("ord"))).withColumn("of", F.count(F.lit(1)).over(by))
    return w.where(F.col("n") <= most).select("feed", F.col("n").cast("long").alias("n"), "text", "of")
