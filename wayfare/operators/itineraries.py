"""Itinerary operators: signatures, ranking, gates, liveness, changed legs, transit legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(mode: Column, trip: Column, frm: Column, to: Column) -> Column:
    """What makes two legs the same: trip and stops of a ride, mode and places of any other."""
    return F.concat_ws("|", F.coalesce(F.when(mode == "transit", trip.cast("string")), mode), frm.cast("string"), to.cast("string"))


def top_itineraries(itineraries: DataFrame, num: int = 4) -> DataFrame:
    """``itineraries(query_id, itinerary, sig, arrive, transfers)``: the first of each signature, best ``num`` by arrival and transfers (O1)."""
    order = [F.col("arrive"), F.col("transfers"), F.col("itinerary")]
    once = itineraries.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "sig").orderBy(*order))).where("__n = 1").drop("__n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return once.withColumn("rank", rank.cast("long")).where(F.col("rank") <= num)


def bike_gate(candidates: DataFrame, min_saving: int = 300, longest: int = 2700, slower: int = 600) -> DataFrame:
    """Variants of ``candidates(query_id, itinerary, variant, arrive, duration)`` that are worth offering.

    A variant with a bike must save ``min_saving`` against the best walk-and-ride arrival; a direct bike ride
    may take ``longest`` and arrive ``slower`` than it. Where nothing is walked to, all variants stay.
    """
    best = candidates.where("variant = 'walk'").groupBy("query_id").agg(F.min("arrive").alias("best"))
    c = candidates.join(best, "query_id", "left")
    bike = F.col("best").isNull() | (F.col("arrive") + min_saving <= F.col("best"))
    direct = (F.col("duration") <= longest) & (F.col("best").isNull() | (F.col("arrive") <= F.col("best") + slower))
    return c.where((F.col("variant") == "walk") | (F.col("variant").isin("bike_walk", "walk_bike") & bike) | ((F.col("variant") == "bike") & direct)).drop("best")


def is_metro(route_type: Column) -> Column:
    return (route_type == 1) | route_type.between(400, 404)


def live(legs: DataFrame, first_within: int = 2700, horizon: int = 3600) -> DataFrame:
    """query_id, itinerary, live of ``legs(query_id, itinerary, leg, mode, route_type, realtime, dep, asked)``.

    The first ride must run on realtime or metro and leave within ``first_within``; rides within ``horizon``
    must too; an itinerary without rides is live.
    """
    rides = legs.where("mode = 'transit'")
    order = Window.partitionBy("query_id", "itinerary").orderBy("leg")
    eligible = F.col("realtime") | is_metro(F.col("route_type"))
    r = rides.withColumn("n", F.row_number().over(order)).withColumn("lead", F.col("dep") - F.col("asked"))
    ok = F.when(F.col("n") == 1, eligible & (F.col("lead") <= first_within)).otherwise(eligible | (F.col("lead") > horizon))
    judged = r.groupBy("query_id", "itinerary").agg(F.bool_and(ok).alias("live"))
    return legs.select("query_id", "itinerary").distinct().join(judged, ["query_id", "itinerary"], "left").select("query_id", "itinerary", F.coalesce("live", F.lit(True)).alias("live"))


def changed_legs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Legs of ``new(session_id, leg, sig)`` whose signature the old itinerary has not."""
    return new.join(old.select("session_id", "sig"), ["session_id", "sig"], "left_anti")


def pick_best(itineraries: DataFrame) -> DataFrame:
    """The itinerary that a pairwise comparison in order prefers (O5, X12): the lesser class (0 live where that is wanted,
    1 a first ride with updates or no ride, 2 else), then an arrival more than 60 s earlier, then less walking. The
    comparison isn't transitive, so it is a fold, not a sort. ``itineraries(query_id, itinerary, class, arrive, walk)``."""
    g = itineraries.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("itinerary", "class", "arrive", "walk"))).alias("all"))

    def better(s: Column, x: Column) -> Column:
        d = x["arrive"] - s["arrive"]
        win = F.when(x["class"] != s["class"], x["class"] < s["class"]).when(F.abs(d) > 60, d < 0).otherwise(x["walk"] < s["walk"])
        return F.when(win, x).otherwise(s)

    return g.select("query_id", F.aggregate(F.slice("all", 2, F.size("all")), F.element_at("all", 1), better).alias("b")).select("query_id", "b.*")


def live_subset(itineraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The live ones of ``itineraries(query_id, live, ...)``, and the requests that have none."""
    some = itineraries.where("live")
    return some, itineraries.select("query_id").distinct().join(some.select("query_id"), "query_id", "left_anti")


def place(lat_e7: Column, lon_e7: Column) -> list[Column]:
    """lat and lon in degrees."""
    return [(lat_e7 / F.lit(1e7)).alias("lat"), (lon_e7 / F.lit(1e7)).alias("lon")]


def step_display(meters: Column, ds: Column) -> list[Column]:
    """Whole metres and whole seconds, cut off."""
    return [F.floor(meters).cast("long").alias("distance_m"), F.floor(ds / 10).cast("long").alias("duration_s")]


def transit_legs(journeys: DataFrame, day: DataFrame, stops: DataFrame) -> DataFrame:
    """Calls of each ride of ``journeys(query_id, rides, legs)`` with stop names and times."""
    l = journeys.select("query_id", "rides", F.posexplode("legs").alias("leg", "l")).where("l.kind = 'ride'")
    l = l.select("query_id", "rides", F.col("leg").cast("long").alias("leg"), "l.trip", "l.board_pos", "l.alight_pos", F.col("l.dep").alias("board_dep"))
    calls = l.join(day.select("trip", "pos", "stop_idx", "arr", "dep", "layer"), "trip").where("pos BETWEEN board_pos AND alight_pos")
    shift = Window.partitionBy("query_id", "rides", "leg", "layer")
    same = F.max(F.when(F.col("pos") == F.col("board_pos"), F.col("dep"))).over(shift) == F.col("board_dep")
    return calls.withColumn("same", same).where("same").join(stops.select("stop_idx", "name", "lat_e7", "lon_e7"), "stop_idx").select("query_id", "rides", "leg", "trip", "pos", "stop_idx", "name", "arr", "dep", "lat_e7", "lon_e7")


def assemble(journeys: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id, rides, depart, arrive, duration, walk, transfers, legs: whole itineraries.

    ``journeys(query_id, rides, arr, legs)``, ``requests(query_id, dep_sec, access_sec, egress_sec)``. The way to the first
    stop leaves as late as its ride lets it, but not before the request; footpaths follow the ride before them, and the
    way from the last stop ends the itinerary. Legs hold mode, stops, trip, depart, arrive; ways of no time are left out.
    """
    j = journeys.join(requests.select("query_id", "dep_sec", "access_sec", "egress_sec"), "query_id")
    null = F.lit(None).cast("long")
    leg = lambda mode, frm, to, trip, dep, arr: F.struct(F.lit(mode).alias("mode") if isinstance(mode, str) else mode.alias("mode"), frm.alias("from_stop"), to.alias("to_stop"), trip.alias("trip"), dep.cast("long").alias("depart"), arr.cast("long").alias("arrive"))
    first, last = F.element_at("legs", 1), F.element_at("legs", -1)
    leave = F.greatest(F.col("dep_sec"), first["dep"] - F.col("access_sec"))
    access = F.when(F.col("access_sec") > 0, F.array(leg("walk", null, first["from_stop"], null, leave, leave + F.col("access_sec")))).otherwise(F.array())
    egress = F.when(F.col("egress_sec") > 0, F.array(leg("walk", last["to_stop"], null, null, last["arr"], last["arr"] + F.col("egress_sec")))).otherwise(F.array())
    middle = F.transform("legs", lambda l: leg(F.when(l["kind"] == "ride", "transit").otherwise("walk"), l["from_stop"], l["to_stop"], l["trip"], l["dep"], l["arr"]))
    j = j.withColumn("legs", F.concat(access, middle, egress))
    walk = F.aggregate(F.filter("legs", lambda l: l["mode"] == "walk"), F.lit(0).cast("long"), lambda s, l: s + l["arrive"] - l["depart"])
    depart, arrive = F.element_at("legs", 1)["depart"], F.element_at("legs", -1)["arrive"]
    return j.select("query_id", "rides", depart.alias("depart"), arrive.alias("arrive"), (arrive - depart).alias("duration"), walk.alias("walk"), (F.col("rides") - 1).alias("transfers"), "legs")


def leg_delays(legs: DataFrame, overlay: DataFrame) -> DataFrame:
    """Adds dep_delay, arr_delay and realtime to ``legs(trip, board_pos, alight_pos, ...)`` from ``overlay(trip, pos, arr_delta, dep_delta)``."""
    at = lambda p, c: overlay.select("trip", F.col("pos").alias(p), F.col(c).alias(f"{c[:3]}_delay"))
    j = legs.join(at("board_pos", "dep_delta"), ["trip", "board_pos"], "left").join(at("alight_pos", "arr_delta"), ["trip", "alight_pos"], "left")
    return j.withColumn("realtime", F.col("dep_delay").isNotNull() | F.col("arr_delay").isNotNull())
