"""Routing operators: bounded searches, footpaths, road routes, and rounds of earliest arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize

DAY = 86400


def near_search(edges: DataFrame, seeds: DataFrame, bound: int) -> DataFrame:
    """origin, node, ds of every node within ``bound`` of ``seeds(origin, node, ds)`` over ``edges(src, dst, cost)``.

    Frontier relaxation: a round expands only labels that the round before improved, so it costs as much as
    the frontier; as many rounds run as the longest shortest path inside the bound has edges.
    """
    labels = materialize(seeds.where(F.col("ds") <= bound).groupBy("origin", "node").agg(F.min("ds").alias("ds")), "near")
    front = labels
    while True:
        step = front.join(edges, front["node"] == edges["src"]).select("origin", F.col("dst").alias("node"), (F.col("ds") + F.col("cost")).alias("new"))
        step = step.where(F.col("new") <= bound).groupBy("origin", "node").agg(F.min("new").alias("new"))
        both = materialize(labels.join(step, ["origin", "node"], "full_outer").select("origin", "node", F.least("ds", "new").alias("ds"), (F.col("ds").isNull() | (F.col("new") < F.col("ds"))).alias("better")), "near")
        labels, front = both.select("origin", "node", "ds"), both.where("better").select("origin", "node", "ds")
        if front.isEmpty():
            return labels


def footpaths(reached: DataFrame, anchors: DataFrame) -> DataFrame:
    """from_stop, to_stop, ds from ``reached(origin, node, ds)`` and ``anchors(node, stop, extra)``."""
    hits = reached.join(anchors, "node").where("origin != stop")
    return hits.groupBy(F.col("origin").alias("from_stop"), F.col("stop").alias("to_stop")).agg(F.min(F.col("ds") + F.col("extra")).alias("ds"))


def access(reached: DataFrame, anchors: DataFrame) -> DataFrame:
    """origin, stop, sec: seconds to the stops in reach, rounded half up."""
    hits = reached.join(anchors, "node").groupBy("origin", "stop").agg(F.min(F.col("ds") + F.col("extra")).alias("ds"))
    return hits.select("origin", "stop", F.floor((F.col("ds") + 5) / 10).cast("long").alias("sec"))


def layers(timetable: DataFrame, active: DataFrame, dates: DataFrame) -> DataFrame:
    """Stop times of the running trips of each date and of the night before, which come 24 h earlier.

    ``timetable(trip, pattern, trip_rank, pos, stop_idx, arr, dep, service)``, ``active(date, service)``,
    ``dates(date, previous)``.
    """
    days = dates.select("date", F.col("date").alias("runs"), F.lit(1).alias("layer"), F.lit(0).cast("long").alias("shift"))
    days = days.union(dates.select("date", F.col("previous"), F.lit(0), F.lit(-DAY).cast("long")))
    runs = days.join(active.select(F.col("date").alias("runs"), "service"), "runs").select("date", "layer", "shift", "service")
    t = timetable.join(F.broadcast(runs), "service")  # a row for each date, layer and service in the calendars' range
    return t.select("date", "layer", "pattern", "trip_rank", "trip", "pos", "stop_idx", (F.col("arr") + F.col("shift")).alias("arr"), (F.col("dep") + F.col("shift")).alias("dep"))


def rides(day: DataFrame) -> DataFrame:
    """date, layer, pattern, trip_rank, trip, calls: the stops of a trip in order."""
    return day.groupBy("date", "layer", "pattern", "trip_rank", "trip").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_idx", "arr", "dep"))).alias("calls"))


def boards(ride: DataFrame) -> DataFrame:
    """date, stop, layer, pattern, pos, trips: departures of a pattern at a stop, in trip rank order; none at a trip's last stop."""
    t = ride.select("date", "layer", "pattern", "trip_rank", F.explode(F.slice("calls", F.lit(1), F.size("calls") - 1)).alias("c")).where("c.dep >= 0")
    return t.groupBy("date", F.col("c.stop_idx").alias("stop"), "layer", "pattern", F.col("c.pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("trip_rank", F.col("c.dep").alias("dep")))).alias("trips"))


def asof_board(ready: DataFrame, board: DataFrame) -> DataFrame:
    """The first trip by rank that ``ready(query_id, date, stop, ready)`` catches, for each pattern that calls.

    An equi-join on the stop; the range condition is searched inside the pattern's departures, so the join
    makes no row for trips that are not taken.
    """
    j = ready.join(board, ["date", "stop"]).withColumn("c", F.try_element_at(F.filter("trips", lambda t: t["dep"] >= F.col("ready")), F.lit(1)))
    return j.where("c IS NOT NULL").select(*ready.columns, "layer", "pattern", "pos", F.col("c.trip_rank").alias("trip_rank"), F.col("c.dep").alias("board_dep"))


def scan_order(boarded: DataFrame) -> DataFrame:
    """Boardings that a scan along the pattern takes (G13): those that catch an earlier trip than all boardings before them.

    Any other trip is boarded already, or behind one that is, wherever it goes.
    """
    earlier = Window.partitionBy("query_id", "date", "layer", "pattern").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return boarded.withColumn("__least", F.min("trip_rank").over(earlier)).where("__least IS NULL OR trip_rank < __least").drop("__least")


def ride_expand(boarded: DataFrame, ride: DataFrame) -> DataFrame:
    """A row for each later stop of the boarded trip."""
    later = F.filter("calls", lambda c: (c["pos"] > F.col("board_pos")) & (c["arr"] >= 0))
    keys = ["date", "layer", "pattern", "trip_rank"]
    b = boarded.withColumnRenamed("pos", "board_pos")
    return b.join(ride, keys).withColumn("call", F.explode(later)).drop("calls").select("*", F.col("call.pos").alias("alight_pos"), F.col("call.stop_idx").alias("alight"), F.col("call.arr").alias("alight_arr")).drop("call")


LEG = "array<struct<kind:string,from_stop:bigint,to_stop:bigint,trip:bigint,board_pos:bigint,alight_pos:bigint,dep:bigint,arr:bigint>>"


def _leg(kind: str, frm: Column, to: Column, trip: Column, bpos: Column, apos: Column, dep: Column, arr: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), frm.alias("from_stop"), to.alias("to_stop"), trip.alias("trip"), bpos.alias("board_pos"), apos.alias("alight_pos"), dep.alias("dep"), arr.alias("arr")))


def raptor(sources: DataFrame, targets: DataFrame, board: DataFrame, ride: DataFrame, transfers: DataFrame, max_transfers: int = 4, slack: int = 90) -> DataFrame:
    """query_id, rides, arr, legs: journeys that no journey of fewer rides matches (G12-G14, W10), for all queries at once.

    ``sources(query_id, date, stop, arr)``, ``targets(query_id, stop, egress)``. Round k joins the labels that
    round k-1 improved with departures, trips and footpaths. Slack applies behind a ride only; every stop that
    a ride improves emits footpaths; ties go to (arr, layer, trip_rank, board_pos). Labels and journeys that
    can't beat the stop's or the target's best so far are dropped.
    """
    none = F.array().cast(LEG)
    transfers = materialize(transfers, "raptor-foot")  # read in every round
    null = F.lit(None).cast("long")
    front = materialize(sources.groupBy("query_id", "date", F.col("stop")).agg(F.min("arr").alias("arr")).select("query_id", "date", "stop", "arr", F.lit(False).alias("ride"), none.alias("legs")), "raptor")
    best = front.select("query_id", "stop", "arr")
    journeys = None
    limit = sources.select("query_id").distinct().withColumn("limit", null)
    for k in range(1, max_transfers + 2):
        ready = front.select("query_id", "date", "stop", F.col("arr").alias("at"), (F.col("arr") + F.when(F.col("ride"), slack).otherwise(0)).alias("ready"), "legs")
        # written before it meets the trips: a small table is then sent to them, and they stay where they are
        on = materialize(scan_order(asof_board(ready, board)), "raptor-boarded")
        off = ride_expand(on, ride)
        leg = _leg("ride", F.col("stop"), F.col("alight"), F.col("trip"), F.col("board_pos"), F.col("alight_pos"), F.col("board_dep"), F.col("alight_arr"))
        order = F.struct(F.col("alight_arr").alias("arr"), "layer", "trip_rank", "board_pos", "pattern", F.concat("legs", leg).alias("legs"))
        rode = off.groupBy("query_id", "date", F.col("alight").alias("stop")).agg(F.min(order).alias("m")).select("query_id", "date", "stop", F.col("m.arr").alias("arr"), F.col("m.legs").alias("legs"))
        old = best.withColumnRenamed("arr", "known")
        bounded = lambda d: d.join(old, ["query_id", "stop"], "left").join(limit, "query_id", "left").where("(known IS NULL OR arr < known) AND (limit IS NULL OR arr < limit)").drop("known", "limit")
        rode = materialize(bounded(rode), "raptor")
        x = rode.join(transfers, rode["stop"] == transfers["from_stop"])
        sec = F.expr("ds div 10 + (ds % 10) div 5")
        foot_leg = _leg("foot", F.col("from_stop"), F.col("to_stop"), null, null, null, F.col("arr"), F.col("arr") + sec)
        walked = x.select("query_id", "date", F.col("to_stop").alias("stop"), (F.col("arr") + sec).alias("arr"), F.concat("legs", foot_leg).alias("legs"))
        walked = bounded(walked.groupBy("query_id", "date", "stop").agg(F.min(F.struct("arr", "legs")).alias("m")).select("query_id", "date", "stop", "m.arr", "m.legs"))
        # a footpath replaces a ride's label only when it is earlier
        both = rode.withColumn("foot", F.lit(0)).unionByName(walked.withColumn("foot", F.lit(1)))
        front = both.groupBy("query_id", "date", "stop").agg(F.min(F.struct("arr", "foot", "legs")).alias("m")).select("query_id", "date", "stop", F.col("m.arr").alias("arr"), (F.col("m.foot") == 0).alias("ride"), F.col("m.legs").alias("legs"))
        front = materialize(front, "raptor")
        if front.isEmpty():
            break
        best = materialize(best.unionByName(front.select("query_id", "stop", "arr")).groupBy("query_id", "stop").agg(F.min("arr").alias("arr")), "raptor-best")
        here = front.join(targets, ["query_id", "stop"]).withColumn("total", F.col("arr") + F.col("egress"))
        here = here.groupBy("query_id").agg(F.min(F.struct("total", "stop", "legs")).alias("m")).select("query_id", F.lit(k).cast("long").alias("rides"), F.col("m.total").alias("arr"), F.col("m.legs").alias("legs"))
        here = materialize(here.join(limit, "query_id").where("limit IS NULL OR arr < limit").drop("limit"), "raptor-hits")
        journeys = here if journeys is None else journeys.unionByName(here)
        limit = materialize(limit.join(here.select("query_id", F.col("arr").alias("hit")), "query_id", "left").select("query_id", F.least("limit", "hit").alias("limit")), "raptor-limit")
    if journeys is None:
        return sources.limit(0).select("query_id", F.lit(1).cast("long").alias("rides"), F.col("arr"), none.alias("legs"))
    return journeys


def pareto(journeys: DataFrame) -> DataFrame:
    """Journeys earlier than all with fewer rides."""
    before = F.min("arr").over(Window.partitionBy("query_id").orderBy("rides").rowsBetween(Window.unboundedPreceding, -1))
    return journeys.withColumn("before", before).where("rides > 0 AND (before IS NULL OR arr < before)").drop("before")


def alights(ride: DataFrame) -> DataFrame:
    """date, stop, layer, pattern, pos, trips: arrivals of a pattern at a stop, in trip rank order; none at a trip's first stop."""
    t = ride.select("date", "layer", "pattern", "trip_rank", F.explode(F.slice("calls", F.lit(2), F.size("calls") - 1)).alias("c")).where("c.arr >= 0")
    return t.groupBy("date", F.col("c.stop_idx").alias("stop"), "layer", "pattern", F.col("c.pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("trip_rank", F.col("c.arr").alias("arr")))).alias("trips"))


def latest_departures(ends: DataFrame, alight: DataFrame, ride: DataFrame, transfers: DataFrame, max_transfers: int = 4, slack: int = 90) -> DataFrame:
    """query_id, stop, dep: the latest boarding at each stop that still meets ``ends(query_id, date, stop, by)``.

    Rounds backwards from the deadlines, for all queries at once. A stop may be reached by ride ``slack`` before the
    boarding that follows there, or a footpath before one at its end. The last trip by rank that is in time is taken.
    """
    sec = F.expr("ds div 10 + (ds % 10) div 5")
    transfers = materialize(transfers.select(F.col("from_stop").alias("at"), F.col("to_stop").alias("stop"), sec.alias("sec")), "back-foot")

    def before(rows: DataFrame, wait: int) -> DataFrame:
        walked = rows.join(transfers, "stop").select("query_id", "date", F.col("at").alias("stop"), (F.col("by") - F.col("sec")).alias("by"))
        here = rows.select("query_id", "date", "stop", (F.col("by") - wait).alias("by"))
        return here.unionByName(walked).groupBy("query_id", "date", "stop").agg(F.max("by").alias("by"))

    front = materialize(before(ends.select("query_id", "date", "stop", "by"), 0), "back")
    best: DataFrame | None = None
    for _ in range(max_transfers + 1):
        off = front.join(alight, ["date", "stop"]).withColumn("c", F.try_element_at(F.filter("trips", lambda t: t["arr"] <= F.col("by")), F.lit(-1))).where("c IS NOT NULL")
        # along a pattern, a later alighting is worth its row only with a later trip
        later = Window.partitionBy("query_id", "date", "layer", "pattern").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
        off = off.select("query_id", "date", "layer", "pattern", F.col("pos").alias("off_pos"), "pos", F.col("c.trip_rank").alias("trip_rank")).withColumn("m", F.max("trip_rank").over(later)).where("m IS NULL OR trip_rank > m")
        off = materialize(off.drop("m", "pos"), "back-off")
        calls = off.join(ride, ["date", "layer", "pattern", "trip_rank"]).select("query_id", "date", "off_pos", F.explode("calls").alias("c")).where("c.pos < off_pos AND c.dep >= 0")
        new = calls.groupBy("query_id", "date", F.col("c.stop_idx").alias("stop")).agg(F.max("c.dep").alias("dep"))
        if best is not None:
            new = new.join(best.withColumnRenamed("dep", "known"), ["query_id", "stop"], "left").where("known IS NULL OR dep > known").drop("known")
        new = materialize(new, "back-new")
        if new.isEmpty():
            break
        own = new.select("query_id", "stop", "dep")
        best = materialize((own if best is None else best.unionByName(own)).groupBy("query_id", "stop").agg(F.max("dep").alias("dep")), "back-best")
        front = materialize(before(new.withColumnRenamed("dep", "by"), slack), "back")
    return ends.limit(0).select("query_id", "stop", F.col("by").alias("dep")) if best is None else best


#: How many steps back a departure is looked for at a time, where the latest one that could do misses its deadline.
STEPS_BACK = (0, 16, 80, 400, 1600)


def arrive_by(requests: DataFrame, latest: DataFrame, plan, step: int = 60) -> DataFrame:
    """query_id, dep_sec, arr: the latest departure, a whole number of ``step`` seconds before the deadline, that meets it.

    ``requests(query_id, date, stop, deadline, ...)``, ``latest(query_id, stop, dep)`` from :func:`latest_departures`,
    which no departure is later than; ``plan`` answers a batch of requests with dep_sec. A plan keeps one label for a
    stop and trips may overtake, so a departure that could do may miss its deadline: such requests try all steps back
    from there, some at a time, down to midnight.
    """
    back = F.greatest(F.ceil((F.col("deadline") - F.col("dep")) / step).cast("long"), F.lit(0))
    todo = materialize(requests.join(latest, ["query_id", "stop"]).withColumn("last", F.col("deadline") - back * step).drop("dep"), "arrive-by")
    found: DataFrame | None = None
    wide = STEPS_BACK[-1] + 1
    for n, most in enumerate(STEPS_BACK):
        tries = todo.withColumn("k", F.explode(F.sequence(F.lit(STEPS_BACK[n - 1] + 1 if n else 0), F.lit(most)))).withColumn("dep_sec", F.col("last") - F.col("k") * step).where("dep_sec >= 0")
        tries = materialize(tries.withColumn("asked", F.col("query_id")).withColumn("query_id", F.col("asked") * wide + F.col("k")), "arrive-by")
        got = plan(tries).groupBy("query_id").agg(F.min("arr").alias("arr"))
        hits = tries.join(got, "query_id").where("arr <= deadline").groupBy("asked").agg(F.max(F.struct("dep_sec", "arr")).alias("m"))
        hits = materialize(hits.select(F.col("asked").alias("query_id"), "m.*"), "arrive-by")
        found = hits if found is None else found.unionByName(hits)
        todo = materialize(todo.join(hits.select("query_id"), "query_id", "left_anti").where(F.col("last") >= (most + 1) * step), "arrive-by")
        if todo.isEmpty():
            break
    return found
