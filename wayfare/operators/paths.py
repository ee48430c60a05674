"""Street paths: seeds from snapped points, routes, path reconstruction, geometry, legs, and footpaths built from stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..store import materialize
from . import routing, street

#: Greatest number of deciseconds that an anchor or a footpath holds.
MOST = 65535


def partial_cost(meters: Column, speed: Column, mode: str, factor: int = 0) -> Column:
    """Deciseconds along a part of an edge (P6): whole metres; cars at the edge's speed, others by a 16-bit factor."""
    if mode == "car":
        return F.floor(F.floor(meters * 36) / F.when(speed == 0, F.lit(30)).otherwise(speed)).cast("long")
    return F.shiftright(F.floor(meters).cast("long") * factor, 16)


def clamped(ds: Column) -> Column:
    """Deciseconds cut off at 16 bits."""
    return F.least(ds, F.lit(MOST).cast("long"))


def seeds(snaps: DataFrame, edges: DataFrame, twins: DataFrame, bits: int, mode: str, factor: int = 0, leaving: bool = True) -> DataFrame:
    """point, node, ds: where a search leaves or reaches ``snaps(point, edge, src, dst, along_u, along_v, perp)``.

    The edge itself leaves over its end and its twin over its beginning, each if it carries the mode; where neither
    does, both ends count. ``edges(edge, flags, speed)``, ``twins(edge, twin)``.
    """
    has = lambda c: F.coalesce(F.col(c).bitwiseAND(F.lit(bits)) != 0, F.lit(False))
    own = edges.select("edge", F.col("flags").alias("f_flags"), F.col("speed").alias("f_speed"))
    other = twins.join(edges.select(F.col("edge").alias("twin"), F.col("flags").alias("t_flags"), F.col("speed").alias("t_speed")), "twin").drop("twin")
    s = snaps.join(own, "edge").join(other, "edge", "left").withColumn("fwd", has("f_flags")).withColumn("bwd", has("t_flags"))
    cost = lambda along, speed: partial_cost(F.col(along) + F.col("perp"), F.col(speed), mode, factor)
    far, near = (("dst", "along_v"), ("src", "along_u")) if leaving else (("src", "along_u"), ("dst", "along_v"))
    neither = ~F.col("fwd") & ~F.col("bwd")
    ways = [(F.col("fwd"), *far, "f_speed"), (F.col("bwd"), *near, "t_speed"), (neither, "src", "along_u", "f_speed"), (neither, "dst", "along_v", "f_speed")]
    each = F.array(*[F.when(ok, F.struct(F.col(node).alias("node"), cost(along, speed).alias("ds"))) for ok, node, along, speed in ways])
    found = s.select("point", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    return found.groupBy("point", F.col("x.node").alias("node")).agg(F.min("x.ds").alias("ds"))


def routes(edges: DataFrame, starts: DataFrame, ends: DataFrame, bound: int = 6000) -> tuple[DataFrame, DataFrame]:
    """Cheapest ways of all requests over ``edges(edge, src, dst, cost)`` (G7), and the labels that they were found in.

    ``starts(request, node, ds)``, ``ends(request, node, ds)``. The first table holds request, node (the end's), ds in
    all; the second origin, node, ds. Searches are bounded, and requests without a way inside the bound try one four
    times as far, until their labels fill what can be reached: what lies outside a bound is dearer than all inside.
    """
    todo = starts.select(F.col("request").alias("origin"), "node", "ds")
    ends = materialize(ends, "route-ends")
    found: DataFrame | None = None
    kept: DataFrame | None = None
    before: DataFrame | None = None
    while True:
        labels = routing.near_search(edges.select("src", "dst", "cost"), todo, bound)
        hits = labels.join(ends.select(F.col("request").alias("origin"), "node", F.col("ds").alias("last")), ["origin", "node"])
        best = hits.groupBy("origin").agg(F.min(F.struct((F.col("ds") + F.col("last")).alias("ds"), "node")).alias("m"))
        size = labels.groupBy("origin").agg(F.count(F.lit(1)).alias("size"))
        state = todo.select("origin").distinct().join(size, "origin", "left").join(best, "origin", "left")
        grown = F.lit(True)
        if before is not None:
            state = state.join(before, "origin", "left")
            grown = F.coalesce("size", F.lit(0)) > F.coalesce("old", F.lit(-1))
        state = materialize(state.select("origin", "size", "m", ((F.col("m.ds") <= bound) | ~grown).alias("over")), "route-state")
        done = state.where("over")
        way = done.where("m IS NOT NULL").select(F.col("origin").alias("request"), F.col("m.node").alias("node"), F.col("m.ds").alias("ds"))
        own = labels.join(done.select("origin"), "origin", "left_semi")
        found, kept = (way, own) if found is None else (found.unionByName(way), kept.unionByName(own))
        rest = state.where("NOT coalesce(over, false)")
        if rest.isEmpty():
            return found, kept
        before = rest.select("origin", F.col("size").alias("old"))
        todo = labels.join(rest.select("origin"), "origin", "left_semi")  # the search goes on where it ended
        bound *= 4


def predecessors(labels: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds ``edge`` and ``before`` to ``labels(origin, node, ds)``: the least edge that a cheapest way comes by, none at a start."""
    a = labels.select("origin", F.col("node").alias("src"), F.col("ds").alias("from_ds"))
    tight = a.join(edges.select("edge", "src", "dst", "cost"), "src").select("origin", F.col("dst").alias("node"), (F.col("from_ds") + F.col("cost")).alias("ds"), "edge", F.col("src").alias("before"))
    best = tight.groupBy("origin", "node", "ds").agg(F.min(F.struct("edge", "before")).alias("m"))
    first = starts.select(F.col("request").alias("origin"), "node", "ds", F.lit(True).alias("start")).distinct()
    j = labels.join(best, ["origin", "node", "ds"], "left").join(first, ["origin", "node", "ds"], "left")
    pick = lambda c: F.when(F.col("start").isNull(), F.col(f"m.{c}")).alias(c)
    return j.select("origin", "node", "ds", pick("edge"), pick("before"))


def path_edges(reached: DataFrame, found: DataFrame) -> DataFrame:
    """request, pos, edge: the edges of each way of ``found(request, node)`` in order.

    ``reached(origin, node, ds, edge, before)``. Jumps over 1, 2, 4, ... nodes back are tables; taken from the longest
    to the shortest they mark every node of a way, so a way of n edges takes 2 log n joins.
    """
    step = materialize(reached.where("edge IS NOT NULL").select("origin", "node", F.col("before").alias("to")), "path-jump")
    jumps = []
    while not step.isEmpty():
        jumps.append(step)
        step = materialize(step.join(step.select("origin", F.col("node").alias("to"), F.col("to").alias("far")), ["origin", "to"]).select("origin", "node", F.col("far").alias("to")), "path-jump")
    on = found.select(F.col("request").alias("origin"), "node")
    for jump in reversed(jumps):
        on = materialize(on.union(on.join(jump, ["origin", "node"]).select("origin", F.col("to").alias("node"))).distinct(), "path-nodes")
    rows = on.join(reached.where("edge IS NOT NULL"), ["origin", "node"])
    return rows.select(F.col("origin").alias("request"), (F.row_number().over(Window.partitionBy("origin").orderBy("ds")) - 1).cast("long").alias("pos"), "edge")


def reverse_path(path: DataFrame, twins: DataFrame) -> DataFrame:
    """``path(request, pos, edge)`` the other way (G10); ways with an edge that has no twin are left out."""
    j = path.join(twins, "edge", "left")
    every = Window.partitionBy("request")
    j = j.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("have", F.count("twin").over(every)).where("n = have")
    return j.select("request", (F.col("n") - 1 - F.col("pos")).alias("pos"), F.col("twin").alias("edge"))


def path_geometry(path: DataFrame, geometry: DataFrame) -> DataFrame:
    """request, pts: the points of each way (G11); an edge's first point is its predecessor's last one.

    ``geometry(edge, pts)`` with pts an array of structs of lat_e7 and lon_e7.
    """
    g = path.join(geometry, "edge").groupBy("request").agg(F.array_sort(F.collect_list(F.struct("pos", "pts"))).alias("all"))
    return g.select("request", F.flatten(F.transform("all", lambda x, i: F.when(i == 0, x["pts"]).otherwise(F.slice(x["pts"], F.lit(2), F.size(x["pts"]))))).alias("pts"))


def straight_leg(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Whole metres of a leg without streets."""
    return F.floor(geo.distance(a_lat, a_lon, b_lat, b_lon)).cast("long")


def road_legs(requests: DataFrame, edges: DataFrame, nodes: DataFrame, twins: DataFrame, bits: int, mode: str, factor: int = 0, radius_m: float = 300) -> tuple[DataFrame, DataFrame]:
    """Direct street legs of ``requests(request, lat_e7, lon_e7, to_lat_e7, to_lon_e7)`` (G7-G9, G19), and their edges.

    request, duration_s, distance_m, n_edges for each request whose ends lie on streets of the mode that meet;
    distance counts the edges, the ways to the street, and the shorter part of the edges snapped to. Cars look twice as far.
    """
    e = edges.withColumn("cost", street.edge_cost(F.col("meters"), F.col("speed"), mode, factor))
    usable = materialize(e.where(F.col("flags").bitwiseAND(F.lit(bits)) != 0), "road-edges")
    reach = radius_m * 2 if mode == "car" else radius_m
    canonical = edges.join(twins, "edge", "left").where("src < dst OR twin IS NULL").drop("twin")
    points = requests.select((F.col("request") * 2).alias("point"), "lat_e7", "lon_e7").union(requests.select((F.col("request") * 2 + 1).alias("point"), F.col("to_lat_e7"), F.col("to_lon_e7")))
    snaps = materialize(street.snap(points, canonical, nodes, bits, reach), "road-snaps")
    side = lambda k: snaps.where(F.col("point") % 2 == k).withColumn("point", F.floor(F.col("point") / 2).cast("long"))
    starts = materialize(seeds(side(0), edges, twins, bits, mode, factor).withColumnRenamed("point", "request"), "road-starts")
    ends = seeds(side(1), edges, twins, bits, mode, factor, leaving=False).withColumnRenamed("point", "request")
    found, labels = routes(usable, starts.join(ends.select("request").distinct(), "request", "left_semi"), ends)
    found = materialize(found, "road-found")
    path = materialize(path_edges(predecessors(labels, usable, starts), found), "road-path")
    total = path.join(edges.select("edge", "meters"), "edge").groupBy("request").agg(F.sum("meters").alias("meters"), F.count(F.lit(1)).alias("n_edges"))
    ways = lambda k, n: side(k).select(F.col("point").alias("request"), (F.col("perp") + F.least("along_u", "along_v")).alias(n))
    j = found.join(total, "request", "left").join(ways(0, "first"), "request").join(ways(1, "last"), "request")
    legs = j.select(
        "request", F.floor(F.col("ds") / 10).cast("long").alias("duration_s"), F.floor(F.coalesce("meters", F.lit(0)) + F.col("first") + F.col("last")).cast("long").alias("distance_m"),
        F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"),
    )
    return legs, path


def stop_anchors(stops: DataFrame, edges: DataFrame, nodes: DataFrame, twins: DataFrame, factor: int, radius_m: float = 250) -> DataFrame:
    """node, stop, extra: both ends of the street next to each of ``stops(stop_idx, lat_e7, lon_e7)`` (J7), extra in deciseconds."""
    canonical = edges.join(twins, "edge", "left").where("src < dst OR twin IS NULL").drop("twin")
    s = street.snap(stops.select(F.col("stop_idx").alias("point"), "lat_e7", "lon_e7"), canonical, nodes, street.FOOT, radius_m)
    extra = lambda along: clamped(partial_cost(F.col("perp") + F.col(along), F.lit(0), "foot", factor))
    both = s.select(F.col("src").alias("node"), F.col("point").alias("stop"), extra("along_u").alias("extra")).union(s.select("dst", "point", extra("along_v")))
    return both.groupBy("node", "stop").agg(F.min("extra").alias("extra"))


def stop_transfers(anchors: DataFrame, edges: DataFrame, factor: int, radius_m: int = 400) -> DataFrame:
    """from_stop, to_stop, ds of the footpaths within ``radius_m`` between all stops with ``anchors(node, stop, extra)``.

    ``edges(src, dst, cost)`` on foot. One bounded search for all stops at once.
    """
    most = (radius_m * factor) >> 16
    reached = routing.near_search(edges, anchors.select(F.col("stop").alias("origin"), "node", F.col("extra").alias("ds")), most)
    return routing.footpaths(reached, anchors).where(F.col("ds") <= most).select("from_stop", "to_stop", clamped(F.col("ds")).alias("ds"))
