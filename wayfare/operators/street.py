"""Street graph operators: classification of ways, segments, edges, components, grid, snapping, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, parse
from ..store import materialize

CAR, BIKE, FOOT, ROUNDABOUT, LINK, STEPS = 1, 2, 4, 16, 32, 64
#: Modes and km/h of the highway classes.
CLASSES = {
    "motorway": (CAR, 120), "motorway_link": (CAR, 60), "trunk": (CAR, 90), "trunk_link": (CAR, 50),
    "primary": (7, 65), "primary_link": (7, 45), "secondary": (7, 55), "secondary_link": (7, 40), "tertiary": (7, 45), "tertiary_link": (7, 35),
    "unclassified": (7, 40), "residential": (7, 28), "living_street": (7, 10), "service": (7, 15), "road": (7, 30),
    "pedestrian": (FOOT, 5), "footway": (FOOT, 5), "bridleway": (FOOT, 5), "steps": (FOOT, 4), "path": (6, 10), "cycleway": (6, 18), "track": (6, 15),
}
#: Side of a grid cell in E7 degrees.
CELL = 30000


def classify(ways: DataFrame) -> DataFrame:
    """Adds fwd, bwd (mode flags), speed, name to ``ways(way_id, tags map, refs)``; ways that carry no mode go."""
    tag = lambda k: F.element_at("tags", F.lit(k))
    cls = F.broadcast(ways.sparkSession.createDataFrame([(k, m, v) for k, (m, v) in CLASSES.items()], "highway string, base int, kmh int"))
    w = ways.withColumn("highway", tag("highway")).join(cls, "highway")
    area = F.coalesce((F.col("highway") == "pedestrian") & (tag("area") == "yes"), F.lit(False))

    def off(flags: Column, when: Column, bits: int) -> Column:
        return flags.bitwiseAND(F.when(when, 255 - bits).otherwise(255))  # names flags once: the chain stays linear

    def on(flags: Column, when: Column, bits: Column) -> Column:
        return flags.bitwiseOR(F.when(when, bits).otherwise(0))

    base = F.col("base")
    f = off(base, tag("access").isin("no", "private", "military"), 7)
    f = off(f, tag("motor_vehicle").isin("no", "private", "agricultural", "forestry", "delivery"), CAR)
    f = on(f, tag("motor_vehicle").isin("yes", "permissive", "destination"), base.bitwiseAND(F.lit(CAR)))
    f = off(f, tag("vehicle").isin("no", "private"), CAR | BIKE)
    f = off(f, tag("bicycle").isin("no", "use_sidepath", "private"), BIKE)
    f = on(f, tag("bicycle").isin("yes", "designated", "permissive"), F.lit(BIKE))
    f = off(f, tag("foot").isin("no", "private", "use_sidepath"), FOOT)
    f = on(f, tag("foot").isin("yes", "designated", "permissive"), F.lit(FOOT))
    f = off(f, F.col("highway") == "steps", BIKE)
    round_ = F.coalesce(tag("junction").isin("roundabout", "circular"), F.lit(False))
    extra = F.when(round_, ROUNDABOUT).otherwise(0).bitwiseOR(F.when(F.col("highway").endswith("_link"), LINK).otherwise(0)).bitwiseOR(F.when(F.col("highway") == "steps", STEPS).otherwise(0))
    w = w.where(~area).withColumn("modes", f).where("modes != 0").withColumn("extra", extra)
    oneway, bikes = tag("oneway"), tag("oneway:bicycle")
    implied = oneway.isNull() & (round_ | F.col("highway").isin("motorway", "motorway_link"))
    fwd = off(F.col("modes"), oneway == "-1", CAR | BIKE)
    bwd = off(F.col("modes"), oneway.isin("yes", "1", "true") | implied, CAR | BIKE)
    bike = F.col("modes").bitwiseAND(F.lit(BIKE))
    fwd = off(on(fwd, bikes == "no", bike), bikes == "-1", BIKE)
    bwd = off(on(bwd, bikes == "no", bike), bikes == "yes", BIKE)
    side = lambda x: F.when(x == 0, 0).otherwise(x.bitwiseOR(F.col("extra")))
    name = F.coalesce(F.nullif(tag("name"), F.lit("")), tag("ref"), F.lit(""))
    speed = F.coalesce(parse.maxspeed(tag("maxspeed")), F.col("kmh").cast("long"))
    return w.where(F.size("refs") >= 2).select("way_id", side(fwd).alias("fwd"), side(bwd).alias("bwd"), speed.alias("speed"), name.alias("name"), "refs")


def edge_cost(meters: Column, speed: Column, mode: str, factor: int = 0) -> Column:
    """Deciseconds along an edge (P5): cars round up at the edge's speed, others down by a 16-bit factor, 1 at least."""
    if mode == "car":
        v = F.when(speed == 0, F.lit(30)).otherwise(speed)
        return F.ceil(meters * 36 / v).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.shiftright(meters.cast("long") * factor, 16))


def speed_factor(kmh: float) -> int:
    return round(36 / max(kmh, 0.1) * 65536)


def routing_nodes(ways: DataFrame) -> DataFrame:
    """Nodes of ``ways(way_id, refs)`` where edges end: ends of ways, and nodes met twice or more (A1)."""
    r = ways.select("refs", F.posexplode("refs").alias("pos", "node"))
    ends = (F.col("pos") == 0) | (F.col("pos") == F.size("refs") - 1)
    return r.groupBy("node").agg(F.count(F.lit(1)).alias("uses"), F.max(ends).alias("ends")).where("uses >= 2 OR ends").select("node")


def way_segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, seg, seq, node: ways cut at routing nodes (W7); a cut node ends one segment and begins the next.

    Nodes without coordinates break a way: ``nodes(node, ...)`` holds those that have them.
    """
    r = ways.select("way_id", F.posexplode("refs").alias("pos", "node"))
    r = r.join(nodes.select("node", F.lit(True).alias("known")), "node", "left").join(routing_nodes(ways).select("node", F.lit(True).alias("cut")), "node", "left")
    by = Window.partitionBy("way_id").orderBy("pos")
    hole, cut = F.col("known").isNull(), F.coalesce("cut", F.lit(False))
    # a segment starts at each routing node and behind each hole
    behind = F.lag(hole, 1, True).over(by)
    starts = (cut | behind).cast("long")
    r = r.withColumn("hole", hole).withColumn("cut", cut).withColumn("behind", behind).withColumn("seg", F.sum(starts).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    shared = r.where("cut AND NOT hole AND NOT behind AND seg > 1").select("way_id", "pos", "node", (F.col("seg") - 1).alias("seg"), "hole")
    rows = r.where("NOT hole").select("way_id", "pos", "node", "seg", "hole").union(shared)
    whole = rows.groupBy("way_id", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).where("n >= 2 AND hi - lo = n - 1")
    return rows.join(whole.select("way_id", "seg", "lo"), ["way_id", "seg"]).select("way_id", "seg", (F.col("pos") - F.col("lo")).cast("long").alias("seq"), "node")


def split_chain(pts: Column, most_m: float = 65000.0) -> Column:
    """Points of a chain cut where its length would pass ``most_m`` (W8): an array of arrays that share their ends.

    A stretch between two points that is longer by itself stays whole.
    """
    gap = lambda i: geo.distance(F.element_at(pts, i - 1)["lat_e7"], F.element_at(pts, i - 1)["lon_e7"], F.element_at(pts, i)["lat_e7"], F.element_at(pts, i)["lon_e7"])

    def step(s: Column, i: Column) -> Column:
        d = gap(i)
        cut = (s["meters"] + d > most_m) & (i - 1 > s["start"])
        return F.struct(
            F.when(cut, i - 1).otherwise(s["start"]).alias("start"),
            (F.when(cut, F.lit(0.0)).otherwise(s["meters"]) + d).alias("meters"),
            F.when(cut, F.concat(s["cuts"], F.array(i - 1))).otherwise(s["cuts"]).alias("cuts"),
        )

    start = F.struct(F.lit(1).alias("start"), F.lit(0.0).alias("meters"), F.array(F.lit(1)).alias("cuts"))
    cuts = F.aggregate(F.sequence(F.lit(2), F.size(pts)), start, step, lambda s: F.concat(s["cuts"], F.array(F.size(pts))))
    return F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.slice(pts, F.element_at(cuts, k), F.element_at(cuts, k + 1) - F.element_at(cuts, k) + 1))


def graph_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges of ``ways(way_id, fwd, bwd, speed, name, refs)`` over ``nodes(node, lat_e7, lon_e7)``."""
    at = F.struct("seq", "node", "lat_e7", "lon_e7")
    chains = way_segments(ways, nodes).join(nodes, "node").groupBy("way_id", "seg").agg(F.array_sort(F.collect_list(at)).alias("pts"))
    d = F.aggregate(
        F.sequence(F.lit(2), F.size("pts")),
        F.lit(0.0),
        lambda s, i: s + geo.distance(F.element_at("pts", i - 1)["lat_e7"], F.element_at("pts", i - 1)["lon_e7"], F.element_at("pts", i)["lat_e7"], F.element_at("pts", i)["lon_e7"]),
    )
    chains = chains.select("way_id", "seg", F.posexplode(split_chain(F.col("pts"))).alias("part", "pts"))
    c = chains.withColumn("meters", F.greatest(F.lit(1).cast("long"), F.floor(d + 0.5).cast("long"))).join(ways.drop("refs"), "way_id")
    a, b = F.element_at("pts", 1)["node"], F.element_at("pts", -1)["node"]
    pair = F.concat_ws(":", F.col("way_id"), F.col("seg"), F.when(F.col("part") > 0, F.col("part")))
    out = c.where(a != b).select(pair.alias("pair_id"), a.alias("a"), b.alias("b"), "meters", "speed", "name", "fwd", "bwd", "pts")
    one = out.where("fwd != 0").select("pair_id", F.lit(0).alias("side"), F.col("a").alias("src"), F.col("b").alias("dst"), "meters", "speed", "name", F.col("fwd").alias("flags"), "pts")
    two = out.where("bwd != 0").select("pair_id", F.lit(1), F.col("b"), F.col("a"), "meters", "speed", "name", F.col("bwd"), F.reverse("pts"))
    return one.union(two)


def twins(edges: DataFrame) -> DataFrame:
    """edge, twin: the same stretch the other way (J15); ``edges(edge, src, dst, pair_id)``."""
    other = edges.select(F.col("edge").alias("twin"), F.col("src").alias("t_src"), F.col("dst").alias("t_dst"), "pair_id")
    return edges.join(other, "pair_id").where("edge != twin AND src = t_dst AND dst = t_src").select("edge", "twin")


def canonical(edges: DataFrame) -> DataFrame:
    """One direction of each stretch (P20): src < dst, or without a twin."""
    return edges.join(twins(edges), "edge", "left").where("src < dst OR twin IS NULL").drop("twin")


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("lat_e7").alias("min_lat"), F.min("lon_e7").alias("min_lon"), F.max("lat_e7").alias("max_lat"), F.max("lon_e7").alias("max_lon"))


def components(edges: DataFrame, nodes: DataFrame, mode: int) -> DataFrame:
    """node, component (least node) over edges of a mode, taken undirected (G2): hooking and pointer jumping."""
    e = edges.where(F.col("flags").bitwiseAND(F.lit(mode)) != 0)
    both = materialize(e.select("src", "dst").union(e.select("dst", "src")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("component")), "cc")
    while True:
        # each root takes the least label next to any of its members, then every node jumps to its label's label
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("far")), "dst").join(labels.select(F.col("node").alias("src"), "component"), "src")
        hook = near.groupBy("component").agg(F.least(F.min("far"), F.min("component")).alias("root"))
        once = labels.join(hook, "component").select("node", F.col("component").alias("old"), F.col("root").alias("component"))
        jump = once.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = materialize(once.join(jump, "component", "left").select("node", "old", F.coalesce("root", "component").alias("component")), "cc")
        labels = new.select("node", "component")
        if new.where("old != component").isEmpty():
            return labels


def snap_safe(edges: DataFrame, nodes: DataFrame, mode: int) -> DataFrame:
    """Nodes of components large enough to snap to (A7): 200 nodes, or a quarter of a small graph, 2 at least."""
    n = nodes.count()
    least = max(n // 4, 2) if n // 4 < 200 else 200
    c = components(edges, nodes, mode)
    big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return c.join(big, "component").select("node")


def grid_index(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell_y, cell_x, edge: cells that canonical edges pass, sampled each half cell."""
    ends = lambda p, k: nodes.select(F.col("node").alias(k), F.col("lat_e7").alias(f"{p}lat"), F.col("lon_e7").alias(f"{p}lon"))
    e = edges.join(ends("a", "src"), "src").join(ends("b", "dst"), "dst")
    reach = F.greatest(F.abs(F.col("blat") - F.col("alat")), F.abs(F.col("blon") - F.col("alon")))
    n = F.floor(reach / (CELL // 2)).cast("long") + 1
    e = e.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    cell = lambda a, b: F.floor((F.col(a) + F.expr(f"(({b} - {a}) * i) div n")) / CELL).cast("long")
    return e.select(cell("alat", "blat").alias("cell_y"), cell("alon", "blon").alias("cell_x"), "edge").distinct()


def snap(points: DataFrame, edges: DataFrame, nodes: DataFrame, mode: int, radius_m: float = 300) -> DataFrame:
    """point, edge, perp_m, along_u, along_v, lat_e7, lon_e7: nearest edge of a mode (J6), all rings of cells searched.

    Ties by edge. Points beyond ``radius_m`` of every edge have no row. ``edges`` are canonical and straight;
    an edge counts when either direction allows the mode.
    """
    e = edges.where(F.col("flags").bitwiseAND(F.lit(mode)) != 0)
    ring = int(radius_m / 333.6) + 1
    y, x = F.floor(F.col("lat_e7") / CELL).cast("long"), F.floor(F.col("lon_e7") / CELL).cast("long")
    # longitude cells are narrower in metres: as many more of them as keep the radius inside, up to 60 degrees
    near = points.withColumn("cell_y", F.explode(F.sequence(y - ring, y + ring))).withColumn("cell_x", F.explode(F.sequence(x - 2 * ring, x + 2 * ring)))
    cand = near.join(grid_index(e, nodes), ["cell_y", "cell_x"]).select("point", "lat_e7", "lon_e7", "edge").distinct()
    a = nodes.select(F.col("node").alias("src"), F.col("lat_e7").alias("alat"), F.col("lon_e7").alias("alon"))
    b = nodes.select(F.col("node").alias("dst"), F.col("lat_e7").alias("blat"), F.col("lon_e7").alias("blon"))
    full = cand.join(e.select("edge", "src", "dst"), "edge").join(a, "src").join(b, "dst")
    full = full.withColumn("q", geo.project(*[F.col(c) for c in ("lat_e7", "lon_e7", "alat", "alon", "blat", "blon")]))
    full = full.withColumn("perp", geo.distance(F.col("lat_e7"), F.col("lon_e7"), F.col("q.lat_e7"), F.col("q.lon_e7"))).where(F.col("perp") <= radius_m)
    au, av = geo.distance(F.col("alat"), F.col("alon"), F.col("q.lat_e7"), F.col("q.lon_e7")), geo.distance(F.col("q.lat_e7"), F.col("q.lon_e7"), F.col("blat"), F.col("blon"))
    found = F.struct("edge", "src", "dst", "perp", au.alias("along_u"), av.alias("along_v"), F.col("q.lat_e7").alias("q_lat"), F.col("q.lon_e7").alias("q_lon"))
    return full.groupBy("point").agg(F.min_by(found, F.struct("perp", "edge")).alias("s")).select("point", "s.*")


def apply_changes(ways: DataFrame, changes: DataFrame) -> DataFrame:
    """Ways behind a run of diffs (O9, M1, M2): the last change of each id by sequence wins.

    ``ways(id, ...)``; ``changes(seq, id, op, ...)`` with op 'delete', or 'modify' and the same further columns.
    """
    by = Window.partitionBy("id").orderBy(F.desc("seq"), "op")
    last = changes.withColumn("__n", F.row_number().over(by)).where("__n = 1")
    return ways.join(last.select("id"), "id", "left_anti").unionByName(last.where("op != 'delete'").select(*ways.columns))


def turn_steps(path: DataFrame) -> DataFrame:
    """Turn-by-turn steps of ``path(route, pos, name, flags, b_in, b_out, meters, ds)``.

    Steps depend on the step before (its name, and whether it is a roundabout): a fold over each route's edges.
    """
    edge = F.struct("pos", "name", "flags", "b_in", "b_out", "meters", "ds")
    g = path.groupBy("route").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    step_type = "struct<kind:string,modifier:string,name:string,meters:bigint,ds:bigint>"

    def step(s: Column, e: Column) -> Column:
        angle = geo.turn(s["out"], e["b_in"])
        word = geo.modifier(angle)
        ring, was = e["flags"].bitwiseAND(F.lit(ROUNDABOUT)) != 0, s["cur"]["kind"] == "roundabout"
        new = s["seen"] & ((e["name"] != s["cur"]["name"]) | (ring & ~was) | (~ring & was) | ((word != "straight") & (F.abs(angle) >= 40)))
        kind = F.when(ring & ~was, "roundabout").when(~ring & was, "exit_roundabout").when(word == "straight", "continue").otherwise("turn")
        fresh = F.struct(kind.alias("kind"), word.alias("modifier"), e["name"].alias("name"), e["meters"].alias("meters"), e["ds"].alias("ds"))
        on = F.struct(
            s["cur"]["kind"].alias("kind"), s["cur"]["modifier"].alias("modifier"), F.when(s["seen"], s["cur"]["name"]).otherwise(e["name"]).alias("name"),
            (s["cur"]["meters"] + e["meters"]).alias("meters"), (s["cur"]["ds"] + e["ds"]).alias("ds"),
        )
        return F.struct(F.when(new, fresh).otherwise(on).alias("cur"), F.when(new, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"), e["b_out"].alias("out"), F.lit(True).alias("seen"))

    start = F.struct(
        F.struct(F.lit("depart").alias("kind"), F.lit("straight").alias("modifier"), F.lit("").alias("name"), F.lit(0).cast("long").alias("meters"), F.lit(0).cast("long").alias("ds")).alias("cur"),
        F.array().cast(f"array<{step_type}>").alias("done"), F.lit(0.0).alias("out"), F.lit(False).alias("seen"),
    )
    last = F.struct(F.lit("arrive").alias("kind"), F.lit("straight").alias("modifier"), F.lit("").alias("name"), F.lit(0).cast("long").alias("meters"), F.lit(0).cast("long").alias("ds"))
    steps = F.aggregate("edges", start, step, lambda s: F.concat(s["done"], F.array(s["cur"], last)))
    return g.select("route", F.posexplode(steps).alias("step", "s")).select("route", F.col("step").cast("long").alias("step"), "s.*")


def grid(spark, rows: int, cols: int, lat: int, lon: int, step: int) -> DataFrame:
    """node, lat_e7, lon_e7 of a synthetic lattice."""
    n = spark.range(rows * cols)
    return n.select(F.col("id").alias("node"), (F.lit(lat) + F.floor(F.col("id") / cols) * step).cast("long").alias("lat_e7"), (F.lit(lon) + F.col("id") % cols * step).cast("long").alias("lon_e7"))
