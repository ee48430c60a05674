"""The planner as one object: versioned tables in, batches of requests answered, status out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import itineraries, routing, timetable
from .store import Snapshots, materialize

#: Tables that a plan reads.
TABLES = ("timetable", "services", "service_exceptions", "stops", "transfers")


class Engine:
    """Every call opens the latest versions and keeps them; publishing never disturbs a running query."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.config, self.tables = spark, config or Config(), Snapshots(spark, root)

    def publish(self, **tables: DataFrame) -> dict[str, int]:
        return {name: self.tables.publish(name, df) for name, df in tables.items()}

    @property
    def ready(self) -> bool:
        return all(self.tables.latest(t) for t in TABLES)

    def _network(self, dates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        t = self.tables.read("timetable")
        if self.tables.latest("rt_stops"):
            late = timetable.scheduled_with_realtime(t, self.tables.read("rt_stops")).select("trip", "pos", "arr", "dep")
            t = timetable.without_skipped(t.drop("arr", "dep").join(late, ["trip", "pos"]), self.tables.read("rt_stops"))
            t = t.join(self.tables.read("rt_trips").where("cancelled").select("trip"), "trip", "left_anti")
        days = dates.select("date").union(dates.select("previous")).distinct()
        active = timetable.active_services(self.tables.read("services"), self.tables.read("service_exceptions"), days)
        day = routing.layers(t, active, dates)
        ride = materialize(routing.rides(day), "rides")
        return materialize(routing.boards(ride), "boards"), ride, day

    def plan(self, requests: DataFrame, access: DataFrame | None = None, egress: DataFrame | None = None) -> DataFrame:
        """Pareto journeys for ``requests(query_id, date, previous, source, dep_sec, target, egress_sec)``.

        ``access(query_id, stop, sec)`` and ``egress`` replace the single source and target where they are given.
        """
        board, ride, _ = self._network(requests.select("date", "previous").distinct())
        sources = requests.select("query_id", "date", F.col("source").alias("stop"), F.col("dep_sec").alias("arr"))
        if access is not None:
            sources = requests.join(access, "query_id").select("query_id", "date", "stop", (F.col("dep_sec") + F.col("sec")).alias("arr"))
        targets = requests.select("query_id", F.col("target").alias("stop"), F.col("egress_sec").alias("egress"))
        if egress is not None:
            targets = egress.select("query_id", "stop", F.col("sec").alias("egress"))
        found = routing.raptor(sources, targets, board, ride, self.tables.read("transfers"), self.config.max_transfers, int(self.config.transfer_slack))
        return routing.pareto(found)

    def legs(self, journeys: DataFrame, dates: DataFrame) -> DataFrame:
        """Calls of the rides of ``journeys``, with stop names and times."""
        return itineraries.transit_legs(journeys, self._network(dates)[2], self.tables.read("stops"))

    def matrix(self, pairs: DataFrame, date: int, previous: int, dep_sec: int) -> DataFrame:
        """source, target, arr: earliest arrivals for every row of ``pairs(source, target)``, stops below 2^31."""
        requests = pairs.select((F.shiftleft(F.col("source"), 31) + F.col("target")).alias("query_id"), F.lit(date).cast("long").alias("date"), F.lit(previous).cast("long").alias("previous"), "source", F.lit(dep_sec).cast("long").alias("dep_sec"), "target", F.lit(0).cast("long").alias("egress_sec"))
        best = self.plan(requests).groupBy("query_id").agg(F.min("arr").alias("arr"))
        return best.select(F.shiftright("query_id", 31).alias("source"), F.col("query_id").bitwiseAND(F.lit((1 << 31) - 1)).alias("target"), "arr")

    def status(self) -> DataFrame:
        """table, version, rows of what is published."""
        rows = [(t, self.tables.latest(t), self.tables.read(t).count()) for t in (*TABLES, "rt_trips", "rt_stops") if self.tables.latest(t)]
        return self.spark.createDataFrame(rows, "table string, version long, rows long")
