"""Requests as they come in: checks, times in the network's zone, dispatch by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("transit", "bike_transit", "walk", "bike", "car")
#: Layouts without a zone, read in the network's zone.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def checked(requests: DataFrame, zone: str, default_num: int = 4) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with their reason.

    ``requests(query_id, from_lat, from_lon, to_lat, to_lon, mode, when, num)`` in degrees, ``when`` as text. Valid
    ones get E7 coordinates (truncated), the local date, the date before, and seconds since local midnight.
    """
    local = F.coalesce(
        F.when(F.col("when").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.from_utc_timestamp(F.try_to_timestamp("when"), zone)),
        *[F.when(F.length("when") == len(x.replace("'", "")), F.try_to_timestamp("when", F.lit(x))) for x in LAYOUTS],
    )
    place = lambda a, o: F.col(a).between(-90, 90) & F.col(o).between(-180, 180)
    reason = (
        F.when(~F.coalesce(place("from_lat", "from_lon") & place("to_lat", "to_lon"), F.lit(False)), "place out of range")
        .when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "unknown mode")
        .when(F.col("num") > 10, "num is above 10")
        .when(F.col("local").isNull(), "no time")
    )
    r = requests.withColumn("local", local).withColumn("reason", reason)
    e7 = lambda c: (F.col(c) * 1e7).cast("long")
    day = lambda t: F.date_format(t, "yyyyMMdd").cast("long")
    ok = r.where("reason IS NULL").select(
        "query_id", "mode", F.when(F.col("num") > 0, F.col("num")).otherwise(default_num).alias("num"),
        e7("from_lat").alias("from_lat_e7"), e7("from_lon").alias("from_lon_e7"), e7("to_lat").alias("to_lat_e7"), e7("to_lon").alias("to_lon_e7"),
        day("local").alias("date"), day(F.date_sub("local", 1)).alias("previous"), (F.hour("local") * 3600 + F.minute("local") * 60 + F.second("local")).cast("long").alias("dep_sec"),
    )
    return ok, r.where("reason IS NOT NULL").select("query_id", "reason")


def by_mode(requests: DataFrame, answers: dict) -> DataFrame:
    """The union of ``answers[mode](requests of that mode)``."""
    parts = [answer(requests.where(F.col("mode") == mode)) for mode, answer in answers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def responses(itineraries: DataFrame) -> DataFrame:
    """query_id, body: the itineraries of each request as one JSON text, in rank order."""
    columns = [c for c in itineraries.columns if c != "query_id"]
    listed = F.array_sort(F.collect_list(F.struct("rank", *[c for c in columns if c != "rank"])))
    return itineraries.groupBy("query_id").agg(F.to_json(F.struct(listed.alias("itineraries"))).alias("body"))
