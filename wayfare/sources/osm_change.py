"""OpenStreetMap diffs and replication state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<_id:long,_lat:string,_lon:string>"
WAY = "struct<_id:long,nd:array<struct<_ref:long>>,tag:array<struct<_k:string,_v:string>>>"
GROUP = f"node array<{NODE}>, way array<{WAY}>"


def read(spark: SparkSession, path: str, seq: int = 0) -> DataFrame:
    """seq, kind, op ('modify' or 'delete'), id, lat_e7, lon_e7, refs, tags of osmChange files, gzipped or not.

    Creations are modifications; relations, tags of nodes and ids of 0 are left out; coordinates are truncated.
    """
    parts = []
    for tag, op in (("create", "modify"), ("modify", "modify"), ("delete", "delete")):
        g = spark.read.format("xml").option("rowTag", tag).schema(GROUP).load(path)
        e7 = lambda c: F.try_multiply(F.col(c).cast("decimal(20,10)"), F.lit(10_000_000)).cast("long")
        n = g.select(F.explode("node").alias("n")).select(F.lit("node").alias("kind"), F.col("n._id").alias("id"), e7("n._lat").alias("lat_e7"), e7("n._lon").alias("lon_e7"))
        w = g.select(F.explode("way").alias("w")).select(
            F.lit("way").alias("kind"), F.col("w._id").alias("id"), F.transform("w.nd", lambda x: x["_ref"]).alias("refs"),
            F.map_from_entries(F.transform("w.tag", lambda x: F.struct(x["_k"], x["_v"]))).alias("tags"),
        )
        parts.append(n.unionByName(w, allowMissingColumns=True).withColumn("op", F.lit(op)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where("id IS NOT NULL AND id != 0").withColumn("seq", F.lit(seq).cast("long"))


def state(text: str) -> dict:
    """sequence and timestamp of a state file; a missing sequence is an error."""
    seq = re.search(r"^sequenceNumber=(\d+)", text, re.M)
    if not seq:
        raise ValueError("no sequenceNumber")
    ts = re.search(r"^timestamp=(.*)$", text, re.M)
    return {"seq": int(seq[1]), "timestamp": ts[1].strip().replace("\\:", ":") if ts else None}


def sequence_path(seq: int) -> str:
    t = f"{seq:09d}"
    return f"{t[:3]}/{t[3:6]}/{t[6:]}"
