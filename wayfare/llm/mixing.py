"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by (source, hash bucket); running sums over the buckets give the bucket in which a
source's budget runs out, and only that bucket is refined, 15 hash bits at a time. The result is one
threshold on a 60-bit hash per source, applied as a filter: no sort of documents, thresholds of smaller
budgets are nested in those of larger ones, reruns agree.

Defined results: a null text has size 0; null sources form one source, ordered last; rows that repeat a
``doc_id`` share its hash and are taken together; a source without words has target 0; an empty table
gives no rows; further columns are ignored by :func:`mixture` and kept by :func:`apply_mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, n_words

LEVELS, BITS = 4, 15


def doc_hash(doc_id: Column, seed: str) -> Column:
    """60 bits of md5(seed:doc_id) as a long."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """source -> source_size, target. One row for each source, so the windows see sources, not documents.

    Targets min(cap x size, l x weight) with the level l that spends share x all sizes: the fixed point of
    handing the excess of capped sources back to the others by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    full = F.col("source_size") * F.lit(float(cap))
    at = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    everyone = Window.partitionBy()
    level = (F.col("budget") - F.col("full_before")) / F.col("weight_left")
    return (
        ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("full", full.cast("double"))
        .withColumn("budget", F.sum("source_size").over(everyone).cast("double") * F.lit(float(share)))
        .withColumn("full_before", F.sum("full").over(at.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("full_before", F.coalesce("full_before", F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(at.rowsBetween(0, Window.unboundedFollowing)))
        # the sources stand in the order in which they fill up; the first that does not fill has the greatest level of those that do not
        .withColumn("level", F.when(level * F.col("weight") < F.col("full"), level))
        .withColumn("level", F.max("level").over(everyone))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source -> rounds (how often every document is taken) and cut: documents with hash < cut once more."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    bound = targets.withColumn("rounds", rounds.cast("long")).select(
        "source", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")
    )
    bound = materialize(bound, "mix-bound")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        # a bound per source: small, but joined, not collected; Spark broadcasts it below its own size limit
        b = bound.withColumnRenamed("source", "b_source")
        inside = sizes.join(b, F.expr("source <=> b_source") & (F.shiftright("h", shift + BITS) == F.col("prefix"))) if level > 1 else sizes
        cell = inside.groupBy("source", F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("cell_size"))
        run = Window.partitionBy("source").orderBy("cell")
        cum = cell.withColumn("upto", F.sum("cell_size").over(run))
        # the first cell that passes the budget is refined; it is null where the budget is never passed
        hit = (
            cum.join(b, F.expr("source <=> b_source"))
            .groupBy("b_source")
            .agg(
                F.min(F.when(F.col("upto") > F.col("left"), F.struct("cell", "upto", "cell_size"))).alias("hit"),
                F.max("cell").alias("last_cell"),
            )
        )
        bound = bound.join(hit, F.expr("source <=> b_source"), "left").select(
            "source",
            "rounds",
            F.coalesce(F.col("left") - (F.col("hit.upto") - F.col("hit.cell_size")), F.col("left")).alias("left"),
            # with nothing to pass the budget, the cut lies behind the last cell
            F.coalesce(F.col("hit.cell"), F.col("last_cell") + 1, F.shiftleft("prefix", BITS)).alias("prefix"),
            (F.col("hit.cell_size") if level == LEVELS else F.lit(None).cast("long")).alias("cell_size"),
        )
        bound = materialize(bound.select("source", "rounds", "left", "prefix", *(["cell_size"] if level == LEVELS else [])), "mix-bound")
    # documents of the last cell share one hash: they go in when that comes nearer to the budget
    nearer = F.coalesce(F.col("cell_size") - F.col("left") < F.col("left"), F.lit(False))
    return bound.select("source", "rounds", (F.col("prefix") + nearer.cast("long")).alias("cut"))


def mixture(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs(doc_id, text, source)``."""
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), seed).alias("h")), "mix-sizes")
    targets = materialize(source_targets(sizes, list(weights), share, cap), "mix-targets")
    cuts = thresholds(sizes, targets).withColumnRenamed("source", "c_source")
    plan = targets.join(cuts, F.expr("source <=> c_source")).drop("c_source").withColumnRenamed("source", "p_source")
    times = F.col("rounds") + (F.col("h") < F.col("cut")).cast("long")
    return sizes.join(plan, F.expr("source <=> p_source")).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def apply_mixture(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    give_back(docs.sparkSession)
    mine = docs.select(*[f"`{c}`" for c in docs.columns], n_words(F.col("text")).alias("__size"), doc_hash(F.col("doc_id"), seed).alias("__h"))
    sizes = materialize(mine.select("doc_id", "source", F.col("__size").alias("size"), F.col("__h").alias("h")), "mix-sizes")
    targets = materialize(source_targets(sizes, list(weights), share, cap), "mix-targets")
    cuts = thresholds(sizes, targets).select(F.col("source").alias("__source"), F.col("rounds").alias("__rounds"), F.col("cut").alias("__cut"))
    # a document without words lies below any cut; it too is taken no more than ``cap`` times
    times = F.least(F.col("__rounds") + (F.col("__h") < F.col("__cut")).cast("long"), F.lit(int(cap))).cast("int")
    return (
        mine.join(cuts, F.expr("source <=> __source"))
        .withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
        .select(*[f"`{c}`" for c in docs.columns])
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2.0 AS fullsize FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
  coalesce(sum(fullsize) OVER (ORDER BY fullsize / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
  sum(weight) OVER (ORDER BY fullsize / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w),
l AS (SELECT *, max(CASE WHEN (budget - full_before) / weight_left * weight < fullsize THEN (budget - full_before) / weight_left END) OVER () AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN fullsize ELSE least(fullsize, level * weight) END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
g AS (SELECT source, h, sum(size) AS hsize FROM d GROUP BY source, h),
c AS (SELECT source, h, hsize, sum(hsize) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
f AS (SELECT c.source, c.h, CASE WHEN upto <= target - rounds * source_size THEN 1
        WHEN upto - hsize > target - rounds * source_size THEN 0
        WHEN upto - (target - rounds * source_size) < (target - rounds * source_size) - (upto - hsize) THEN 1 ELSE 0 END AS extra
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.rounds + f.extra) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.h = f.h
"""
