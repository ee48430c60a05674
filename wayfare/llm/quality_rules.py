"""Quality rules with robust multivariate outliers.

Per document, word and line statistics give fixed base rules and a transformed vector. For each (lang, source), each
language and all rows, a minimum-covariance-determinant estimate of the rows that pass the base rules is found by
concentration steps that run as aggregations: distances under the current centre and scatter, the group's ``support``
quantile of them, moments of the rows below. Three deterministic starts (medians and quartiles; means and moments;
medians and moments of squashed deviations) take two steps each, the one of least determinant goes on until no
determinant falls any more, and rows inside the 97.5 % ellipsoid give the reweighted estimate. Rows whose squared
Mahalanobis distance passes a chi-square cut-off are rejected.

A group of few rows says little of its own: its estimate is blended with that of its language, and that one with the
estimate of all rows, weighing ``prior`` rows. So every row that passes the base rules is judged at any group size.
Directions in which most rows of a group agree exactly have no scatter; only there do the least deviations ``FLOORS`` count.

No group is gathered: each step sends one partial sum for each (task, group). Groups stay a DataFrame.

Defined results: a null text has no words; null languages and sources are groups of their own; repeated rows repeat
their result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
KEYS = ("lang", "source")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) >= 1 << 20:  # keep the product of three ids inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    gram = pair[:-1] * len(ids) + w[2:]
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = g[1:] == g[:-1]
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    at = order[twice]
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def with_stats(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [text_stats(t.as_py()) for t in b.column(3)]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(2), *cols], names=[f.split()[0] for f in STATS.split(", ")])

    return docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """The transformed vector; each entry grows slowly, so that long tails are near to straight lines."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


#: Least standard deviation of each entry, where a group's rows agree on it.
FLOORS = (0.05, 0.02, 0.05, 0.4, 0.1)


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _distance(k: int) -> Column:
    """Squared Mahalanobis distance from the group's center and flattened inverse."""
    z = [F.col(f"x{i}") - F.element_at("center", i + 1) for i in range(k)]
    terms = [F.element_at("inverse", i * k + j + 1) * z[i] * z[j] * (1.0 if i == j else 2.0) for i in range(k) for j in range(i, k)]
    return sum(terms[1:], terms[0])


def regular(scatter: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """``scatter`` with deviations of ``floors`` at least in the directions that have less; others stay as they are."""
    unit = np.outer(floors, floors)
    size, axes = np.linalg.eigh(scatter / unit)
    return scatter if size.min() >= 1 else (axes * np.maximum(size, 1)) @ axes.T * unit


def moments(columns: list[Column]) -> list[Column]:
    """Aggregates h, m (sums) and s (sums of products, upper triangle) of ``columns``."""
    k = len(columns)
    return [F.count(F.lit(1)).alias("h"), F.array(*[F.sum(c) for c in columns]).alias("m"), F.array(*[F.sum(columns[i] * columns[j]) for i in range(k) for j in range(i, k)]).alias("s")]


def scatter_of(h: int, m, s) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from :func:`moments`."""
    mean = np.array(m, float) / h
    out = np.zeros((len(mean), len(mean)))
    out[np.triu_indices(len(mean))] = np.array(s, float) / h
    return mean, out + np.triu(out, 1).T - np.outer(mean, mean)


FIT = "key string, start int, n long, center array<double>, inverse array<double>, scatter array<double>, det double"


def _fitted(sums: DataFrame, floors: tuple[float, ...], factor: float) -> DataFrame:
    """Fits of (key, start, n, h, m, s); ``factor`` makes up for the rows that were left out."""

    def solve(batches):
        f = np.array(floors)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mean, s = scatter_of(r.h, r.m, r.s)
                out.append((r.key, r.start, r.n, *as_fit(mean, regular(s * factor, f))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIT.split(", ")])

    return sums.mapInPandas(solve, FIT)


def as_fit(center: np.ndarray, scatter: np.ndarray) -> tuple[list[float], list[float], list[float], float]:
    return center.tolist(), np.linalg.inv(scatter).ravel().tolist(), scatter.ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


def starts(rows: DataFrame, k: int, floors: tuple[float, ...]) -> DataFrame:
    """Three fits for each key of ``rows(key, x0, ...)`` to start from."""
    quart = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(k)]
    q = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *quart), "mcd-quartiles")
    sd = [F.greatest((F.element_at(f"q{i}", 3) - F.element_at(f"q{i}", 1)) / 1.349, F.lit(floors[i])) for i in range(k)]
    squashed = [F.tanh((F.col(f"x{i}") - F.element_at(f"q{i}", 2)) / sd[i]) for i in range(k)]
    by = lambda columns, names: rows.join(q, "key").groupBy("key").agg(F.max("n").alias("n"), *[c.alias(n) for c, n in zip(moments(columns), names, strict=True)])
    both = q.join(by([F.col(f"x{i}") for i in range(k)], ("h", "m", "s")).drop("n"), "key").join(by(squashed, ("h2", "m2", "s2")).drop("n"), "key")

    def solve(batches):
        f = np.array(floors)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                quarts = np.array([getattr(r, f"q{i}") for i in range(k)], float)
                middle, width = quarts[:, 1], np.maximum((quarts[:, 2] - quarts[:, 0]) / 1.349, f)
                mean, s = scatter_of(r.h, r.m, r.s)
                near = scatter_of(r.h2, r.m2, r.s2)[1]
                for i, (c, x) in enumerate(((middle, np.diag(width**2)), (mean, s), (middle, near * np.outer(width, width)))):
                    out.append((r.key, i, r.n, *as_fit(c, regular(x, f))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIT.split(", ")])

    return materialize(both.mapInPandas(solve, FIT), "mcd-fit")


def concentrate(rows: DataFrame, fit: DataFrame, k: int, floors: tuple[float, ...], support: float) -> DataFrame:
    """The fits behind one concentration step, none of a larger determinant."""
    near = rows.join(fit.select("key", "start", "n", "center", "inverse"), "key").withColumn("d2", _distance(k)).drop("center", "inverse")
    cut = near.groupBy("key", "start").agg(F.percentile_approx("d2", support, 10_000).alias("cut"))
    kept = near.join(cut, ["key", "start"]).where(F.col("d2") <= F.col("cut"))
    sums = kept.groupBy("key", "start").agg(F.max("n").alias("n"), *moments([F.col(f"x{i}") for i in range(k)]))
    return materialize(_fitted(sums, floors, 1 / max(1e-6, truncated_variance(support, k))), "mcd-fit")


def mcd(rows: DataFrame, k: int, floors: tuple[float, ...], support: float = 0.75, most: int = 12) -> DataFrame:
    """The MCD fit of each key of ``rows(key, x0, ...)``: the best of three starts, concentrated until no determinant falls."""
    fit = starts(rows, k, floors)
    for _ in range(2):
        fit = concentrate(rows, fit, k, floors, support)
    best = F.row_number().over(Window.partitionBy("key").orderBy("det", "start"))
    fit = materialize(fit.withColumn("__n", best).where("__n = 1").drop("__n"), "mcd-fit")
    for _ in range(most - 2):
        new = concentrate(rows, fit, k, floors, support)
        both = new.join(fit.select("key", F.col("det").alias("old")), "key").agg(F.max(F.col("old") - F.col("det")).alias("fall")).first()
        fit = new
        if both.fall is None or both.fall < 1e-6:
            break
    return fit


def reweighted(rows: DataFrame, fit: DataFrame, k: int, floors: tuple[float, ...], inside: float = 0.975) -> DataFrame:
    """Fits of the rows within the ``inside`` ellipsoid of ``fit``."""
    near = rows.join(fit.select("key", "start", "n", "center", "inverse"), "key").where(_distance(k) <= F.lit(chi2_quantile(inside, k)))
    sums = near.groupBy("key", "start").agg(F.max("n").alias("n"), *moments([F.col(f"x{i}") for i in range(k)]))
    return materialize(_fitted(sums, floors, 1 / truncated_variance(inside, k)), "mcd-fit")


def truncated_variance(support: float, k: int) -> float:
    """Variance of a standard normal coordinate inside the ``support`` ball: chi2_{k+2} at the chi2_k quantile over support."""
    q = chi2_quantile(support, k)
    z = ((q / (k + 2)) ** (1 / 3) - (1 - 2 / (9 * (k + 2)))) / math.sqrt(2 / (9 * (k + 2)))
    return 0.5 * (1 + math.erf(z / math.sqrt(2))) / support


def key_of(level: int) -> Column:
    """Name of a row's group: all rows, its language, its language and source. Nulls are groups of their own."""
    return F.concat(F.lit(f"{level}:"), F.to_json(F.struct(*KEYS[:level])) if level else F.lit(""))


def estimates(rows: DataFrame, passed: DataFrame, k: int, support: float, prior: float) -> DataFrame:
    """key (of lang and source), center, inverse for each group of ``rows``, from the rows ``passed``."""
    xs = [f"x{i}" for i in range(k)]
    levels = passed.select(F.explode(F.array(*[key_of(i) for i in range(3)])).alias("key"), *xs)
    fit = reweighted(levels, mcd(levels, k, FLOORS, support), k, FLOORS).select("key", F.struct("n", "center", "scatter").alias("fit"))
    groups = rows.select(*[key_of(i).alias(f"key{i}") for i in range(3)]).distinct()
    for i in range(3):
        groups = groups.join(fit.select(F.col("key").alias(f"key{i}"), F.col("fit").alias(f"fit{i}")), f"key{i}", "left")

    def blend(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                have = None
                for f in (r.fit0, r.fit1, r.fit2):
                    if f is None:
                        continue
                    c, s = np.array(f["center"], float), np.array(f["scatter"], float).reshape(k, k)
                    w = 1.0 if have is None else f["n"] / (f["n"] + prior)
                    have = (c, s) if have is None else (w * c + (1 - w) * have[0], w * s + (1 - w) * have[1])
                if have is not None:
                    out.append((r.key2, have[0].tolist(), np.linalg.inv(have[1]).ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "center", "inverse"])

    return materialize(groups.mapInPandas(blend, "key string, center array<double>, inverse array<double>"), "rules-fit")


def apply_rules(docs: DataFrame, support: float = 0.75, quantile: float = 1 - 1e-9, prior: float = 30.0) -> DataFrame:
    """doc_id, the statistics, base_failed, distance2, kept for every row of ``docs(doc_id, text, lang, source)``."""
    xs = features()
    k = len(xs)
    rows = materialize(with_stats(docs).select("*", base_failed().alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]), "rules-stats")
    fit = estimates(rows, rows.where("NOT base_failed"), k, support, prior)
    judged = rows.withColumn("key", key_of(2)).join(fit, "key", "left").withColumn("d2", _distance(k))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.lit(chi2_quantile(quantile, k)), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), F.col("d2").alias("distance2")
    )


#: The statistics and base rules alone, which SQL can express.
BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, text, w, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), i -> w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS grams FROM d),
t AS (SELECT rowid AS r, * FROM (SELECT row_number() OVER () AS rowid, * FROM g)),
h AS (SELECT r, gram, list(i) AS at FROM (SELECT r, unnest(grams) AS gram, unnest(range(len(grams))) AS i FROM t) GROUP BY r, gram HAVING count(*) > 1),
x AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([a, a + 1, a + 2]) AS p FROM (SELECT r, unnest(at) AS a FROM h)) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), s -> regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, s -> length(s))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(x.n, 0) > 50 * len(w) AS base_failed
FROM t JOIN l ON l.r = t.r LEFT JOIN x ON x.r = t.r
"""


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics and base_failed."""
    return with_stats(docs).drop("lang", "source").withColumn("base_failed", base_failed())
