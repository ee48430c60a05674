"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the features.
Words enter as hashed distinct words with equal weights of norm 1, statistics as standardised numbers.

The machine is fitted on the driver from at most ``rows`` labelled rows (a documented bound); every text is
scored whole. Defined results: null and empty texts have statistics of zeros and get a score like any other;
repeated rows repeat their score; an empty table gives no rows; without any labelled row all scores are 0.5;
further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, positional, tidy
from .labelled import WORD, WordCache, bucket, collect_features, labelled_sample, row_sums, sigmoid

BITS = 16
#: Texts that are scored together.
ROWS = 256
SYMBOLS, MARKS = "#*$%&|<>{}[]~^=_\\/@+", "!?"


def words_of(text: str) -> np.ndarray:
    found = {bucket(w, BITS) for w in set(WORD.findall(text.lower()))}
    return np.sort(np.fromiter(found, np.int64, len(found)))


def structure(text: str, n_chars: int | None = None) -> list[float]:
    """Slowly growing statistics of a text, and the length that its metadata give."""
    tokens = text.split()
    n = max(1, len(tokens))
    size = max(1, len(text))
    upper = sum(1 for t in tokens if t.isupper() and len(t) > 1)
    lines = text.split("\n")
    return [
        math.log1p(len(tokens)),
        math.log1p(len(text) / n),
        upper / n,
        math.sqrt(sum(map(text.count, SYMBOLS)) / size),
        math.sqrt(sum(map(text.count, MARKS)) / size),
        math.sqrt(sum(map(text.count, "0123456789")) / size),
        math.sqrt(sum(map(text.count, ".,;:")) / size),
        len(set(tokens)) / n,
        math.log1p(len(lines) - len(set(lines))),
        math.log1p(n / len(lines)),
        math.log1p(max(0, n_chars)) if n_chars is not None else math.log1p(len(text)),
    ]


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def scores(self, offsets: np.ndarray, flat: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Scores of rows in ragged form."""
        x = np.clip((stats - self.mean) / self.sd, -6, 6)
        return sigmoid(self._raw(offsets, flat, x)[0])

    def _raw(self, offsets, flat, x):
        n = np.diff(offsets)
        unit = 1 / np.sqrt(np.maximum(n, 1))
        words = len(self.w) - x.shape[1]
        vx = row_sums(self.v[flat], offsets) * unit[:, None] + x @ self.v[words:]
        v2 = row_sums((self.v[flat] ** 2).sum(axis=1), offsets) * unit**2 + x**2 @ (self.v[words:] ** 2).sum(axis=1)
        linear = row_sums(self.w[flat], offsets) * unit + x @ self.w[words:]
        return self.bias + linear + 0.5 * ((vx**2).sum(axis=1) - v2), vx, unit


def fit(y, offsets, flat, stats, rank: int = 6, epochs: int = 30, rate: float = 0.03, decay: float = 2e-3, seed: int = 3) -> Machine:
    """Adam on the logistic loss, in mini-batches; deterministic."""
    k = stats.shape[1] if stats.size else 11
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + k
    if not len(y):
        return Machine(0.0, np.zeros(size), np.zeros((size, rank)), np.zeros(k), np.ones(k))
    m = Machine(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(size), rng.normal(0, 0.01, (size, rank)), stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3))
    x = np.clip((stats - m.mean) / m.sd, -6, 6)
    words = size - k
    slots = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 1024)):
            step += 1
            lens = np.diff(offsets)[part]
            off = np.concatenate([[0], np.cumsum(lens)])
            ids = flat[np.repeat(offsets[part] - off[:-1], lens) + np.arange(off[-1])]
            z, vx, unit = m._raw(off, ids, x[part])
            g = (sigmoid(z) - y[part]) / len(part)
            gx = g * unit
            gw, gv = decay * m.w / len(part), decay * m.v / len(part)
            rep = np.repeat(gx, lens)
            gw[:words] += np.bincount(ids, rep, minlength=words)
            rep2 = np.repeat(g * unit**2, lens)
            inner = np.repeat(vx, lens, axis=0)
            for f in range(rank):
                gv[:words, f] += np.bincount(ids, rep * inner[:, f] - rep2 * m.v[ids, f], minlength=words)
            gw[words:] += x[part].T @ g
            gv[words:] += x[part].T @ (g[:, None] * vx) - m.v[words:] * (x[part] ** 2).T.dot(g)[:, None]
            m.bias -= rate * g.sum()
            for p, grad, s in zip((m.w, m.v), (gw, gv), slots, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * grad
                s[1] = 0.999 * s[1] + 0.001 * grad**2
                p -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 6000) -> Machine:
    sample = labelled_sample(docs, labels, "quality", usable, rows, ("n_chars",))
    machine = fit(*collect_features(sample, words_of, structure, rows))
    give_back(docs.sparkSession)
    return machine


def _scorer(machine):
    """(texts, n_chars) -> scores; ``machine`` is a broadcast of fixed size: 2^16 hashed words x (rank + 1)."""
    m = machine.value
    ids = WordCache(lambda w: bucket(w, BITS))

    def run(texts: pa.Array, sizes: pa.Array) -> np.ndarray:
        rows = []
        for t in texts.to_pylist():
            found = {ids[w] for w in set(WORD.findall((t or "").lower()))}
            rows.append(np.fromiter(found, np.int64, len(found)))
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        stats = np.array([structure(t or "", n) for t, n in zip(texts.to_pylist(), sizes.to_pylist(), strict=True)], float).reshape(len(rows), -1)
        return m.scores(offsets, np.concatenate(rows), stats) if rows else np.zeros(0)

    return run


def _slices(batches):
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def _inputs(docs: DataFrame, keep: list[str]) -> DataFrame:
    return positional(docs.select("text", F.col("n_chars").cast("long"), *[F.col(f"`{c}`") for c in keep]))


def score(docs: DataFrame, machine: Machine, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, score and predicted for every row of ``docs(text, n_chars)``."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        of = _scorer(sent)
        for b in _slices(batches):
            s = of(b.column(0), b.column(1))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return _inputs(docs, keep).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs(text, n_chars)`` whose score reaches ``threshold``, with the columns of ``docs`` alone, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        of = _scorer(sent)
        for b in _slices(batches):
            good = pa.array(of(b.column(0), b.column(1)) >= threshold)
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in b.columns[2:]], names=docs_columns)

    docs_columns = docs.columns
    return _inputs(docs, docs_columns).mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted; labels with crc32(doc_id) mod 5 = 0 are never learned from."""
    machine = train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0, rows)
    return score(docs, machine, ["doc_id"]).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
