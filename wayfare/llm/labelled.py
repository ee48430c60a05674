"""What the trained operators share: a bounded labelled sample, and word features cached by worker."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, more: tuple[str, ...] = ()) -> DataFrame:
    """At most ``rows`` labelled rows, those with the smallest hashes of the id among the ``usable`` ones: label, text, more...

    The ids of the sample are bounded by ``rows``, hence broadcast; the documents are not shuffled.
    """
    ids = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("label"))
    ids = ids.groupBy("l_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).select("label", "text", *more)


def collect_features(sample: DataFrame, extract: Callable[..., np.ndarray], stats: Callable[..., list[float]] | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """labels, offsets, features, statistics of a bounded sample; features are computed where the rows are.

    Rows repeat where the documents table repeats an id, so the rows that reach the driver are limited again.
    """
    names = sample.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            extra = [b.column(2 + i).to_pylist() for i in range(len(names))]
            ids = [extract(t or "").astype(np.int32).tobytes() for t in texts]
            dense = [np.array(stats(t or "", *x), np.float64).tobytes() if stats else b"" for t, *x in zip(texts, *extra)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(dense, pa.binary())], names=["label", "ids", "stats"])

    got = sample.mapInArrow(run, "label double, ids binary, stats binary").limit(limit).toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["ids"][i].as_py(), got["stats"][i].as_py(), got["label"][i].as_py()))
    y = np.array([got["label"][i].as_py() for i in order], float)
    rows = [np.frombuffer(got["ids"][i].as_py(), np.int32) for i in order]
    dense = [np.frombuffer(got["stats"][i].as_py(), np.float64) for i in order]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return y, offsets, flat, np.vstack(dense) if dense else np.zeros((0, 0))


class WordCache(dict):
    """word -> value, computed when missing; starts anew at a bound, so that workers keep bounded memory."""

    def __init__(self, make: Callable, bound: int = 100_000):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, word):
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = self.make(word)
        return value


def bucket(text: str, bits: int, salt: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), salt) & ((1 << bits) - 1)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of ragged ``values``; empty rows give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
