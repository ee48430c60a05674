"""Small tables with the cases that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h long"


def edge_docs():
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, clashing further columns."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog " * 3, "en", "a", 100, 0.5, 1),
        (1, "the cat sat on the mat and looked at the dog " * 3, "en", "a", 100, 0.5, 1),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, 0.1, 2),
        (4, " \t\n", "en", None, 3, 0.1, 2),
        (None, "a text without an id, seen by none of the others here", "de", "b", 10, 0.1, 2),
        (5, "one two", "en", "b", 7, 0.1, 2),
        (6, "word " * 60_000, "en", "b", 300_000, 0.1, 2),
        (7, "x" * 20_000, None, "c", 20_000, 0.1, 2),
        (8, "naïve 𝔘𝔫𝔦𝔠𝔬𝔡𝔢     \x1c tëxt 漢字 🙂", "fr", "c", 20, 0.1, 2),
    ]
    return rows


def make(spark, rows=None):
    return spark.createDataFrame(edge_docs() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
