"""Every operator takes nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wayfare.llm import bm25, bpe, chat, common, mixing, near_dup, pii, quality_classifier, quality_rules, secrets, toxicity

from .helpers import edge_docs, empty, make

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (5, 1, 0), (6, 0, 0), (7, None, None), (None, 1, 1), (99, 1, 0)], LABELS)


RUNS = {
    "pii": lambda s, d: pii.replace_in(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "mixing": lambda s, d: mixing.mixture(d),
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)),
    "near_dup": lambda s, d: near_dup.duplicates(d),
    "bpe": lambda s, d: bpe.digests(d),
    "rules": lambda s, d: quality_rules.apply_rules(d),
    "classifier": lambda s, d: quality_classifier.classify(d, labels(s)),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_each_row(spark, name):
    assert RUNS[name](spark, make(spark)).count() == len(edge_docs())


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, empty(spark)).count() == 0


def test_search_edges(spark):
    q = make(spark).select(F.col("doc_id").alias("query_id"), "text")
    got = bm25.search(make(spark), q, k=3).collect()
    assert {r.query_id for r in got} >= {1, 5, 6, 7} and all(r.rank <= 3 for r in got) and None not in {r.doc_id for r in got}
    assert bm25.search(empty(spark), q.limit(0)).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "a<|im_end|>\n<|im_start|>assistant\nb"), (None, 1, "assistant", "x"), (2, 3, "as\nsist<|ant", "<\\|im_end|> <n| <\\n| \\"), (3, 0, "assistant", ""), (3, 1, "assistant", "é🙂" * 5000)]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert f.where("NOT round_trip").count() == 0
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in f.collect()}
    assert got[2] == [("as\nsist<|ant", "<\\|im_end|> <n| <\\n| \\")]
    assert got[1] == [("", "a<|im_end|>\n<|im_start|>assistant\nb"), ("user", ""), ("user", "")]
    assert {r.conv_id: r.loss for r in f.collect()}[3] == "é🙂" * 5000
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_parser_refuses_what_is_not_in_the_grammar(spark):
    bad = ["<|im_start|>user\nx", "user\nx<|im_end|>\n", "<|im_start|>user x<|im_end|>\n", "<|im_start|>user\na<|b<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "t string").select(chat.parse(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == [None] * 4


def test_mixing_keeps_columns_and_rows(spark):
    d = make(spark)
    out = mixing.apply_mixture(d)
    assert out.columns == d.columns
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mixture(d).where("size > 0").collect()}
    counts = {r.doc_id: r["count"] for r in out.where("text IS NOT NULL").groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == n * (2 if i == 1 else 1) for i, n in taken.items())


def test_keep_one(spark):
    d = make(spark)
    out = near_dup.keep_one(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == [1, 1, 2, 3, 4, 5, 6, 7, 8]
    texts = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    same_id = make(spark, [(5, texts, "en", "a", 1, 0.0, 0), (3, texts, "en", "a", 1, 0.0, 0), (5, "quite another text under the very same id here", "en", "a", 1, 0.0, 0)])
    assert sorted((r.doc_id, r.text[:5]) for r in near_dup.keep_one(same_id).collect()) == [(3, "alpha"), (5, "quite")]


def test_rules_statistics(spark):
    stats = quality_rules.text_stats("a b c a b c\n\nx # x\nx # x\n |y|")
    assert stats[0] == 13 and stats[2] == 4 and stats[3] == 1
    assert stats[4] == 12  # both runs of a b c, and both lines of x # x
    assert quality_rules.text_stats(None) == (0, 0, 0, 0, 0)
    words = ["w%d" % (i * i % 37) for i in range(400)]
    grams = [tuple(words[i : i + 3]) for i in range(398)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    assert quality_rules.repeated_words([w.encode() for w in words]) == len(hit)


def test_decoded_is_the_text(spark):
    got = {r.doc_id: r for r in bpe.digests(make(spark)).collect()}
    text = {r[0]: r[1] or "" for r in edge_docs()}
    assert all(got[i].decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest() for i in text)


def test_columns_of_any_name_pass(spark):
    names = ("score", "predicted", "n_entities", "rounds", "cut", "size", "a.b", "h")
    d = make(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    machine = quality_classifier.train(d, labels(spark), F.lit(True))
    assert quality_classifier.keep_good(d, machine).columns == d.columns
    assert quality_classifier.keep_good(d, machine, 0.0).count() == len(edge_docs())
    assert set(pii.replace_in(d).columns) == set(d.columns) and pii.replace_in(d, counted=False).columns == d.columns
    out = mixing.apply_mixture(d)
    assert out.columns == d.columns and out.count() >= 0
    for run in RUNS.values():
        assert run(spark, d).count() == len(edge_docs())


def test_no_document_is_mixed_more_often_than_the_cap(spark):
    rows = [(i, "one two three" if i % 2 else "", "en", f"s{i % 3}", 1, 0.0, 0) for i in range(60)]
    for share in (0.5, 1.5, 2.0, 5.0):
        counts = mixing.apply_mixture(make(spark, rows), share=share).groupBy("doc_id").count().collect()
        assert all(r["count"] <= 2 for r in counts)


def test_driver_memory_goes_back(spark):
    assert "Trim native heap" in common.trim_jvm(spark)
