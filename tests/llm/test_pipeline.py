"""The corpus pipeline: each stage against a plain version of it, and on tables with edge cases."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm import bpe, mixing, pii, quality_classifier

from .helpers import empty, make
from .test_brute import WORD, components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage, as run() chains them."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_good_documents_stay(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    machine = quality_classifier.train(before, labels, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    good = {r.doc_id for r in quality_classifier.score(before, machine, ["doc_id"]).where("score >= 0.3").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == good


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    sets = {}
    for i, t in texts(before).items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, root in components(sets).items() if i == root}


def test_personal_data_goes(stages):
    before, after = (texts(x) for x in stages[2])
    known = {(k, pii.canonical(k, t[a:b])) for t in before.values() for a, b, k in pii.find(t)}
    surrogates = collections.defaultdict(set)
    for i, t in before.items():
        mine, new = pii.find(t), pii.find(after[i])
        gaps = lambda text, spans: [text[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(text)], strict=True)]
        assert gaps(t, mine) == gaps(after[i], new), "nothing but entities changes"
        for (a, b, k), (x, y, _) in zip(mine, new, strict=True):
            surrogates[k, pii.canonical(k, t[a:b])].add(pii.canonical(k, after[i][x:y]))
    assert known and all(len(s) == 1 for s in surrogates.values())
    assert not known & {(k, s) for (k, _), v in surrogates.items() for s in v}


def test_sources_come_near_their_targets(stages):
    before, after = stages[3]
    plan = {r.doc_id: r for r in mixing.mixture(before).collect()}
    counts = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    for i, r in plan.items():
        assert counts.get(i, 0) <= 2 and (r["size"] == 0 or counts.get(i, 0) * r["size"] == r.taken)
    source = {r.doc_id: r.source for r in before.select("doc_id", "source").collect()}
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for i, r in plan.items():
        taken[source[i]] += r.taken
        target[source[i]], largest[source[i]] = r.target, max(largest[source[i]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_documents_are_encoded_as_the_library_does(stages):
    before, after = stages[4]
    pieces = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    want = texts(before)
    assert after.count() == before.count()
    for r in after.collect():
        ids = enc.encode_ordinary(want[r.doc_id])
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_stages_take_edge_cases(spark):
    extra = ("score", "predicted", "n_entities", "rounds", "cut", "ids", "words", "a.b")
    for docs in (make(spark), make(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(1).alias(c) for c in extra]), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, DATA)
            assert after.count() >= 0
            if after.columns != docs.columns:
                assert stage is corpus_pipeline.encode and after.count() == docs.count()
