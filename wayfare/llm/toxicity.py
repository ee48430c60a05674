"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters. Fixed lexicons, lexicons induced from the labelled sample (words and word beginnings that toxic rows
hold far more often), and patterns say toxic, clean or nothing for a text. The annotators' labels are no voter: they
serve to induce lexicons, and in the end to place the threshold.

Label model. P(class) x P(votes | class), where each voter's vote depends on the class and on one other voter at most:
a tree of the strongest dependencies (mutual information within the classes, Chow and Liu), learned anew as the
posterior improves. Expectation maximisation over labelled and unlabelled rows alike finds the class balance and the
chance of every vote given the class and the vote that it depends on, so voters that repeat each other count once.

Classifier. Logistic regression with weights of 0 or more and an L1 penalty on hashed words and word beginnings,
trained on the posterior labels of all sampled rows. Its score is a sum over distinct words, so every text is scored
whole in one pass. The labelled rows set the bias, so that the fewest of them are on the wrong side of the threshold.

The samples are bounded by ``rows`` labelled and ``rows`` further documents (a documented bound), none of them of the
held-out remainder. Defined results: null and empty texts get the score of
the bias alone; repeated rows repeat their score; an empty table gives no rows; without labelled rows the
fixed lexicons alone are learned from; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, tidy
from .labelled import WORD, WordCache, bucket, collect_features, labelled_sample, row_sums, sigmoid

BITS = 20
#: Word beginnings of these lengths are terms beside whole words.
BEGINNINGS = (4, 5, 6)
#: Mutual information within the classes (nats) from which on one voter's vote depends on another's.
DEPENDS = 0.03
#: Score from which on a text is predicted to be toxic.
THRESHOLD = 0.3
#: Common insults of four languages, one voter each.
LEXICONS = {
    "en": "idiot idiots moron stupid dumb loser losers pathetic scum worthless trash garbage disgusting clown fool ugly filthy vermin jerk".split(),
    "de": "idiot idioten dumm dummkopf trottel abschaum wertlos widerlich ekelhaft versager arschloch dreck depp".split(),
    "fr": "idiot imbécile crétin débile stupide nul ordure minable abruti dégoûtant salaud connard".split(),
    "es": "idiota imbécil estúpido estúpida basura inútil patético asqueroso asquerosa payaso escoria tonto".split(),
}


#: Someone spoken to as something, and words with letters starred out.
SPOKEN = re.compile(r"\b(?:you(?:'re| are)?|du bist|ihr seid|tu es|vous êtes|eres|sois) (?:such |so |an? |ein |eine |un |une |una )?[^\W\d_]{4,}\b[!.]")
STARS = re.compile(r"[^\W\d_][*#@$]{2,}[^\W\d_]?")


def terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-case word: itself, and its beginnings."""
    return (bucket(word, BITS), *(bucket(word[:k], BITS, k) for k in BEGINNINGS if len(word) > k))


def terms_of(text: str) -> np.ndarray:
    found = {t for w in set(WORD.findall(text.lower())) for t in terms(w)}
    return np.sort(np.fromiter(found, np.int64, len(found)))


def patterns(text: str) -> list[float]:
    """Votes of the pattern voters: 1 toxic, -1 clean, 0 nothing."""
    n = max(1, len(text))
    marks, upper, letters = text.count("!") / n, sum(map(str.isupper, text)) / n, sum(map(str.isalpha, text)) / n
    shouted = sum(len(w) > 3 and w.isupper() for w in WORD.findall(text))
    low = text.lower()
    toxic = (marks > 0.02, marks > 0.005, "!!" in text, "!!!" in text, upper > 0.3, upper > 0.15, shouted > 2, SPOKEN.search(low) is not None, STARS.search(text) is not None)
    clean = (n > 400 and not marks, n > 100 and letters > 0.7 and not marks, n > 1500, any(map(str.isdigit, text)))
    return [*map(float, toxic), *(-float(c) for c in clean)]


def induce(y: np.ndarray, offsets: np.ndarray, flat: np.ndarray, most: int, least: float = 0.01, odds: float = 3.0) -> np.ndarray:
    """Terms whose smoothed log odds for toxic rows reach ``odds``, best first; ties by term. Terms of less than the
    share ``least`` of toxic rows, or of fewer than 3, may be there by chance and are left out."""
    size = 1 << BITS
    label = np.repeat(y, np.diff(offsets))
    pos, all_ = np.bincount(flat, label, minlength=size), np.bincount(flat, minlength=size)
    neg = all_ - pos
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    ratio = np.log((pos + 0.5) / n1) - np.log((neg + 0.5) / n0)
    at = np.flatnonzero((pos >= max(3, least * y.sum())) & (ratio >= odds))
    return at[np.lexsort((at, -ratio[at] * np.sqrt(pos[at])))][:most]


def votes(offsets: np.ndarray, flat: np.ndarray, patterned: np.ndarray, induced: np.ndarray, groups: int) -> np.ndarray:
    """Rows x voters: fixed lexicons, ``groups`` induced ones, several suspicious terms, none at all, patterns."""
    n = len(offsets) - 1
    owner = np.zeros(1 << BITS, np.int32)
    sets = [np.unique([bucket(w, BITS) for w in ws]) for ws in LEXICONS.values()]
    sets += [induced[g::groups] for g in range(groups)]
    hits = []
    for s in sets:
        owner[:] = 0
        owner[s] = 1
        hits.append(row_sums(owner[flat], offsets))
    hits = np.array(hits).T if n else np.zeros((0, len(sets)))
    total = hits.sum(axis=1)
    return np.column_stack([(hits > 0).astype(float), (total >= 3).astype(float), -(total == 0).astype(float), patterned.reshape(n, -1)])


def dependencies(joint: np.ndarray, balance: np.ndarray, least: float = DEPENDS) -> list[int]:
    """Each voter's parent in the tree of strongest dependencies, itself for none; parents come first in no order.

    ``joint[class, i, a, j, b]`` is the chance of votes a and b of voters i and j in a class.
    """
    m = joint.shape[1]
    alone = np.einsum("kiaia->kia", joint)
    both = np.log(np.maximum(joint, 1e-12)) - np.log(np.maximum(alone[:, :, :, None, None] * alone[:, None, None, :, :], 1e-12))
    info = np.einsum("k,kiajb,kiajb->ij", balance, joint, both)
    parent = list(range(m))
    reach, best = np.full(m, -1), np.full(m, -np.inf)
    todo, at = set(range(1, m)), 0
    while todo:  # Prim's maximum spanning tree
        better = info[at] > best
        reach[better], best = at, np.maximum(best, info[at])
        at = max(todo, key=lambda j: (best[j], -j))
        todo.remove(at)
        if best[at] >= least:
            parent[at] = int(reach[at])
    return parent


def label_model(v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Posterior of each row, voters' parents, and their chances[class, voter, vote + 1]."""
    n, m = v.shape
    code = (v + 1).astype(int)
    hot = np.stack([code == c for c in range(3)], axis=2).astype(np.float32).reshape(n, 3 * m)
    # to begin with, voters that say the same share one voice
    same = np.abs(np.corrcoef(v + np.random.default_rng(0).normal(0, 1e-6, v.shape), rowvar=False).reshape(m, m)) > 0.8 if n > 1 else np.eye(m)
    q = np.clip(sigmoid(2 * (v / same.sum(axis=1)).sum(axis=1)), 0.02, 0.98)
    parent, own = list(range(m)), np.arange(m)
    for r in range(rounds):
        joint, mass = np.zeros((2, m, 3, m, 3)), np.zeros(2)
        for k, p in enumerate((1 - q, q)):
            mass[k] = p.sum()
            joint[k] = (hot.T @ (hot * p[:, None].astype(np.float32))).reshape(m, 3, m, 3)
        balance = np.clip(mass / max(1e-9, mass.sum()), 1e-3, 1)
        single = np.einsum("kiaia->kia", joint)
        chance = (single + 0.5) / (mass[:, None, None] + 1.5)
        if r % 5 == 0:
            parent = dependencies((joint + 1e-3) / (mass[:, None, None, None, None] + 9e-3), balance)
        z = np.full(n, np.log(balance[1] / balance[0]))
        for j in own:
            if parent[j] == j:
                like = np.log(chance[:, j])
                z += like[1, code[:, j]] - like[0, code[:, j]]
            else:  # the chance of a vote given the parent's, drawn to the chance of the vote alone where few rows tell
                pair = joint[:, parent[j], :, j, :] + 5 * chance[:, j][:, None, :]
                like = np.log(pair / pair.sum(axis=2, keepdims=True))
                z += like[1, code[:, parent[j]], code[:, j]] - like[0, code[:, parent[j]], code[:, j]]
        q = np.clip(sigmoid(z), 1e-4, 1 - 1e-4)
    return q, parent, chance


def fit_linear(q: np.ndarray, offsets: np.ndarray, flat: np.ndarray, epochs: int = 150, rate: float = 0.1, l1: float = 2e-4, least: float = 0.0004) -> tuple[float, np.ndarray]:
    """Proximal Adam on the logistic loss against soft labels; terms of fewer than 3 rows, or of less than the share ``least``, are left out."""
    size = 1 << BITS
    w = np.zeros(size)
    if not len(q):
        return 0.0, w
    seen = np.bincount(flat, minlength=size) >= max(3, least * len(q))
    used = np.flatnonzero(seen)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    inside = seen[flat]
    lens = row_sums(inside.astype(float), offsets).astype(int)
    ids, off = place[flat[inside]], np.concatenate([[0], np.cumsum(lens)])
    u, m1, m2 = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    b = float(np.log(q.mean() / (1 - q.mean())))
    for t in range(1, epochs + 1):
        z = b + row_sums(u[ids], off)
        g = (sigmoid(z) - q) / len(q)
        grad = np.bincount(ids, np.repeat(g, lens), minlength=len(used))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        scale = rate / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-6)
        u = u - scale * m1 / (1 - 0.9**t)
        u = np.maximum(u - np.minimum(scale * l1, 0.5), 0)  # clean words are no excuse: a long text can't outweigh an insult
        b -= 2.0 * g.sum()
    w[used] = u
    return b, w


def place_threshold(z: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> float:
    """What to add to ``z`` so that as few rows as can be are on the wrong side of ``threshold``; the middle of the best gap."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])  # the rows before a cut are called clean
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.diff(edges)
    wrong = np.where(gap > 0, wrong, np.inf)
    best = np.flatnonzero(wrong == wrong.min())
    at = best[gap[best].argmax()]
    return float(np.log(threshold / (1 - threshold)) - (edges[at] + edges[at + 1]) / 2)


def further_sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """At most ``rows`` documents without a label, those with the smallest hashes of the id among the ``usable`` ones."""
    ids = docs.where(usable & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id")).distinct()
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("l_id"))
    ids = ids.join(known, "l_id", "left_anti").orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).select(F.lit(-1.0).alias("label"), "text")


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 8000, most: int = 600, groups: int = 24) -> tuple[float, np.ndarray]:
    sample = labelled_sample(docs, labels, "toxic", usable, rows).unionByName(further_sample(docs, labels, usable, rows))
    y, offsets, flat, patterned = collect_features(sample, terms_of, patterns, 2 * rows)
    if not len(y):
        return 0.0, np.zeros(1 << BITS)
    known = y >= 0
    lens = np.diff(offsets)
    inside = np.repeat(known, lens)
    labelled = np.concatenate([[0], np.cumsum(lens[known])])
    induced = induce(y[known], labelled, flat[inside], most) if known.any() else np.zeros(0, np.int64)
    q = label_model(votes(offsets, flat, patterned, induced, groups))[0]
    bias, weights = fit_linear(q, offsets, flat)
    z = bias + row_sums(weights[flat[inside]], labelled)
    return bias + place_threshold(z, y[known]), weights


def score(docs: DataFrame, bias: float, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32)))  # at most 2^20 terms

    def run(batches):
        table = np.zeros(1 << BITS, np.float32)
        table[sent.value[0]] = sent.value[1]
        worth = WordCache(lambda w: float(table[list(terms(w))].sum()))
        for b in batches:
            z = np.array([bias + sum(map(worth.__getitem__, set(WORD.findall((t.as_py() or "").lower())))) for t in b.column(1)], float)
            s = sigmoid(z)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted; labels with crc32(doc_id) mod 4 = 2 are never learned from."""
    bias, weights = train(docs, labels, crc_mod(F.col("doc_id"), 4) != 2, rows)
    return score(docs, bias, weights).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
