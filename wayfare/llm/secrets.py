r"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two models of order 2, each order backing off to the next lower one, are trained from labelled strings (1: random, 0: ordinary). A long
token outside the fixed patterns is a secret when the log-likelihood ratio, in nats for each character,
reaches a threshold chosen on held-out labelled strings.

Spans count code points, end exclusive. Defined results: a null or empty text has no spans; rows are handled
alone, so repeated rows repeat their result; an empty table gives no rows; further columns are ignored; texts
of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
#: What the models look at: token characters, long enough to carry a secret.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Ordinary words of four languages and of code, the parts of ordinary identifiers.
WORDS = """the of and to in is that for with on was as are by this be at from or have an they which one you were all her she there would their
we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do
first any my now such like our over man me even most made after also did many before must through back years where much your way well down should
value name index count table column user account request response server client config parameter option default result error message handler
service manager factory builder stream buffer reader writer parser token session cache queue thread process memory number string object array list
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei keit heit ung lich schaft
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ses tion ment eau eux elle aire
el los las por con para una su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre ser tiene también me hasta hay
ción mente dad ado ida oso aje ther ing ent ion tio ere her ate ver ati hat ers res ill are con nce edt our""".split()
ORDER = 2
#: How many observations the estimate of the next lower order counts for.
BACKOFF = 4.0


def labelled_samples(n: int = 20_000, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` labelled strings, half of them random keys in several alphabets, half ordinary identifiers."""
    rng = random.Random(seed)
    kinds = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62] + "_-"]
    words = [w for w in WORDS if w.isascii()]
    join = [
        lambda ws: "_".join(ws), lambda ws: "-".join(ws), lambda ws: "".join(ws), lambda ws: "/".join(ws), lambda ws: "".join(w.capitalize() for w in ws),
        lambda ws: ws[0] + "".join(w.capitalize() for w in ws[1:]), lambda ws: "_".join(ws).upper(), lambda ws: "".join(ws).upper(), lambda ws: "".join(ws).capitalize(),
    ]
    tails = [lambda: "", lambda: "", lambda: "", lambda: f"_{rng.randrange(100)}", lambda: f"-v{rng.randrange(20)}", lambda: f"/{rng.randrange(1990, 2031)}", lambda: f"{rng.randrange(10)}", lambda: f"-{rng.randrange(1990, 2031)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"]
    out = []
    for i in range(n):
        if i % 2:
            out.append(("".join(rng.choices(kinds[i // 2 % len(kinds)], k=rng.randrange(16, 65))), 1))
        elif i // 2 % 23 == 0:  # numbers: account and serial numbers, runs, dates
            out.append((rng.choice(["", "id-", "no_", "+"]) + "".join(rng.choices("0123456789", k=rng.randrange(16, 24))), 0))
        else:
            out.append((rng.choice(join)(rng.choices(words, k=rng.randrange(3, 12))) + rng.choice(tails)(), 0))
    return out


class MarkovPair:
    """Character models of order 2 over ALPHABET and one symbol for anything else and the start."""

    def __init__(self, samples: list[tuple[str, int]], held_out: int = 5, false_alarms: float = 0.0005):
        self.code = {c: i + 1 for i, c in enumerate(ALPHABET)}
        n = len(ALPHABET) + 1
        counts = np.zeros((2, n, n, n))
        for i, (s, label) in enumerate(samples):
            if i // 2 % held_out:
                np.add.at(counts[label], tuple(self._grams(s).T), 1)
        p = np.full((2, 1, 1, n), 1 / n)
        for seen in (counts.sum(axis=(1, 2), keepdims=True), counts.sum(axis=1, keepdims=True), counts):
            p = (seen + BACKOFF * p) / (seen.sum(axis=3, keepdims=True) + BACKOFF)
        logs = np.log(p)
        self.ratio = logs[1] - logs[0]
        left = [(self.score(s), y) for i, (s, y) in enumerate(samples) if not i // 2 % held_out]
        ordinary = sorted(x for x, y in left if not y)
        at = ordinary[min(len(ordinary) - 1, math.ceil(len(ordinary) * (1 - false_alarms)))] if ordinary else 0.0
        #: Above nearly all ordinary held-out strings, and never below an even ratio with a margin.
        self.threshold = max(at + 0.05, 0.35)
        self.recall = float(np.mean([x >= self.threshold for x, y in left if y])) if any(y for _, y in left) else 1.0

    def _grams(self, s: str) -> np.ndarray:
        ids = [0] * ORDER + [self.code.get(c, 0) for c in s]
        return np.array([ids[i : i + ORDER + 1] for i in range(len(s))], dtype=np.int64).reshape(-1, ORDER + 1)

    def score(self, s: str) -> float:
        """Log-likelihood ratio for each character; 0 for the empty string."""
        g = self._grams(s)
        return float(self.ratio[g[:, 0], g[:, 1], g[:, 2]].mean()) if len(g) else 0.0


@lru_cache(maxsize=4)
def default_model() -> MarkovPair:
    return MarkovPair(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if _has_digit_run(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _has_digit_run(text: str) -> bool:
    return HEX.search(text) is not None


def markov_spans(text: str, taken: list[tuple[int, int, int]], model: MarkovPair) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        token = m.group()
        if any(s < b and a < e for s, _, e in taken):
            continue
        if model.score(token) >= model.threshold:
            out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None, model: MarkovPair) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + markov_spans(text, base, model))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def find_secrets(docs: DataFrame, samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``; ``samples`` are labelled strings to train from."""
    given = samples

    def run(batches):
        model = MarkovPair(given) if given is not None else default_model()
        for b in batches:
            cols = [[] for _ in range(6)]
            for text in b.column(1):
                base, spans = scan(text.as_py(), model)
                kinds = [k for _, k, _ in spans]
                for c, v in zip(cols, [kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds.count(3)], strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
