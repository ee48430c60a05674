"""Byte-level BPE encoding and decoding.

Texts are cut into pretokens by the tokenizer's pattern. Within a slice of documents, the distinct pretokens
meet a fold of Spark's higher-order functions: from the ranks of single bytes, each step merges the leftmost
pair of least rank, looked up in a literal rank map, until no pair has a rank. The map is a hash table without
collisions, as array literals, from pairs of ranks to the rank of both together: Spark's own maps are searched
entry by entry. Documents carry numbers of distinct pretokens,
so that nothing is shuffled: cut (Python), fold (Catalyst expressions), put together (Python) run in one stage.

The public pattern is cut by array operations: its tokens begin where the class of the code point (white space,
letter, digit, other) changes, with rules for a leading space and for contractions. Other patterns are matched as
they are. Pretokens of at most 32 bytes are told apart by these bytes, held as four numbers, longer ones as objects.

Frequent pretokens of a bounded sample are folded once and sent to the tasks, at most ``frequent`` of them at about
60 bytes each. That table only saves work; every other pretoken is folded where it occurs, once a slice.

Decoding concatenates the binary pieces of the ids, taken from a literal array of pieces by Spark functions.

Defined results: null and empty texts have no ids and decode to nothing; texts are processed whole, each
pretoken alone, special tokens are ordinary text; repeated rows repeat their result; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, positional, tidy

#: Bits of a rank: a vocabulary has fewer than 2^20 pieces. Buckets of the hash table of pairs.
RANK_BITS, DEALT = 20, 1 << 16
#: Factors that spread keys inside the table; the first one that suits the vocabulary is taken.
SPREADS = (611953, 1299709, 15485863, 32452843, 49979687)
#: The low bits of a state's numbers hold a piece's rank; from NO_PAIR on, the piece makes no pair with the next.
FIRST, NO_PAIR = (1 << RANK_BITS) - 1, 1 << (2 * RANK_BITS)
#: Bytes of text that a slice gathers before its distinct pretokens are folded; longer documents are slices of their own.
SLICE = 1_500_000
#: Bytes of a pretoken that its four numbers hold.
SHORT = 32


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank, from a file of base64 pieces and ranks on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    return [piece for _, piece in pairs]


def merges(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pairs of ranks, and the rank of the piece that both make together, for every way to cut a piece in two pieces."""
    rank = {p: r for r, p in enumerate(pieces)}
    keys, ranks = [], []
    for r, p in enumerate(pieces):
        for k in range(1, len(p)):
            a, b = rank.get(p[:k]), rank.get(p[k:])
            if a is not None and b is not None:
                keys.append(a * (len(pieces) + 1) + b)
                ranks.append(r)
    return np.array(keys, np.int64), np.array(ranks, np.int64)


def placed(keys: np.ndarray, ranks: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Spread, shifts and entries of a hash table without collisions: pairs of one bucket (low bits of the key) are
    shifted together until all are free. An entry is key x 2^RANK_BITS + rank; a free one is 0, or beyond all keys
    where key 0 looks."""
    size = 1 << max(4, (len(keys) * 3 // 2).bit_length())
    bucket = keys & (DEALT - 1)
    order = np.argsort(bucket, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=DEALT))])
    for spread in SPREADS:
        base = ((keys >> 16) * spread) & (size - 1)
        if len(np.unique(bucket * size + base)) == len(keys):
            break
    else:
        raise ValueError("pairs of one bucket fall together under every spread")
    shift, entries, free = np.zeros(DEALT, np.int64), np.zeros(size, np.int64), np.ones(size, bool)
    steps = np.arange(16)
    count = np.diff(edges)
    for b in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
        own = order[edges[b] : edges[b + 1]]
        begin = b * 2654435761  # buckets look from places of their own
        for first in range(begin, begin + size, len(steps)):
            at = (base[own][:, None] + (first + steps)) & (size - 1)
            fits = free[at].all(axis=0)
            if fits.any():
                d = int(fits.argmax())
                shift[b], place = (first + d) & (size - 1), at[:, d]
                entries[place], free[place] = (keys[own] << RANK_BITS) + ranks[own], False
                break
        else:
            raise ValueError("the table of pairs is too full")
    single = np.flatnonzero(count == 1)  # these fit in any free place
    own, place = order[edges[single]], np.flatnonzero(free)[: len(single)]
    shift[single] = (place - base[own]) & (size - 1)
    entries[place], free[place] = (keys[own] << RANK_BITS) + ranks[own], False
    if free[shift[0] & (size - 1)]:
        entries[shift[0] & (size - 1)] = 1 << 62
    return spread, shift, entries


@functools.lru_cache(maxsize=4)
def _literals(pieces: tuple[bytes, ...]) -> tuple[int, int, str, str]:
    spread, shift, entries = placed(*merges(list(pieces)))
    single = {p: r for r, p in enumerate(pieces) if len(p) == 1}
    table = json.dumps({"shift": shift.tolist(), "entries": entries.tolist(), "bytes": [single[bytes([b])] for b in range(256)]}, separators=(",", ":"))
    return spread, len(entries), table, json.dumps([p.decode("latin-1") for p in pieces])


class RankMap:
    """The rank map as literal arrays, and its lookups as column expressions.

    The table stands in a scalar subquery of one row: a plan holds it once, not once for each copy and printed form of
    the deep expression that uses it. Expressions over rows of many words take it from a column, ``with_table``.
    """

    def __init__(self, spark: SparkSession, pieces: list[bytes]):
        if len(pieces) >= FIRST:
            raise ValueError("ranks have 20 bits")
        self.edge = len(pieces)  # stands before and behind a word; no pair has it
        self.spread, self.size, table, own = _literals(tuple(pieces))
        one = spark.range(1)
        self.table = one.select(F.from_json(F.lit(table), "shift array<bigint>, entries array<bigint>, bytes array<bigint>").alias("table")).scalar()
        # constant folding turns the parsed text into an array literal
        self.pieces = F.from_json(F.lit(own), "array<string>")

    def with_table(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__table", self.table)

    def pair(self, a: Column, b: Column) -> Column:
        """Key of a pair and its first rank in one number."""
        return F.shiftleft(a * _long(self.edge + 1) + b, RANK_BITS) + a

    def look(self, table: Column, pairs: Column) -> Column:
        """For each pair its rank x 2^RANK_BITS + its first rank; of pairs without a rank the number is NO_PAIR or more."""

        def one(x: Column) -> Column:
            key = F.shiftright(x, RANK_BITS)
            at = (F.shiftright(key, 16) * _long(self.spread) + F.get(table["shift"], key.bitwiseAND(_long(DEALT - 1)).cast("int"))).bitwiseAND(_long(self.size - 1)).cast("int")
            # an entry of this key leaves its rank; one of any other key differs above the bits of ranks
            rank = F.least(F.get(table["entries"], at).bitwiseXOR(F.shiftleft(key, RANK_BITS)), _long((1 << 41) - 1))
            return F.shiftleft(rank, RANK_BITS) + x.bitwiseAND(_long(FIRST))

        return F.transform(pairs, one)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(word: Column, ranks: RankMap, table: Column) -> Column:
    """Ranks of the pieces of ``word`` (bytes as the characters U+0000 to U+00FF) after all merges.

    The state is one array: for each piece its rank and, above it, the rank that it makes with the next piece. The
    least number names the pair to merge next, its first place the leftmost one.
    """
    size = F.length(word)
    edge = F.array(_long(ranks.edge))
    own = F.concat(edge, F.transform(F.sequence(F.lit(1), size), lambda i: F.get(table["bytes"], F.ascii(F.substring(word, i, F.lit(1))))), edge)

    def state(c: Column) -> Column:
        return F.struct(c.alias("c"), F.array_min(c).alias("least"))

    # the first step looks all pairs up, the others the two beside a merged one; the map stands in the plan once
    none = F.slice(own, F.lit(1), F.lit(0))
    start = F.struct(none.alias("c"), _long(-1).alias("least"))

    def step(s: Column, _: Column) -> Column:
        c, least = s["c"], s["least"]
        first = least < 0

        def merge(i: Column) -> Column:
            new = F.shiftright(least, RANK_BITS)  # the rank of a merged pair is that of its piece
            before, behind = F.get(c, i - 2).bitwiseAND(_long(FIRST)), F.get(c, i + 1).bitwiseAND(_long(FIRST))
            every = let(own, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: ranks.pair(a, F.coalesce(b, _long(ranks.edge)))))
            found = ranks.look(table, F.when(first, every).otherwise(F.array(ranks.pair(before, new), ranks.pair(new, behind))))
            left, right = F.slice(c, F.lit(1), F.greatest(i - 2, F.lit(0))), F.slice(c, i + 2, F.size(c))
            return let(F.when(first, found).otherwise(F.concat(left, found, right)), state)

        return F.when(least >= _long(NO_PAIR), s).otherwise(let(F.array_position(c, least).cast("int"), merge))

    inner = lambda s: F.transform(F.slice(s["c"], F.lit(2), F.size(s["c"]) - 2), lambda x: x.bitwiseAND(_long(FIRST)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), size), start, step, inner)


def fold_all(words: str, ranks: RankMap) -> Column:
    """Ranks for each of an array of words (bytes), in a row of :meth:`RankMap.with_table`."""
    return let(F.col("__table"), lambda t: F.transform(words, lambda w: fold(F.decode(w, "ISO-8859-1"), ranks, t)))


def bundled(words: DataFrame, most: int = 4096) -> DataFrame:
    """words: arrays of at most ``most`` of ``words(word)``."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.column(0).slice(at, most)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["words"])

    return words.mapInArrow(tidy(run), "words array<binary>")


def decode(ids: Column, ranks: RankMap) -> Column:
    """The bytes of ``ids``: their pieces, one after another."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(ranks.pieces, i)), ""), "ISO-8859-1")


#: Classes of code points.
WHITE, LETTER, DIGIT, OTHER = range(4)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point under the public pattern's own classes."""
    found = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, points))
    for code, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            found[points[m.start() : m.end()]] = code
    return found


def _shifted(x: np.ndarray, by: int, fill) -> np.ndarray:
    """x[i + by] at i for ``by`` 1 or -1, ``fill`` beyond the ends."""
    edge = np.array([fill], x.dtype)
    return np.concatenate([x[1:], edge]) if by > 0 else np.concatenate([edge, x[:-1]])


def public_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the public pattern's tokens begin among code points; ``first`` marks the beginnings of texts."""
    kind = classes()[code]
    before = _shifted(kind, -1, 255)
    change = (kind != before) | first
    last = _shifted(first, 1, True)  # the last code point of its text
    after = _shifted(kind, 1, WHITE)
    white = kind == WHITE
    spaced = _shifted(code == 32, -1, False) & ~first
    starts = (white & (change | (~last & (after != WHITE)))) | (~white & change & ~spaced)
    quote = np.flatnonzero((code == 39) & starts & ~last & (after == LETTER))
    if len(quote):
        one, two = code[quote + 1], np.where(quote + 2 < len(code), code[np.minimum(quote + 2, len(code) - 1)], 0)
        two = np.where(last[quote + 1], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quote[short | long_] + 1] = False
        for at, n in ((quote[short], 2), (quote[long_], 3)):
            at = at + n
            starts[at[at < len(code)]] = True
    return starts


def cut_points(data: np.ndarray, edges: np.ndarray, pattern: str) -> np.ndarray:
    """First bytes of all pretokens of the texts that ``data`` (UTF-8 bytes) holds between ``edges``."""
    if pattern != public_tokenizers.PATTERN:
        full, out = regex.compile(pattern).findall, []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            size = [len(w.encode()) for w in full(data[a:b].tobytes().decode())]
            out.append(a + np.cumsum([0, *size[:-1]]) if size else np.zeros(0, np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
    first = np.zeros(len(code), bool)
    begins = edges[:-1][edges[1:] > edges[:-1]]
    first[np.searchsorted(at, begins)] = True
    return at[public_starts(code, first)]


MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def numbers_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 32 bytes of each word as four numbers, zeros behind its end. ``data`` has 40 bytes behind the last word."""
    window = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.zeros((4, len(start)), np.uint64)
    out[0] = window[start] & MASKS[np.minimum(size, 8)]
    for k in range(1, 4):
        some = np.flatnonzero(size > 8 * k)
        out[k, some] = window[start[some] + 8 * k] & MASKS[np.minimum(size[some] - 8 * k, 8)]
    return out


def mixed(numbers: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word; equal hashes are never taken for equal words."""
    h = size.astype(np.uint64)
    for n, f in zip(numbers, FACTORS, strict=True):
        h = (h ^ n) * f
        h ^= h >> np.uint64(29)
    return h


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words as a binary array."""
    ends = np.cumsum(size)
    flat = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


class Words:
    """The pretokens of some texts: ``code`` is each one's number among the distinct words, which begin at ``start`` and have ``size`` bytes."""

    def __init__(self, texts: pa.Array, pattern: str):
        texts = pc.fill_null(texts, "")
        edges = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        plain = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None and len(edges) else np.zeros(0, np.uint8)
        self.data = np.concatenate([plain, np.zeros(40, np.uint8)])
        edges = edges - edges[0]
        begin = cut_points(plain, edges, pattern)
        self.bounds = np.searchsorted(begin, edges)  # tokens of text i: bounds[i] to bounds[i + 1]
        length = np.diff(np.append(begin, len(plain)))
        numbers = numbers_of(self.data, begin, length)
        _, rep, self.code = np.unique(mixed(numbers, length), return_index=True, return_inverse=True)
        same = (length <= SHORT) & (length[rep][self.code] == length)
        for n in numbers:
            same &= n[rep][self.code] == n
        other = np.flatnonzero(~same)  # long words, and words whose hash is another one's
        word = lambda i: plain[begin[i] : begin[i] + length[i]].tobytes()
        own = {word(rep[j]): j for j in np.flatnonzero(length[rep] > SHORT).tolist()}
        more: list[int] = []
        for i in other.tolist():
            w = word(i)
            if w not in own:
                own[w] = len(rep) + len(more)
                more.append(i)
            self.code[i] = own[w]
        rep = np.concatenate([rep, np.array(more, np.int64)]) if more else rep
        self.start, self.size, self.numbers = begin[rep], length[rep], numbers[:, rep]

    def counts(self) -> np.ndarray:
        return np.bincount(self.code, minlength=len(self.start))


class WordTable:
    """Words of at most 32 bytes to places, told apart by all their bytes."""

    def __init__(self, words: pa.Array):
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        data = np.concatenate([np.frombuffer(b"".join(words.to_pylist()), np.uint8), np.zeros(40, np.uint8)])
        numbers = numbers_of(data, start, size)
        h = mixed(numbers, size)
        order = np.argsort(h, kind="stable")
        short = order[size[order] <= SHORT]
        self.source = short[np.append(True, h[short][1:] != h[short][:-1])] if len(short) else short  # one word for each hash
        self.hash, self.numbers, self.size = h[self.source], numbers[:, self.source], size[self.source].astype(np.uint8)

    def places(self, words: Words) -> np.ndarray:
        """Place of each distinct word, -1 for words that the table has not."""
        if not len(self.hash):
            return np.full(len(words.start), -1)
        h = mixed(words.numbers, words.size)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        hit = (self.hash[at] == h) & (self.size[at] == words.size)
        for mine, theirs in zip(self.numbers, words.numbers, strict=True):
            hit &= mine[at] == theirs
        return np.where(hit, at, -1)


def slices(batches, least: int = SLICE):
    """Batches of about ``least`` bytes in their first column."""
    held, size = [], 0
    for b in batches:
        step = max(1, int(b.num_rows * least / max(1, b.column(0).nbytes)))
        for at in range(0, b.num_rows, step):
            held.append(b.slice(at, step))
            size += held[-1].column(0).nbytes
            if size >= least:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def frequent_words(docs: DataFrame, pattern: str, sample: int, most: int) -> DataFrame:
    """word (bytes): pretokens that a sample of about ``sample`` documents holds twice or more, at most ``most``."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(1, total)))))

    def run(batches):
        for t in slices(batches):
            words = Words(_chunk(t.column(0)), pattern)
            short = words.size <= SHORT
            yield pa.RecordBatch.from_arrays([gathered(words.data, words.start[short], words.size[short]), pa.array(words.counts()[short])], names=["word", "n"])

    words = materialize(part.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "bpe-words")
    # the least count that at most ``most`` words reach, from the distribution of counts
    steps = words.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect()  # at most 1000 rows
    have, least = 0, 1001
    for s in steps:
        if have + s["count"] > most:
            break
        have, least = have + s["count"], s["n"]
    return words.where(F.col("n") >= least).select("word")


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], frequent: int = 700_000, sample: int = 80_000) -> DataFrame:
    """``keep`` columns, ids (little-endian unsigned 32-bit integers) and decoded (bytes) for every row of ``docs(text)``."""
    spark = docs.sparkSession
    give_back(spark)
    # the session keeps the text of executed plans, in which the literals would stand in full
    spark.conf.set("spark.sql.maxPlanStringLength", min(100_000, int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b"))))
    ranks = RankMap(spark, read_ranks(path))
    bundles = ranks.with_table(bundled(frequent_words(docs, pattern, sample, frequent)))
    folded = bundles.select(F.explode(F.arrays_zip("words", fold_all("words", ranks).alias("ids"))).alias("w")).select(F.col("w.words").alias("word"), F.col("w.ids").alias("ids"))
    known = materialize(folded, "bpe-known").toArrow()  # at most ``frequent`` rows of at most 32 bytes
    table = WordTable(known["word"].combine_chunks())
    known_ids = known["ids"].combine_chunks().take(pa.array(table.source))
    base = len(table.hash)
    del table.source
    # two broadcasts: each of the two kinds of workers holds one of them
    sent_words = spark.sparkContext.broadcast(table)
    sent_ids = spark.sparkContext.broadcast((known_ids.flatten().to_numpy().astype("<u4"), np.diff(known_ids.offsets.to_numpy()).astype(np.uint8)))
    del known, known_ids, table
    give_back(spark)

    fields = docs.select(*keep).schema
    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    doc_type = f"struct<{inner}, codes: binary>"

    def cut(batches):
        for t in slices(batches):
            words = Words(_chunk(t.column(0)), pattern)
            place = sent_words.value.places(words)
            rare = place < 0
            place[rare] = base + np.arange(rare.sum())
            codes = place.astype(np.int32)[words.code]
            flat = pa.Array.from_buffers(pa.binary(), t.num_rows, [None, pa.py_buffer((words.bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
            docs_ = pa.StructArray.from_arrays([*(_chunk(t.column(i + 1)) for i in range(len(keep))), flat], names=[*keep, "codes"])
            own = gathered(words.data, words.start[rare], words.size[rare])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, docs_)], names=["words", "docs"])

    def join(batches):
        flat0, lens0 = sent_ids.value
        for b in batches:
            for words, rows in zip(b.column(0), b.column(1), strict=True):
                own, table = words.values, rows.values
                some = own is not None and len(own)
                flat = np.concatenate([flat0, own.flatten().to_numpy().astype("<u4")]) if some else flat0
                lens = np.concatenate([lens0, np.diff(own.offsets.to_numpy())]) if some else lens0.astype(np.int32)
                ends0 = np.cumsum(lens, dtype=np.int64)
                codes_ = table.field("codes")
                offsets = np.frombuffer(codes_.buffers()[1], np.int32)[codes_.offset : codes_.offset + len(codes_) + 1] // 4
                codes = np.frombuffer(codes_.buffers()[2], np.int32)[offsets[0] : offsets[-1]] if codes_.buffers()[2] is not None else np.zeros(0, np.int32)
                n = lens[codes].astype(np.int64)
                ends = np.cumsum(n)
                ids = flat[np.repeat(ends0[codes] - n - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
                data = pa.py_buffer(ids.tobytes())
                binary = pa.Array.from_buffers(pa.binary(), len(codes_), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), data])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.Array.from_buffers(pa.int32(), len(ids), [None, data]))
                out = pa.RecordBatch.from_arrays([*[table.field(k) for k in keep], binary, lists], names=[*keep, "ids", "tokens"])
                step = max(1, int(out.num_rows * SLICE / max(1, 8 * len(ids))))
                yield from (out.slice(at, step) for at in range(0, out.num_rows, step))

    cutted = positional(docs.select(F.col("text").cast("string"), *keep)).mapInArrow(tidy(cut), f"words array<binary>, docs array<{doc_type}>")
    ready = ranks.with_table(cutted).select(fold_all("words", ranks).alias("words"), "docs")
    out = docs.select(*keep).schema.add("ids", "binary").add("tokens", T.ArrayType(T.IntegerType()))
    return ready.mapInArrow(tidy(join), out).select(*keep, "ids", decode(F.col("tokens"), ranks).alias("decoded"))


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs(doc_id, text)``."""
    found = encode(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern, ["doc_id"])
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
