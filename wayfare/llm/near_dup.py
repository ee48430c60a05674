"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds its distinct five-word shingles. Per bucket, the sketch stores the leading zeros of the
smallest hash and ten mantissa bits behind them, 16 bits in all. Long sets are dealt into the buckets by their
hash, short ones are hashed anew for each bucket; sets between SHARED and SHORT have both sketches, so two sets
that may be linked always have one in common. Bands of registers name candidate groups.

Links are found group by group without listing a group's pairs:
1. every member against one member chosen for the whole corpus;
2. what is still apart, against the member with the most links so far;
3. what is still apart, in cells of bounded size: registers name the members whose collision-corrected estimate
   allows a link to another component, their full sets give the links. Groups with very many members outside their
   largest component are first split by a second band. A cell returns members and links, never its pairs.
Every link is confirmed on the full sets. Components follow from confirmed links by label propagation.

Chances: bands of four registers miss a pair of similarity 0.75 with 5e-6, the estimate with less than 1e-6.
Where groups of more than ``LARGE`` members are split by second bands, a pair that shares one band alone may not meet
either: up to 8e-5 in all at 0.75 (none of 32 bands 5e-6, exactly one 7.7e-5).

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are kept; texts
of fewer than five words are one shingle; equal sets are one node however many documents share it; a null id
is no component id while another id is there, and is kept only where no row of its component has an id; rows
that repeat an id and a text share the verdict; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, positional, tidy
from .labelled import WordCache

SHINGLE = 5
REGISTERS, BAND = 128, 4
MANTISSA = 10
SHARED, SHORT = 512, 700
#: A pair is looked at on full sets from this estimate on: 0.75 less five deviations of an estimate on 128 registers.
LOOK = 0.55
#: Members of a group that meet in a cell: of those outside its largest component, and of that component.
BLOCK, CHUNK = 128, 1024
#: Second bands by which groups of more than LARGE members outside their largest component are split: from there
#: on, SECOND smaller groups cost less than the cells that hold all pairs of blocks.
SECOND = 16
LARGE = SECOND * BLOCK

_U = np.uint64
_rng = np.random.default_rng(11)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_AGAIN = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, word_hash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; ``word_hash`` maps a word's bytes to 64 bits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 5)], np.uint64)
    w = np.fromiter(map(word_hash, words), np.uint64, n)
    h = w[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        h = h + w[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(mix(h))


def compress(v: np.ndarray) -> np.ndarray:
    """Registers of smallest hashes: leading zeros and mantissa; never 0, which stands for an empty bucket."""
    top = ((v.astype(np.float64).view(np.uint64) >> _U(52)) & _U(0x7FF)).astype(np.int64) - 1023
    zeros = np.clip(63 - top, 0, 62).astype(np.uint64)
    rest = (v << (zeros + _U(1))) >> _U(64 - MANTISSA)
    return (zeros * _U(1 << MANTISSA) + rest + _U(1)).astype(np.uint16)


def short_sketch(s: np.ndarray) -> bytes:
    return compress(np.multiply(_AGAIN[:, None], s[None, :]).min(axis=1)).tobytes()


def long_sketch(s: np.ndarray) -> bytes:
    bits = REGISTERS.bit_length() - 1
    at = np.searchsorted(s >> _U(64 - bits), np.arange(REGISTERS, dtype=np.uint64))
    full = np.append(s, _U(0))
    own = (full[at] >> _U(64 - bits) == np.arange(REGISTERS, dtype=np.uint64)) & (at < len(s))
    return np.where(own, compress((full[at] << _U(bits)) | _U(1)), 0).astype(np.uint16).tobytes()


def band_keys(registers: np.ndarray, tier: int) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    packed = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), -1)
    salt = mix(np.arange(1, packed.shape[1] + 1, dtype=np.uint64) + _U(1000 * (tier + 1)))
    return mix(packed ^ salt[None, :])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, less the register collisions that unequal sets are expected to have."""
    same = ((a == b) & (a > 0)).sum(axis=-1)
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.169919487159739 * REGISTERS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((same - chance) / np.maximum(used - chance, 1), 0, 1)


def _hasher():
    return WordCache(xxhash.xxh3_64_intdigest).__getitem__


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, node (digest of the set; null for empty sets), short, long (registers)."""

    def run(batches):
        word_hash = _hasher()
        for b in batches:
            cols = [[] for _ in range(4)]
            for t in b.column(1):
                s = shingle_set(t.as_py(), word_hash)
                n = len(s)
                row = (n, xxhash.xxh3_128_digest(s.tobytes()) if n else None, short_sketch(s) if 0 < n <= SHORT else None, long_sketch(s) if n >= SHARED else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n", "node", "short", "long"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, node binary, short binary, long binary")


def bands(nodes: DataFrame) -> DataFrame:
    """key, band, node: the candidate groups; bands of long sketches count on from those of short ones."""

    def run(batches):
        for b in batches:
            for tier, name in enumerate(("short", "long")):
                part = b.filter(b.column(name).is_valid())
                if part.num_rows:
                    keys = band_keys(_registers(part.column(name)), tier)
                    at = np.repeat(np.arange(part.num_rows), keys.shape[1])
                    number = np.tile(np.arange(keys.shape[1], dtype=np.int32) + tier * keys.shape[1], part.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(number), part.column("node").take(pa.array(at))], names=["key", "band", "node"])

    return nodes.select("node", "short", "long").mapInArrow(tidy(run), "key long, band int, node binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def close_enough(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sizes that allow a link at all."""
    return 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those whose sizes and registers allow a link."""
    side = lambda s: nodes.select(*[F.col(c).alias(f"{s}{c}") for c in ("node", "n", "short", "long")])
    both = pairs.join(side("a_"), F.col("a") == F.col("a_node")).join(side("b_"), F.col("b") == F.col("b_node"))
    both = both.where(F.expr("100 * least(a_n, b_n) >= 75 * greatest(a_n, b_n)"))
    use = F.col("a_short").isNotNull() & F.col("b_short").isNotNull()
    both = both.select("a", "b", "a_n", "b_n", F.when(use, F.col("a_short")).otherwise(F.col("a_long")).alias("x"), F.when(use, F.col("b_short")).otherwise(F.col("b_long")).alias("y"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                e = estimate(_registers(b.column(4)), _registers(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy())
                yield b.select(["a", "b"]).filter(pa.array(e >= LOOK))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def _slot(doc_id: Column, bits: int = 22) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << bits)).cast("int")


def _bitmap(ids: DataFrame, bits: int = 22):
    """Broadcast of one bit for each slot of ``ids(id)``: of fixed size, whatever their number."""
    marks = ids.select(_slot(F.col("id"), bits).alias("m")).distinct().toArrow()["m"].to_numpy()  # at most 2^bits numbers
    bitmap = np.zeros(1 << bits, bool)
    bitmap[marks] = True
    return ids.sparkSession.sparkContext.broadcast(np.packbits(bitmap))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set of the ``wanted(node, min_id)``. Documents pass a bitmap of fixed size before anything is shuffled."""
    sent = _bitmap(wanted.select(F.col("min_id").alias("id")))

    def run(batches):
        word_hash, marked = _hasher(), np.unpackbits(sent.value).astype(bool)
        for b in batches:
            some = b.filter(pa.array(marked[b.column(1).to_numpy()]))
            found = [shingle_set(t.as_py(), word_hash).tobytes() for t in some.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())], names=["node", "set"])

    found = docs.where(F.col("text").isNotNull()).select("text", _slot(F.col("doc_id")).alias("at")).mapInArrow(tidy(run), "node binary, set binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those that are linked by their full sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = materialize(sets_of(docs, materialize(nodes.join(ends, "node", "left_semi").select("node", "min_id"), "nd-ends")), "nd-sets")
    both = pairs.join(found.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(found.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                ok.append(_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a binary, b binary"), "nd-links")


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """node, label (least node that can be reached) of every node of ``links(a, b)``: label propagation with jumps."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "nd-both")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "nd-label")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "next", "left").select("node", "label", F.least("next", "far").alias("next")), "nd-label")
        labels = step.select("node", F.col("next").alias("label"))
        if step.where(F.col("label") != F.col("next")).isEmpty():
            return labels
    return _finish(both, labels)


def _finish(both: DataFrame, labels: DataFrame) -> DataFrame:
    """Long chains: go on from the labels found, which shrinks the graph each time."""
    across = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    across = materialize(across.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "nd-across")
    if across.isEmpty():
        return labels
    up = components(across).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return materialize(labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "nd-label")


def _apart(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups with labels, less the groups that lie in one component."""
    g = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = g.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo != hi").select("key", "members")
    return g.join(open_, "key")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def _against(groups: DataFrame, rank: Column) -> DataFrame:
    """Pairs of each group's first member by ``rank`` and the members of other components."""
    top = groups.groupBy("key").agg(F.min_by(F.struct("node", "label"), rank).alias("top"))
    return _ordered(groups.join(top, "key").where("label != top.label").select(F.col("top.node").alias("a"), F.col("node").alias("b")))


def _tops(groups: DataFrame) -> DataFrame:
    """Groups with the label that most of their members have (top), and how many have it or another (held, others)."""
    counts = groups.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    tops = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("held"), (F.sum("c") - F.max("c")).alias("others"))
    return groups.drop("members").join(tops.where("others > 0"), "key")


def _cells(groups: DataFrame) -> DataFrame:
    """Members in cells of bounded size: two parts each, such that all pairs of different components meet in a cell.

    The members of the top component are dealt into parts of CHUNK (numbers below 0), which need not meet each
    other; the others into parts of BLOCK, which meet each other and every part of the top component.
    """
    parts, chunks = F.ceil(F.col("others") / F.lit(BLOCK)).cast("int"), F.ceil(F.col("held") / F.lit(CHUNK)).cast("int")
    at = F.xxhash64("node", F.lit(3))
    is_top = F.col("label") == F.col("top")
    own = F.when(is_top, -1 - F.pmod(at, chunks)).otherwise(F.pmod(at, parts)).cast("int")
    meets = F.when(is_top, F.sequence(F.lit(0), parts - 1)).otherwise(F.sequence(-chunks, parts - 1))
    g = groups.withColumn("own", own).withColumn("with", F.explode(meets))
    return g.select("key", "band", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "label")


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _each_cell(batches, width: int):
    """Rows of a sorted stream, cell by cell; rows begin with key, lo, hi."""
    cell, held = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(width)), strict=True):
            if row[:3] != cell:
                if len(held) > 1:
                    yield held
                cell, held = row[:3], []
            held.append(row)
    if len(held) > 1:
        yield held


def _partners(own: np.ndarray, names: np.ndarray, size: np.ndarray, x: int, inside: bool) -> np.ndarray:
    """Later rows of a cell that row ``x`` is to be compared with."""
    y = np.arange(x + 1, len(own))
    return y[(names[y] != names[x]) & close_enough(size[y], size[x]) & ((own[y] != own[x]) | inside)]


def _numbered(values) -> np.ndarray:
    known: dict = {}
    return np.array([known.setdefault(v, len(known)) for v in values])


def suspects(cells: DataFrame, nodes: DataFrame, once: bool) -> DataFrame:
    """The members of cells whose registers allow a link to another component there: key, lo, hi, own, node, label.

    ``once``: a pair counts only in the group of the first band that it shares, which it meets in if none was split.
    """
    bands_ = REGISTERS // BAND
    regs = F.when(F.col("band") < bands_, F.col("short")).otherwise(F.col("long"))
    rows = _by_cell(cells.join(nodes.select("node", "n", "short", "long"), "node").select("key", "lo", "hi", "own", "node", "label", "n", regs.alias("regs"), "band"))

    def run(batches):
        out = []
        for rows_ in _each_cell(batches, 9):
            _, lo, hi, own, _, label, n, regs_, band = zip(*rows_, strict=True)
            r, own, names, size = np.frombuffer(b"".join(regs_), np.uint16).reshape(len(rows_), REGISTERS), np.array(own), _numbered(label), np.array(n)
            hit = np.zeros(len(rows_), bool)
            packed = r.view(np.uint64)
            for x in range(len(rows_) - 1):
                y = _partners(own, names, size, x, lo[0] == hi[0])
                if once and len(y):
                    y = y[(packed[y] == packed[x]).argmax(axis=1) == band[0] % bands_]
                if len(y):
                    found = y[estimate(r[y], r[x][None, :], size[y], size[x]) >= LOOK]
                    hit[found] = True
                    hit[x] |= len(found) > 0
            out += [rows_[i][:6] for i in np.flatnonzero(hit)]
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return rows.mapInArrow(tidy(run), "key long, lo int, hi int, own int, node binary, label binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "lo", "hi", "own", "node", "label"])


def links_in(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links inside cells, on the full sets; a component that is already reached in a cell needs no second link there."""
    rows = _by_cell(found.join(sets, "node").select("key", "lo", "hi", "own", "node", "label", "set"))

    def run(batches):
        out = []
        for rows_ in _each_cell(batches, 7):
            _, lo, hi, own, node, label, sets_ = zip(*rows_, strict=True)
            full = [np.frombuffer(x, np.uint64) for x in sets_]
            own, size, names = np.array(own), np.array([len(x) for x in full]), _numbered(label)
            for x in range(len(rows_) - 1):
                y = _partners(own, names, size, x, lo[0] == hi[0])
                for k in y:
                    if names[k] != names[x] and _linked(full[x], full[k]):
                        out.append((node[x], node[k]))
                        names[names == names[k]] = names[x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in range(2)], names=["a", "b"])

    return _ordered(rows.mapInArrow(tidy(run), "a binary, b binary"))


def _linked(s: np.ndarray, t: np.ndarray) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= 75 * (len(s) + len(t) - common)


def _split(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups by their key and a second band of the member: smaller groups, several for each member."""
    bands_ = REGISTERS // BAND
    regs = F.when(F.col("band") < bands_, F.col("short")).otherwise(F.col("long"))
    g = groups.join(nodes.select("node", "short", "long"), "node").select("key", "band", "node", regs.alias("regs"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            first, band = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy() % bands_
            pick = (band[:, None] + np.arange(1, SECOND + 1)[None, :]) % bands_  # never the band that the group has in common
            second = mix(np.take_along_axis(band_keys(_registers(b.column(3)), 7), pick, axis=1) ^ first[:, None])
            at = pa.array(np.repeat(np.arange(b.num_rows), SECOND))
            yield pa.RecordBatch.from_arrays([pa.array(second.ravel().view(np.int64)), b.column(1).take(at), b.column(2).take(at)], names=["key", "band", "node"])

    return g.mapInArrow(tidy(run), "key long, band int, node binary")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``."""
    return verdicts(docs).drop("node")


def verdicts(docs: DataFrame) -> DataFrame:
    seen = materialize(sketches(docs), "nd-sketch")
    nodes = seen.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("min_id"), F.first("n").alias("n"), F.first("short").alias("short"), F.first("long").alias("long"))
    nodes = materialize(nodes, "nd-nodes")
    band = bands(nodes)
    shared = band.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    groups = materialize(band.join(shared, "key"), "nd-groups")

    alone = nodes.limit(0).select("node", F.col("node").alias("label"))
    priority = F.struct(F.xxhash64("node"), F.col("node"))
    tested = materialize(likely(_against(_apart(groups, alone), priority), nodes), "nd-pairs")
    links = confirmed(docs, tested, nodes)
    labels = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = _apart(groups, labels).join(degree, "node", "left")
    hub = F.struct(-F.coalesce("degree", F.lit(0)), F.xxhash64("node"), F.col("node"))
    more = materialize(likely(_against(ranked, hub).join(tested, ["a", "b"], "left_anti"), nodes), "nd-pairs")
    links2 = confirmed(docs, more, nodes)
    links = links.union(links2)
    labels = components(links)

    open_ = materialize(_tops(_apart(groups, labels)), "nd-open")
    huge = open_.where(F.col("others") > LARGE)
    once = huge.isEmpty()
    cells = _cells(open_.where(F.col("others") <= LARGE))
    if not once:
        cells = cells.unionByName(_cells(_tops(_apart(_split(huge, nodes), labels))))
    found = materialize(suspects(cells, nodes, once), "nd-suspects")
    sets = sets_of(docs, nodes.join(found.select("node").distinct(), "node", "left_semi").select("node", "min_id"))
    links = links.union(links_in(found, sets))
    labels = components(links)

    named = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "min_id")
    ids = named.groupBy("label").agg(F.min("min_id").alias("component_id"))
    place = named.join(ids, "label").select("node", "component_id")
    out = seen.select("doc_id", "n", "node").join(place, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "node", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Only rows whose id may be one of those that go (a bitmap of fixed size says so) are joined with them, by id and set.
    """
    gone = materialize(verdicts(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id"), "node").distinct(), "nd-gone")
    sent = _bitmap(gone)
    names = docs.columns
    place = names.index("text")
    schema = docs.select("*", F.lit(0).alias("__slot"), F.lit(b"").alias("__node")).schema

    def suspects(wanted: bool):
        def run(batches):
            word_hash, marked = _hasher(), np.unpackbits(sent.value).astype(bool)
            for b in batches:
                some = b.filter(pa.array(marked[b.column(len(names)).to_numpy()] == wanted))
                nodes = [xxhash.xxh3_128_digest(shingle_set(t.as_py(), word_hash).tobytes()) if wanted else b"" for t in some.column(place)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(nodes, pa.binary())], names=[*names, "__slot", "__node"])

        return positional(docs.withColumn("__slot", _slot(F.col("doc_id")))).mapInArrow(tidy(run), schema)

    g = gone.select(F.col("id").alias("__id"), F.col("node").alias("__gone"))
    rest = suspects(True).join(g, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__gone")), "left_anti")
    kept = [f"`{c}`" for c in names]
    return suspects(False).select(*kept).unionByName(rest.select(*kept))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id, w.doc_id = coalesce(c.m, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
