"""Exact Jaccard self-join of word n-gram sets by universe partition.

Two sets of a pair that reaches the similarity differ in at most ``H`` elements,
where H follows from the smaller size. Sizes fall into bands. For each band the
universe of shingles is split by hash into ``m = H + 1`` segments, so by the
pigeonhole principle a pair agrees on at least one whole segment subset. A set
indexes its subsets in its own band's scheme and in the lower ones that hold
possible partners.

Cost-based allocation: an empty subset is shared by a fixed part of all sets and
would pair them all, so it gets no share of the error budget. What that loses is
made good where it is cheapest: if a pair agrees on i empty segments only, then
of any i segments that both fill and that differ, one differs by a single
element. A set with empty segments therefore also indexes, for its first few
filled segments, the subset and its one-deletion neighbours. That holds as long
as neither set has more empty segments than half of all, nor than the segments
so indexed. (If a set has more, its pairs are found through those empty
segments. All sets index those, but only keys that such a set shares are kept.)

In a few rounds each key offers one of its sets to the others; verified links
make components, and at last all pairs of different components that share a key
are looked at: in crowded keys block by block, without forming the pairs. No link is lost, and a large group of near copies costs a few
comparisons a member. Candidates are first compared on short parity sketches,
which bound the difference from below, then verified on whole shingle sets.

Equal sets are one node, named by a 64-bit digest of the sorted shingle hashes.
A second digest of 64 bits parts sets that share the first one: those few (some
n**2 / 2**65 of n) take the second as their name.

The plan is one for all sizes: the sets to verify are fetched through filters of
fixed size, which let more rows pass when they fill up.

Defined results: a null text or one without words has no shingles and links with
nothing; fewer words than n are one shingle; equal ids are one component with
their partners; a row without an id links like any other, and a component of
such rows alone has none; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from halyard.llm.common import SPACE_RE, Workspace, bit_filter, maybe_in, row_hash, text_or_empty, whole_rows

BAND_RATIO = 1.3
CACHE_WORDS = 300_000
ROWS_OUT = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)
_SALT_SEGMENT, _SALT_SUBSET, _SALT_NEAR, _SALT_EMPTY, _SALT_SKETCH = (np.uint64(s) for s in (0x51, 0x52, 0x53, 0x54, 0x55))
SKETCH_BITS = 2048
#: Rounds in which each key offers one member to the others, before the rest of
#: the pairs is formed.
STAR_ROUNDS = 2
#: Keys of more sets than this are compared by blocks of about so many rows; a key of
#: fewer gives six pairs at most.
CROWD = 4
BLOCK_ROWS = 1024


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Scheme:
    """Bands, segment counts and reach for a similarity in whole percent."""

    def __init__(self, percent: int):
        self.percent = percent
        his, lo = [], 1
        while lo < 1 << 40:
            his.append(max(lo, int(lo * BAND_RATIO)))
            lo = his[-1] + 1
        self.his = np.array(his)

    def errors(self, size: int) -> int:
        """Most elements in which a partner of at least this size may differ."""
        return (100 - self.percent) * (100 * size // self.percent) // 100

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.his, size))

    def bands(self, size: int) -> range:
        least = -(-self.percent * size // 100)
        return range(self.band(max(1, least)), self.band(size) + 1)

    def segments(self, band: int) -> int:
        return self.errors(int(self.his[band])) + 1

    def covered(self, segments: int) -> int:
        """Filled segments whose neighbourhoods a set with empty ones indexes."""
        return segments // 20 + 6

    def bearable(self, segments: int) -> int:
        """Empty segments up to which those neighbourhoods find every pair."""
        return min(self.covered(segments), segments // 2)


class Shingler:
    def __init__(self, n: int):
        self.n = n
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known = self.words = {}
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                out = out * _P + h[i : len(h) - k + 1 + i]
        return np.unique(mix(out))


def set_digest(tokens: np.ndarray, seed: int) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed))))


class Namer:
    """Name of a set: its digest, or a second one where sets share the first."""

    def __init__(self, make: Callable[[np.ndarray, int], int], shared: frozenset[int] = frozenset()):
        self.make, self.shared = make, shared

    def __call__(self, tokens: np.ndarray) -> int:
        name = self.make(tokens, 0)
        return self.make(tokens, 1) if name in self.shared else name


#: Kinds of index rows, in sorting order: an empty segment of a set that has too
#: many of them, one of another set, and a subset or neighbour.
WIDE, EMPTY, PLAIN = 0, 1, 2


def signatures(tokens: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, int]]:
    """Arrays of index keys of one set, each with its kind."""
    with np.errstate(over="ignore"):
        spread, weight = mix(tokens ^ _SALT_SEGMENT), mix(tokens + _SALT_SUBSET)
        for band in scheme.bands(len(tokens)):
            m = scheme.segments(band)
            if m < 2:
                continue  # no error allowed: equal sets only
            segment = (spread % np.uint64(m)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            filled, first = np.unique(segment[order], return_index=True)
            sums = np.add.reduceat(weight[order], first)
            place = mix(filled.astype(np.uint64) + np.uint64((band + 1) << 32))
            yield mix(sums + place), PLAIN
            empty = m - len(filled)
            if not empty:
                continue
            gaps = np.setdiff1d(np.arange(m), filled, assume_unique=True).astype(np.uint64)
            yield empty_keys(gaps, band), WIDE if empty > scheme.bearable(m) else EMPTY
            few = min(scheme.covered(m), len(filled))
            stop = first[few] if few < len(first) else len(order)
            owner = segment[order[:stop]]
            slot = np.searchsorted(filled, owner)
            sizes = np.bincount(slot, minlength=few)
            near = sums[slot] - weight[order[:stop]]
            near = near[sizes[slot] > 1] + place[slot[sizes[slot] > 1]]
            yield mix(np.concatenate([sums[:few] + place[:few], near]) ^ (_SALT_NEAR << np.uint64(40))), PLAIN


def empty_keys(gaps: np.ndarray, band: int) -> np.ndarray:
    return mix(gaps + np.uint64((band + 1) << 32) + (_SALT_EMPTY << np.uint64(48)))


def _shingle_table(n: int, digest: Callable[[np.ndarray, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(n)
        for batch in batches:
            sizes, ids, checks = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = make(text)
                sizes.append(len(tokens))
                ids.append(digest(tokens, 0) if len(tokens) else None)
                checks.append(digest(tokens, 1) if len(tokens) else None)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, ids, checks))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "other"])

    return run


_SIGNATURE = "key long, node long, size int, kind byte"


def _signature_table(n: int, percent: int, name: Namer):
    """Index rows of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, scheme = Shingler(n), Scheme(percent)
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        sizes: list[int] = []
        kinds: list[int] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            spans = np.array(lengths)
            columns = [
                np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), spans),
                np.repeat(np.array(sizes, np.int32), spans), np.repeat(np.array(kinds, np.int8), spans),
            ]
            for held in (keys, nodes, sizes, kinds, lengths):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "size", "kind"])

        pending = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = make(text)
                if not len(tokens):
                    continue
                node = name(tokens)
                for part, kind in signatures(tokens, scheme):
                    if len(part):
                        keys.append(part)
                        nodes.append(node)
                        sizes.append(len(tokens))
                        kinds.append(kind)
                        lengths.append(len(part))
                        pending += len(part)
                if pending > ROWS_OUT:
                    yield flush()
                    pending = 0
        if pending:
            yield flush()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, kind, node): those of keys that two nodes share;
    of an empty segment's key only if it begins with a wide row. Holds one row
    between batches, however long a run is."""
    open_row = None
    for batch in batches:
        key, node, size, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if open_row is not None:
            key, node, size, kind = (np.concatenate([[o], c]) for o, c in zip(open_row, (key, node, size, kind)))
        if not len(key):
            continue
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, size, kind = key[fresh], node[fresh], size[fresh], kind[fresh]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        spans = np.diff(np.concatenate([begin, [len(key)]]))
        shared = np.repeat((spans > 1) & (kind[begin] != EMPTY), spans)
        last = begin[-1]
        # The row that opened the last run stands for it, with its kind.
        open_row = (key[last], node[last], size[last], kind[last])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[shared].astype(np.int64)), pa.array(node[shared].astype(np.int64)), pa.array(size[shared].astype(np.int32))],
            ["key", "node", "size"],
        )


def sketch_bits(size: int) -> int:
    """A power of two, so that a large sketch folds onto a small one."""
    return max(SKETCH_BITS, 1 << (size - 1).bit_length())


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the token counts in hash buckets, about one a token. Two sets
    differ in at least as many elements as their sketches in bits."""
    bits = sketch_bits(len(tokens))
    bucket = (mix(tokens + _SALT_SKETCH) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, words: int = SKETCH_BITS // 64) -> np.ndarray:
    """A sketch on fewer words, a power of two."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def slim_words(size: int) -> int:
    """Words of a sketch of one to two bits an element. Of two unrelated sets about
    half of its bits differ; those that are similar may differ in a ninth at most."""
    return max(1, (1 << (size - 1).bit_length()) // 64)


def _set_table(n: int, name: Namer):
    """Sets with their sketches; ``small`` and ``slim`` are null where ``sketch`` has their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                found = [make(t) for t in batch.column(0).slice(at, 128).to_pylist()]
                nodes = [name(t) if len(t) else None for t in found]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in found])])
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                sketches = [parity_sketch(t) for t in found] or [np.zeros(0, np.int64)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sketches[: len(found)]])])
                smalls = [folded(x) if len(x) > SKETCH_BITS // 64 else None for x in sketches[: len(found)]]
                slims = [folded(x, slim_words(len(t))) if 0 < slim_words(len(t)) < len(x) else None for t, x in zip(found, sketches)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sketches))),
                        pa.array(smalls, pa.list_(pa.int64())),
                        pa.array(slims, pa.list_(pa.int64())),
                    ],
                    ["node", "tokens", "sketch", "small", "slim"],
                )

    return run


def _fits(a: Column, b: Column, percent: int) -> Column:
    small, large = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    return small * 100 >= large * percent


def _folded(sketch: Column, words: Column) -> Column:
    """The sketch on ``words`` words: sizes of a pair differ by one power at most."""
    halves = F.zip_with(F.slice(sketch, F.lit(1), words), F.slice(sketch, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > words, halves).otherwise(sketch)


def _may_reach(sketch_a: Column, sketch_b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether the sketches of sets whose sizes fit leave the similarity possible:
    common >= percent / (100 + percent) * sum, so at most this many elements differ."""
    least = F.least(F.size(sketch_a), F.size(sketch_b))
    bits = F.zip_with(_folded(sketch_a, least), _folded(sketch_b, least), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda acc, v: acc + v).cast("long")
    return apart * (100 + percent) <= (n_a + n_b).cast("long") * (100 - percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity. The short sketches rule out
    most others before any set is moved; the sets decide."""
    short = sets.select("node", F.size("tokens").alias("n"), "sketch")
    both = pairs.join(short.toDF("a", "n_a", "sketch_a"), "a").join(short.toDF("b", "n_b", "sketch_b"), "b")
    close = both.where(_may_reach(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    whole = sets.select("node", "tokens")
    both = close.join(whole.toDF("a", "tokens_a"), "a").join(whole.toDF("b", "tokens_b"), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    both = both.select("a", "b", common.alias("common"), (F.size("tokens_a") + F.size("tokens_b")).cast("long").alias("sum"))
    return both.where(F.col("common") * 100 >= (F.col("sum") - F.col("common")) * percent).select("a", "b")


_BLOCK = "pair long, node long, size int, root long, side boolean, lone boolean, sketch array<bigint>"


def _on(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches folded on fewer words."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def _block_pairs(percent: int):
    """Pairs within one (key, block, block), given as runs of sorted rows: those
    of different components whose sketches leave the similarity possible. A run
    is at most two blocks; only what is left goes out."""

    def survivors(run: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a_rows = np.arange(len(run["node"])) if run["lone"][0] else np.flatnonzero(~run["side"])
        b_rows = a_rows if run["lone"][0] else np.flatnonzero(run["side"])
        size, node, root, sketch = run["size"].astype(np.int64), run["node"], run["root"], run["sketch"]
        width = np.fromiter(map(len, sketch), np.int64, len(sketch))
        tables, slot = {}, np.zeros(len(sketch), np.int64)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            tables[w], slot[rows] = np.stack(sketch[rows]).view(np.uint64), np.arange(len(rows))
        left, right = [], []
        for at in range(0, len(a_rows), 32):
            i = a_rows[at : at + 32]
            small, large = np.minimum(size[i][:, None], size[b_rows]), np.maximum(size[i][:, None], size[b_rows])
            good = (small * 100 >= large * percent) & (root[i][:, None] != root[b_rows])
            if run["lone"][0]:
                good &= node[i][:, None] < node[b_rows]
            x, y = np.nonzero(good)
            x, y = i[x], b_rows[y]
            widths = width[x] << 32 | width[y]
            for both in np.unique(widths).tolist():
                w, v = both >> 32, both & 0xFFFFFFFF
                chosen, step = np.flatnonzero(widths == both), max(1, (1 << 20) // max(w, v))
                for k in range(0, len(chosen), step):
                    p, q = x[chosen[k : k + step]], y[chosen[k : k + step]]
                    apart = np.bitwise_count(_on(tables[w][slot[p]], min(w, v)) ^ _on(tables[v][slot[q]], min(w, v))).sum(1, dtype=np.int64)
                    close = apart * (100 + percent) <= (size[p] + size[q]) * (100 - percent)
                    left.append(node[p[close]])
                    right.append(node[q[close]])
        a, b = np.concatenate(left or [node[:0]]), np.concatenate(right or [node[:0]])
        return np.minimum(a, b), np.maximum(a, b)

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("pair", "node", "size", "root", "side", "lone")}
        out["side"], out["lone"] = out["side"].astype(bool), out["lone"].astype(bool)
        out["sketch"] = np.empty(batch.num_rows, object)  # widths differ
        out["sketch"][:] = list(batch.column("sketch").to_numpy(zero_copy_only=False))
        return out

    def emit(run: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in survivors(run)], ["a", "b"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            if held is not None:
                rows = {k: np.concatenate([held[k], rows[k]]) for k in rows}
            begin = np.flatnonzero(np.concatenate([[True], rows["pair"][1:] != rows["pair"][:-1]]))
            for x, y in zip(begin[:-1], begin[1:]):
                yield emit({k: v[x:y] for k, v in rows.items()})
            held = {k: v[begin[-1] :] for k, v in rows.items()}
        if held is not None:
            yield emit(held)

    return go


def _slims(sets: DataFrame) -> DataFrame:
    return sets.select("node", F.coalesce("slim", "sketch").alias("slim"))


def _crowd(placed: DataFrame) -> DataFrame:
    """Keys of more than ``CROWD`` sets."""
    return placed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CROWD).select("key")


def chief_pairs(placed: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each key's chief, a set by chance, with its other sets in other
    components. Sets that meet by chance grow with the square of the input; sketches
    rule them out before a pair is formed."""
    rows = placed.join(_slims(sets), "node")
    chief = rows.groupBy("key").agg(F.max(F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("worth"), "node", "size", "root", "slim")).alias("c"))
    good = (F.col("root") != F.col("c.root")) & _fits(F.col("size"), F.col("c.size"), percent)
    good &= _may_reach(F.col("slim"), F.col("c.slim"), F.col("size"), F.col("c.size"), percent)
    return rows.join(chief, "key").where(good).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def crowded_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of keys that many sets share, by blocks against blocks.

    A key's members fall into blocks of about ``BLOCK_ROWS``; each pair of blocks
    is one small unit of work, so a hot key is spread over many tasks. Sketches as
    long as the sets need are compared where they lie and no pair is formed that they
    rule out: on sketches of one length for all sets, long ones would be all alike.
    """
    counts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    parts = F.ceil(F.col("k") / BLOCK_ROWS).cast("int")
    rows = placed.join(counts, "key").join(_slims(sets).withColumnRenamed("slim", "sketch"), "node").withColumn("parts", parts)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(41), "node"), F.col("parts")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    units = met.select(
        F.xxhash64("key", low, high).alias("pair"), "node", "size", "root", (F.col("own") > F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("lone"), "sketch"
    )
    order = ["pair", "node"]
    return units.repartition("pair").sortWithinPartitions(*order).mapInArrow(_block_pairs(percent), "a long, b long").distinct()


def few_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of keys that ``CROWD`` sets share at most.

    Sets that share a subset by chance meet here, and such pairs grow faster than the
    input. A key's members, four at most, lie in one row with sketches as long as the
    sets need, so that only pairs that may be similar are ever formed.
    """
    met = placed.join(_slims(sets), "node").groupBy("key").agg(F.collect_list(F.struct("node", "size", "root", "slim")).alias("m"))

    def partners(x: Column) -> Column:
        def good(y: Column) -> Column:
            apart = (x.node < y.node) & (x.root != y.root) & _fits(x["size"], y["size"], percent)
            return apart & _may_reach(x.slim, y.slim, x["size"], y["size"], percent)

        return F.transform(F.filter("m", good), lambda y: F.struct(x.node.alias("a"), y.node.alias("b")))

    return met.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.a", "p.b").distinct()


def components(edges: DataFrame, own: Workspace) -> DataFrame:
    """(node, root) for every node of an edge."""
    return _roots(forest(edges, own))


def forest(edges: DataFrame, own: Workspace) -> DataFrame:
    """(a, b): each node of an edge but the least of its component, with that one:
    alternating large and small stars.

    Each step is one aggregate and one join, written to the shared folder; no
    neighbour list is ever held. Ends when a step changes nothing.
    """
    stars = edges.where("a <> b").select("a", "b")
    mark = past = None
    while True:
        # Large star: larger neighbours move to the least neighbour.
        sides = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b")
        # Small star: smaller neighbours and the node itself move to the least one.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "low"), F.struct(F.col("a").alias("x"), "low"))).alias("e"))
        seen = Observation()  # counts what is written, without reading it again
        stars = small.select(F.col("e.x").alias("a"), F.col("e.low").alias("b")).where("a <> b").distinct()
        stars = own.table(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "stars")
        own.drop(past)
        past = stars
        if (row := (seen.get["n"], seen.get["h"])) == mark:
            break
        mark = row
    return stars


def _roots(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, own: Workspace) -> tuple[DataFrame, int]:
    """The verified pairs, written, and how many there are."""
    count = Observation()
    links = own.table(verified(pairs, sets, percent).observe(count, F.count(F.lit(1)).alias("n")), "links")
    own.release()
    return links, count.get["n"]


def similar_components(documents: DataFrame, n: int = 4, percent: int = 85, digest: Callable[[np.ndarray, int], int] = set_digest) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links) per row.

    ``digest`` names a set (seed 0) and parts sets of one name (seed 1)."""
    return placed_rows(documents, n, percent, digest)[0].select("doc_id", "n_shingles", "component_id")


def placed_rows(documents: DataFrame, n: int, percent: int, digest: Callable[[np.ndarray, int], int] = set_digest) -> tuple[DataFrame, Namer]:
    """As ``similar_components``, with each row's node and its component's root,
    and the naming of nodes."""
    spark = documents.sparkSession
    own = Workspace(spark, "jaccard")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = shingled = own.table(base.mapInArrow(_shingle_table(n, digest), "doc_id long, n_shingles long, node long, other long"), "shingled")

    # Names that different sets share: a handful in the largest tables there are.
    apart = shingled.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
    name = Namer(digest, frozenset(r.node for r in apart.select("node").collect()))
    if name.shared:
        node = F.when(F.col("node").isin(sorted(name.shared)), F.col("other")).otherwise(F.col("node"))
        shingled = shingled.withColumn("node", node)

    # Index rows meet by key; only keys of two nodes or more are kept.
    # One row of a set speaks for all (more where ids are null or repeated).
    speakers = shingled.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    spoken = maybe_in(base, "doc_id", own.table(bit_filter(speakers, "doc_id"), "speakers"))
    keyed = spoken.select("text").mapInArrow(_signature_table(n, percent, name), _SIGNATURE)
    order = ["key", "kind", "node"]
    shared = keyed.repartition("key").sortWithinPartitions(*order).mapInArrow(_runs, "key long, node long, size int")
    shared = own.table(shared, "shared-keys")
    members = own.table(shared.distinct(), "meeting")
    own.close(written, members)  # the index is the largest of all tables
    wanted = own.table(members.groupBy("node").agg(F.count(F.lit(1)).alias("popularity"), F.max("size").alias("size")), "wanted")
    holders = shingled.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = maybe_in(base, "doc_id", bit_filter(holders, "doc_id")).select("text")
    made = texts.mapInArrow(_set_table(n, name), "node long, tokens array<bigint>, sketch array<bigint>, small array<bigint>, slim array<bigint>")
    # Any row of a node is as good as another; sets that only passed the filters are not asked for.
    asked = maybe_in(made.where("node is not null"), "node", bit_filter(wanted, "node"))
    # Kept in buckets: verification moves the pairs, and one set a pair.
    sets = own.bucketed(asked.drop("small"), "node", "sets")

    # Star rounds: each key offers its most shared member (later, in crowded keys: one
    # by chance) to the members of other components. Each is linear in the index rows.
    stars = seen = None
    known = own.table(members.join(wanted.select("node", "popularity"), "node"), "members")
    own.drop(members)
    placed = known.withColumn("root", F.col("node"))
    for turn in range(STAR_ROUNDS):
        if turn == 0:  # the most shared one only
            chief = placed.groupBy("key").agg(F.max(F.struct(F.col("popularity").alias("worth"), "node", "size", "root")).alias("c"))
            offers = (
                placed.join(chief, "key")
                .where((F.col("root") != F.col("c.root")) & _fits(F.col("size"), F.col("c.size"), percent))
                .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"), "c.worth", "node")
            )
            best = F.max_by(F.struct("a", "b"), "worth")
            offers = offers.groupBy("node").agg(best.alias("p")).select("p.a", "p.b").distinct()
        else:
            offers = chief_pairs(placed.join(_crowd(placed), "key", "left_semi"), sets, percent, turn).join(seen, ["a", "b"], "left_anti")
        offers = own.table(offers, "offers")
        new, count = _linked(offers, sets, percent, own)
        seen = offers if seen is None else seen.unionByName(offers)
        if not count:
            continue  # components and open keys are as before
        # The stars so far stand for the links before, which need not be gone through again.
        last, stars = placed, forest(new if stars is None else new.unionByName(stars), own)
        placed = known.join(_roots(stars), "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        placed = own.table(placed.join(open_keys, "key", "left_semi"), "placed")
        own.drop(last)

    # What is left: nodes that share a key but not a component.
    # Keys of few sets in one row each, crowded ones by blocks.
    crowd = _crowd(placed)
    crowded = crowded_pairs(placed.join(crowd, "key", "left_semi"), sets, percent)
    cross = few_pairs(placed.join(crowd, "key", "left_anti"), sets, percent)
    cross = cross.unionByName(crowded).distinct()
    cross = own.table(cross.join(seen, ["a", "b"], "left_anti"), "cross-pairs")
    new, count = _linked(cross, sets, percent, own)
    own.close(written, new, stars)
    if count:
        stars = forest(new if stars is None else new.unionByName(stars), own)

    # Least document of each component, then back to the rows.
    least = shingled.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.withColumn("root", F.col("node"))
    if stars is not None:
        rooted = least.join(_roots(stars), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(of_root, "root").select("node", "root", "component_id")
    out = shingled.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "root"
    )
    out = own.table(out, "components")
    own.close(out)
    return out, name


def _with_node(n: int, name: Namer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(n)
        for batch in batches:
            found = [make(t) for t in batch.column("_words").to_pylist()]
            nodes = pa.array([name(t) if len(t) else None for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "_node"])

    return run


def drop_near_copies(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: one with its least id, or with none where no
    row of it has an id; of several, that of the least hash. Rows without words
    link with nothing and stay.

    Only rows in question move: those whose id is in a component of another id,
    and those whose id is null or repeated.
    """
    own = Workspace(documents.sparkSession, "near-copies")
    found, name = placed_rows(documents, n, percent)
    found = found.where("n_shingles > 0")
    shared, several = Observation(), None
    by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("component_id") != F.col("doc_id")).alias("moved")).where("rows > 1 or moved or doc_id is null")
    by_id = own.table(by_id.observe(shared, F.count_if(F.expr("rows > 1 or doc_id is null")).alias("n")), "in-question")
    if shared.get["n"]:
        several = own.table(bit_filter(by_id.where("rows > 1 or doc_id is null"), "doc_id"), "repeated")
    gone = by_id.where("rows = 1 and moved").select(F.col("doc_id").alias("_own"))
    single = own.table(bit_filter(gone, "_own"), "gone")

    rows = whole_rows(documents, F.col("doc_id").cast("long").alias("_own"), text_or_empty().alias("_words"))
    worded = F.regexp_replace("_words", SPACE_RE, "") != ""
    plain = rows if several is None else maybe_in(rows, "_own", several, inside=False)
    stay = maybe_in(plain, "_own", single, inside=False)
    moved = maybe_in(plain, "_own", single)
    kept = [stay, moved.where(~worded), moved.where(worded).join(gone, "_own", "left_anti")]
    if several is None:  # ids tell the rows apart
        return reduce(DataFrame.unionByName, [part.select("row") for part in kept]).select("row.*")

    # Repeated ids and rows without one: their sets tell the component.
    mixed = maybe_in(rows, "_own", several)
    kept.append(mixed.where(~worded))
    schema = StructType([*mixed.schema.fields, StructField("_node", LongType())])
    noded = mixed.where(worded).mapInArrow(_with_node(n, name), schema)
    ones = noded.groupBy("_own", "_node").agg(F.min_by("row", row_hash(documents)).alias("row"))  # before the join, so that no set is hot
    marks = found.select(F.col("node").alias("_node"), "root", "component_id").distinct()
    ones = ones.join(marks, "_node").where(F.col("_own").eqNullSafe(F.col("component_id")))
    picked = ones.groupBy("root").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return reduce(DataFrame.unionByName, [part.select("row") for part in kept] + [picked]).select("row.*")
