import random
import re

import numpy as np
import pytest

from halyard.llm.common import Workspace
from halyard.llm.jaccard import EMPTY, PLAIN, SKETCH_BITS, WIDE, Namer, Scheme, Shingler, _set_table, components, drop_near_copies, few_pairs, folded, mix, parity_sketch, set_digest, signatures, similar_components


def shingles(text, n):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (a, s) in enumerate(sets):
        near = {j for x in s for j in where[x] if j < k}
        for j in near:
            b, t = sets[j]
            both = len(s & t)
            if both and 100 * both >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_table(spark, n, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs, n, percent).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def near_rows(seed, count=60):
    """Chains of edits around the threshold, of many sizes."""
    rng, rows = random.Random(seed), []
    for k in range(count):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([1, 3, 4, 8, 12, 20, 45, 120, 400]))]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            words = words[:]
            for _ in range(rng.randrange(0, 1 + len(words) // 15 + 1)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
    return rows


@pytest.mark.parametrize("cover", [None, 0])
def test_edits(spark, monkeypatch, cover):
    """With ``cover`` 0 all sets with an empty segment take the further pass."""
    if cover is not None:
        monkeypatch.setattr(Scheme, "bearable", lambda self, m: 0)
    rows = near_rows(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("rows", [3, 1024])
def test_crowded_keys(spark, monkeypatch, rows):
    """Many sets around the threshold share keys; blocks give the same links."""
    monkeypatch.setattr("halyard.llm.jaccard.CROWD", 2)
    monkeypatch.setattr("halyard.llm.jaccard.BLOCK_ROWS", rows)
    rng, docs = random.Random(8), []
    base = [f"w{k}" for k in range(150)]
    for k in range(60):
        words = base[:]
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        docs.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 4, 85)


def test_signatures_meet():
    """Any pair that reaches the similarity shares a key (no empty-segment pass needed)."""
    scheme, make, rng = Scheme(85), Shingler(4), random.Random(3)
    met = 0
    for _ in range(400):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([9, 15, 30, 60, 200]))]
        other = words[:]
        for _ in range(rng.randrange(1, 2 + len(words) // 40)):
            other[rng.randrange(len(words))] = "y"
        a, b = make(" ".join(words)), make(" ".join(other))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            met += 1
            keys = [np.concatenate([k for k, _ in signatures(x, scheme)] or [np.zeros(0, np.uint64)]) for x in (a, b)]
            assert np.array_equal(a, b) or len(np.intersect1d(*keys))
    assert met >= 50


def test_sets_in_one_segment():
    """Sets with elements in one segment alone still share a key, by the further pass."""
    scheme = Scheme(80)
    for size in (8, 9, 10):
        m = scheme.segments(scheme.band(size + 2))
        pool = [t for t in np.arange(1, 4000, dtype=np.uint64) if mix(np.array([t], np.uint64) ^ np.uint64(0x51))[0] % np.uint64(m) == 0]
        a, b = np.array(pool[:size], np.uint64), np.array(pool[: size + size // 4], np.uint64)
        assert 100 * len(a) >= 80 * len(b)
        kinds = [{kind: np.concatenate([k for k, w in signatures(x, scheme) if w == kind] or [np.zeros(0, np.uint64)]) for kind in (WIDE, EMPTY, PLAIN)} for x in (a, b)]
        met = [(x, y) for x in kinds[0] for y in kinds[1] if len(np.intersect1d(kinds[0][x], kinds[1][y]))]
        assert any(pair == (PLAIN, PLAIN) or WIDE in pair for pair in met)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for size in (3, 700, 2049, 9000):
        a = rng.integers(1, 1 << 62, size, dtype=np.uint64)
        b = np.concatenate([a[: size - size // 9], rng.integers(1, 1 << 62, size // 8, dtype=np.uint64)])
        apart = size // 9 + size // 8
        x, y = parity_sketch(a), parity_sketch(b)
        assert len(x) == max(SKETCH_BITS, 1 << (size - 1).bit_length()) // 64
        small = np.bitwise_count((folded(x) ^ folded(y)).view(np.uint64)).sum()
        assert small <= apart
        if len(x) == len(y):
            assert apart * 0.7 <= np.bitwise_count((x ^ y).view(np.uint64)).sum() <= apart


def test_names_that_sets_share(spark):
    """Digests of three bits: sets that share one are told apart by the second."""
    rows = near_rows(6, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = similar_components(docs, digest=lambda tokens, seed: set_digest(tokens, 1) if seed else set_digest(tokens, 0) % 8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in weak.collect()} == brute(rows, 4, 85)


def test_rows_without_an_id(spark):
    """They link like others; of a component without any id one row stays."""
    long = [f"w{k}" for k in range(60)]
    near, alone = [*long[:-1], "x"], [f"v{k}" for k in range(60)]
    texts = [(None, " ".join(long)), (5, " ".join(near)), (None, " ".join(alone)), (None, " ".join([*alone[:-1], "y"])), (None, None), (None, "\t\n"), (9, "\t\n"), (9, "\t \n"), (9, "q r"), (9, "s t")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in similar_components(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 5), (5, 5), (None, None), (None, None), (None, None), (None, None), (9, 9), (9, 9), (9, 9), (9, 9)]))
    kept = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:2]) for r in drop_near_copies(docs).collect()))
    assert kept == [(False, 5, "w0"), (False, 9, "\t\n"), (False, 9, "\t "), (False, 9, "q "), (False, 9, "s "), (True, 0, ""), (True, 0, "\t\n"), (True, 0, "v0")]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_edge_rows(spark):
    rows = [(3, "a b c d e"), (1, "A b\tc\nd e"), (2, None), (4, ""), (5, " \n "), (6, "a b"), (7, "A  B"), (7, "a b"), (8, "q " * 50_000), (9, "é É"), (10, "é é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as key")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in similar_components(docs).collect()]
    assert sorted(got) == [(1, 2, 1), (2, 0, 2), (3, 2, 1), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9), (10, 1, 10)]
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 2, 4, 5, 6, 8, 9, 10]
    assert similar_components(docs.limit(0)).count() == 0


def test_few_pairs(spark):
    """Every similar pair of a key comes out, and hardly any other is formed."""
    rng, texts = random.Random(5), []
    for size in [3, 30, 70, 130, 300, 600, 1100, 2500, 5000] * 3:
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        near = words[:]
        near[size // 2] = "x"
        texts += [" ".join(words), " ".join(near), " ".join(f"v{rng.randrange(10**6)}" for _ in range(size))]
    name, make = Namer(set_digest), Shingler(5)
    found = {name(make(t)): set(make(t).tolist()) for t in texts}
    nodes = [name(make(t)) for t in texts]
    rows = [(k // 3, node, len(found[node]), node) for k, node in enumerate(nodes)]
    rows += [(-1, nodes[0], len(found[nodes[0]]), 7), (-1, nodes[1], len(found[nodes[1]]), 7)]  # one component already
    placed = spark.createDataFrame(rows, "key long, node long, size int, root long")
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text")
    sets = frame.mapInArrow(_set_table(5, name), "node long, tokens array<bigint>, sketch array<bigint>, small array<bigint>, slim array<bigint>")
    got = {(r.a, r.b) for r in few_pairs(placed, sets, 80).collect()}
    want = {
        tuple(sorted((a, b)))
        for k in range(0, len(nodes), 3)
        for a in nodes[k : k + 3]
        for b in nodes[k : k + 3]
        if a != b and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])
    }
    assert want and want <= got and len(got - want) <= 6
