"""Near words and forms against one-deletion tables, for partitions of any size."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from halyard.llm.spelling import Acceptor, spelling_variants


def near_by_deletion(words):
    near, cut = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            cut[i, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in cut.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(docs, drop=97):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 5 and k >= 3}
    near, form, out = near_by_deletion(n), {}, {}
    for w in n:
        first = min(((-n[v], v) for v in near[w]), default=(0, None))
        form[w] = first[1] if -first[0] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def run(docs, **options):
    rows = spelling_variants(docs, **options).collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def test_acceptor():
    rng = random.Random(2)
    for _ in range(300):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 40))})
        got = Acceptor(words).near_pairs()
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and b in near_by_deletion(set(words))[a]}
        assert got == want
    assert len(Acceptor(sorted(a + b + "ing" for a in "xyz" for b in "xyz")).arcs) == 6  # minimal
    long = "ab" * 50_000
    assert Acceptor(sorted([long, long + "c", long[:-1] + "x"])).near_pairs() == {(0, 1), (0, 2)}


@pytest.mark.parametrize("bound", [8192, 30, 4])
def test_forms(spark, bound):
    rng = random.Random(bound)
    base = ["".join(rng.choice("aabceéÀx") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    vary = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "éb"]) + w[k + rng.randrange(2) :]
    pool = [w for w in base for _ in range(rng.choice([3, 8, 30]))] + [vary(w) for w in base for _ in range(20)]
    docs = [(k, " ".join(rng.choice(pool) for _ in range(60)) + rng.choice(["", "!", " ŁŁ", "\x00", "ab1cd"])) for k in range(80)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (3, None), (4, ""), (5, "-1 ×÷×÷× ×÷×÷× ×÷×÷×"), (6, "AAAAAA" * 3000 + " "), (7, "AAAAAA" * 3000), (8, "aaaaaa" * 3000 + "b"), (9, "kkkkk " * 4 + "kkkkl " * 10 + "kkkll " * 30)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = run(d.withColumn("word", F.lit(1)), drop_every=97, bound=bound) if bound > 4 else run(d.where("length(text) < 5000"), drop_every=97, bound=bound)
    assert got == brute(docs if bound > 4 else [x for x in docs if x[1] and len(x[1]) < 5000])
    assert any(v[4] != v[2] for v in got.values() if v[2])


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == {}
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)
