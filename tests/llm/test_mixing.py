from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from halyard.llm.mixing import apply_mix, mix_sources, source_targets


def reshare(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The capped sharing by plain repetition; sizes in source order."""
    w = [weights[i % 3] for i in range(len(sizes))]
    budget = share * sum(sizes)
    fixed = [False] * len(sizes)
    target = [0.0] * len(sizes)
    while True:
        rest = budget - sum(cap * s for s, f in zip(sizes, fixed) if f)
        total = sum(x for x, f in zip(w, fixed) if not f)
        target = [cap * s if f else rest * x / total for s, x, f in zip(sizes, w, fixed)]
        over = [i for i in range(len(sizes)) if not fixed[i] and target[i] > cap * sizes[i]]
        if not over:
            return target
        for i in over:
            fixed[i] = True


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10, 10], [5, 900, 3, 44, 2, 700], [7], [0, 5]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", s, 1) for i, s in enumerate(sizes)]
    got = source_targets(spark.createDataFrame(rows, "source string, source_size long, docs long")).orderBy("place").collect()
    assert [r.target for r in got] == pytest.approx(reshare(sizes))


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("place", F.lit("x")).withColumn("key", F.lit(1))
    got = mix_sources(docs).documents.collect()
    assert len(got) == docs.count()
    size, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"] and len(r.shards or []) == r.copies
    names = sorted(size)
    assert [target[s] for s in names] == pytest.approx(reshare([size[s] for s in names]))
    for s in names:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
    again = mix_sources(docs.repartition(7)).documents
    assert sorted((r.doc_id, r.taken, str(r.shards)) for r in again.collect()) == sorted((r.doc_id, r.taken, str(r.shards)) for r in got)


def test_shards_are_dealt_exactly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mix_sources(docs, shards=4)
    by_shard = {r.shard: r.n for r in mix.shards.groupBy("shard").agg(F.sum("quota").alias("n")).collect()}
    assert len(by_shard) == 4 and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (4, "w " * 20_000, None), (None, "q", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).documents.collect()
    assert len(got) == len(rows)
    assert sum(r["size"] for r in got) == 20_005
    out = apply_mix(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in got)
    assert mix_sources(docs.limit(0)).documents.count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, shards=3)
