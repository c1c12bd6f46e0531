from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from halyard.llm.quality import score_quality
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import reshare
from tests.llm.test_tokens import reference


def test_stages(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").cache()
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, "test-stage")
        stage(spark, docs, base).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        steps[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{base}/labels.parquet")
    before, after = steps["quality"]
    good = {r.doc_id for r in score_quality(before, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == good and len(good) < before.count()
    before, after = steps["exact_copies"]
    least = {}
    for r in before.collect():
        key = " ".join((r.text or "").replace("\t", " ").replace("\n", " ").split(" "))
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == set(least.values())
    before, after = steps["near_copies"]
    want = {c for _, c in brute([(r.doc_id, r.text) for r in before.collect()], 5, 80).values()}
    assert {r.doc_id for r in after.collect()} == want
    before, after = steps["mix"]
    size, taken, longest = Counter(), Counter(), Counter()
    for r in before.collect():
        n = len((r.text or "").split())
        size[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    copies = Counter(r.doc_id for r in after.collect())
    for r in after.collect():
        taken[r.source] += len((r.text or "").split())
    assert max(copies.values()) <= 2
    names = sorted(size)
    for name, target in zip(names, reshare([size[s] for s in names])):
        assert abs(taken[name] - target) <= longest[name] / 2 + 1
    before, after = steps["packing"]
    total = sum(len(reference(r.text)) for r in before.collect())
    assert sum(r.length for r in after.collect()) == total


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


#: Names that the stages use inside, and some in other letter case.
INNER = (
    "_own _sha _id _none _kept _words _node row Row ROW _copy _key _shard _n _rid _rkey _score _row text_sha256 norm uid first kept digest node other root component_id n_shingles "
    "tokens sketch size copies shards shard place bucket bits slot source_size target taken _OWN _Node _Copy label fold held_out score predicted key kind"
).split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_clashing_names(spark, sf, name, stage):
    """Columns of any name come through a stage with their own values."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = list({c.lower(): c for c in INNER}.values())
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra})
    got = stage(spark, wide, sf)
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
    plain = Counter(r.doc_id for r in stage(spark, docs, sf).collect())
    assert Counter(r.doc_id for r in rows).keys() == plain.keys()
