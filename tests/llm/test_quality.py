import zlib

import numpy as np
import pytest

from halyard.llm import quality
from halyard.llm.quality import SIZE, STATISTICS, FactorisationMachine, FeatureMaker, fit_quality, keep_good, score_quality


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = FactorisationMachine(0.1, rng.normal(size=SIZE), rng.normal(size=(SIZE, 6)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    index, x = np.array([3, 50, 700, SIZE - 1]), rng.normal(size=4)
    pairs = sum(fm.factors[index[i]] @ fm.factors[index[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert fm.raw(index, x)[0] == pytest.approx(0.1 + fm.weights[index] @ x + pairs)


def test_query_against_pairs_of_inputs(spark):
    """Scores of the operator are those of a loop over all pairs of inputs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = fit_quality(docs, labels)
    make = FeatureMaker()
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    for row in docs.orderBy("doc_id").collect():
        index, x = model.inputs(*make(row.text, row.n_chars))
        both = (model.factors[index] @ model.factors[index].T) * np.outer(x, x)
        z = model.bias + model.weights[index] @ x + np.triu(both, 1).sum()
        assert got[row.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


@pytest.mark.parametrize("together", [1, 40, 10**6])
def test_scores_in_any_batches(together, monkeypatch):
    rng = np.random.default_rng(3)
    fm = FactorisationMachine(-0.2, rng.normal(size=SIZE), rng.normal(0, 0.1, (SIZE, 6)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    rows = [FeatureMaker()(t, None) for t in ("a b a", "", None, "one two " * 30, "x")]
    monkeypatch.setattr(quality, "BATCH_INPUTS", together)
    alone = [1 / (1 + np.exp(-fm.raw(*fm.inputs(*r))[0])) for r in rows]
    assert fm.scores(rows) == pytest.approx(alone) and len(fm.scores([])) == 0


def auc(scores, labels):
    good = [s for s, l in zip(scores, labels) if l]
    bad = [s for s, l in zip(scores, labels) if not l]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    rows = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    area = auc([r.score for r, _ in rows], [q for _, q in rows])
    right = sum(r.predicted == q for r, q in rows) / len(rows)
    kept = sum(r.predicted for r, q in rows if q) / sum(q for _, q in rows)
    caught = sum(1 - r.predicted for r, q in rows if not q) / sum(1 - q for _, q in rows)
    print("auc", area, "accuracy", right, "good kept", kept, "bad caught", caught)
    assert area > 0.9 and right > 0.9 and kept > 0.98


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", 0), (2, "", 0), (3, "é b\n" * 90_000, 5), (None, "x", -1)], "doc_id long, text string, n_chars long").selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0
    assert keep_good(docs, labels.limit(0)).columns == docs.columns
    assert FeatureMaker()("", None)[2].shape == (len(STATISTICS),)
