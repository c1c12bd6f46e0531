"""Configuration of several clusters, and grids that begin anew."""

import random

import pytest

from halyard.operators import joins as J
from halyard.operators import timeseries as T
from halyard.operators.config import with_config, with_subcluster

SAMPLE = "cluster string, hostname string, scope string, scope_id long, metric string, ts long, seq long, value double"


def test_same_host_in_two_clusters(spark):
    samples = [(c, "h1", "hwthread", k, "load", 100, k, 1.0) for c in ("a", "b") for k in range(4)]
    lists = spark.createDataFrame([("a", "x", "h[1-3]"), ("b", "y", "*"), ("b", "z", "h9")], "cluster string, subcluster string, nodes string")
    config = spark.createDataFrame([("a", "x", "load", "sum"), ("b", "y", "load", "avg"), ("b", "z", "load", "sum")], "cluster string, subcluster string, metric string, aggregation string")
    topology = [("a", "x", k, k // 2) for k in range(4)] + [("b", "y", k, 0) for k in range(4)] + [("b", "z", k, k) for k in range(4)]
    topology = spark.createDataFrame(topology, "cluster string, subcluster string, hwthread long, socket long")
    rows = spark.createDataFrame(samples, SAMPLE)
    cells = with_subcluster(T.dedup_samples(rows, 60), lists)
    node = {(r.cluster, r.subcluster): r.value for r in T.scope_rollup(cells, topology, config, "hwthread", "node").collect()}
    assert node == {("a", "x"): 4.0, ("b", "y"): 1.0}
    sockets = sorted((r.cluster, r.scope_id, r.value) for r in T.scope_rollup(cells, topology, config, "hwthread", "socket").collect())
    assert sockets == [("a", 0, 2.0), ("a", 1, 2.0), ("b", 0, 1.0)]
    jobs = spark.createDataFrame([(7, "a", 0, 500)], "id long, cluster string, start_time long, duration long")
    hosts = spark.createDataFrame([(7, "h1")], "id long, hostname string")
    assert {r.cluster for r in J.samples_for_jobs(rows, jobs, hosts).collect()} == {"a"}
    assert J.with_thresholds(with_subcluster(rows, lists), config).count() == 8
    with pytest.raises(ValueError, match="subcluster"):
        with_config(rows, config, "aggregation")


def test_grids_begin_anew(spark):
    rng, step = random.Random(4), 10
    series = {"drift": [k * 10 + k // 50 for k in range(1500)], "gap": [*range(0, 900, 10), *range(7003, 9000, 10), 90_001], "one": [5], "ties": [3, 3, 3, 9, 5123, 5123, 5124]}
    rows = [("c", name, "node", 0, "m", t, n, float(n)) for name, times in series.items() for n, t in enumerate(times)] + [("c", "none", "node", 0, "m", None, 0, 0.0), ("c", "gap", "node", 0, "m", None, 0, 0.0), ("c", None, "node", 0, "m", 44, 0, 0.0)]
    rng.shuffle(rows)
    want = {}
    for name, times in {**series, None: [44]}.items():
        begin = None
        for t in times:
            if begin is None or t - begin >= 512 * step:
                begin = t - step // 2
            want[name, t] = begin // step + (t - begin) // step
    for parts in (1, 7):
        got = T.with_cells(spark.createDataFrame(rows, SAMPLE).repartition(parts), step).collect()
        assert len(got) == len(rows)
        assert {(r.hostname, r.ts): r.cell for r in got if r.ts is not None} == want
        assert all(r.cell is None for r in got if r.ts is None)
    assert T.with_cells(spark.createDataFrame([], SAMPLE), step).count() == 0
