"""Findings of round 4."""

import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from halyard.operators import joins as J
from halyard.operators import rollup as R
from halyard.operators import timeseries as T
from halyard.operators.packed import dealt

JOB = "id long, cluster string, job_state string, shared string, start_time long, duration long"


def _pairs(jobs, hosts, now, buffer=200, least=600):
    at = {r[0]: {h for k, h in hosts if k == r[0] and h is not None} for r in jobs}
    end = {r[0]: now if r[2] == "running" else r[4] + r[5] for r in jobs}
    for a in jobs:
        for b in jobs:
            if a[0] == b[0] or a[1] is None or a[1] != b[1] or not at[a[0]] & at[b[0]] or a[3] == "none" or end[a[0]] - a[4] <= least or b[2] is None:
                continue
            if b[4] <= end[a[0]] - buffer if b[2] == "running" else b[4] < end[a[0]] - buffer and end[b[0]] > a[4] + buffer:
                yield a[0], b[0]


def test_jobs_move_by_host_once(spark):
    """rows of a job and host are dealt once for all kinds of pairs; hosts may repeat."""
    rng, now = random.Random(4), 100_000
    jobs = [(k, rng.choice("cd"), rng.choice(("running", "completed", "failed")), rng.choice(("none", "single_user", "multi_user")), rng.randrange(110) * 1000, rng.choice((0, 100, 500, 1000, 7000, 90_000))) for k in range(150)]
    hosts = [(k, rng.choice(("a", "b", "c", "dd", None))) for k in range(150) for _ in range(rng.randrange(6))]
    want = sorted(_pairs(jobs, hosts, now))
    frames = spark.createDataFrame(jobs, JOB), spark.createDataFrame(hosts, "id long, hostname string")
    out = J.concurrent_jobs(*frames, now)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert len(want) > 500 and sorted(tuple(r) for r in out.collect()) == want
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (1, 2, 7):  # a host's rows in several batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert sorted(tuple(r) for r in J.concurrent_jobs(*frames, now).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    names = J.concurrent_jobs(frames[0].withColumn("id", F.concat(F.lit("j"), "id")), frames[1].withColumn("id", F.concat(F.lit("j"), "id")), now)
    assert sorted(tuple(r) for r in names.collect()) == sorted((f"j{a}", f"j{b}") for a, b in want)


SAMPLE = "id long, cluster string, hostname string, scope string, scope_id long, metric string, ts long, seq long, value double, cell long"


def test_samples_of_jobs_move_once(spark, sf):
    """samples of a job and metric are dealt once; no cell of another scope is."""
    plan = entry.queries()["t7_job_stats_series"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" not in plan and plan.count("Exchange shufflepartitionid") == 2


def test_statistics_of_series_agree_with_cells(spark):
    """both passes against the cells of ``job_cells``, over batches that part jobs, hosts and cells."""
    rng = random.Random(1)
    rows = [
        (rng.choice((7, 8, 9)), "c", rng.choice(("g", "h", "k")), "hwthread", rng.choice((0, 1, 2, 3, 5, None)), rng.choice(("load", "power", "none")), 0, seq, rng.choice((None, *map(float, range(9)))), rng.randrange(6))
        for seq in range(900)
    ]
    rows += [(5, "c", "g", "hwthread", k, "load", 0, k, None, 3) for k in range(3)]  # no value at all
    rows += [(6, "c", "g", "hwthread", k, "load", 0, k, 1.0, 3) for k in range(2)]  # two series
    samples = spark.createDataFrame(rows, SAMPLE)
    config = spark.createDataFrame([("load", "sum"), ("power", "avg")], "metric string, aggregation string")
    topology = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 1, 1)], "hwthread long, core long, socket long")
    scopes, metrics = ("node", "socket", "hwthread", "core"), ["load", "power", "none"]
    cells = {}
    for r in T.job_cells(samples, topology, config, 60, metrics, scopes).collect():
        cells.setdefault((r.id, r.metric, r.scope), []).append(r)
    want = {}
    for key, found in cells.items():
        if len({(r.hostname, r.scope_id) for r in found if r.scope_id is not None}) >= 3:
            for cell in {r.cell for r in found}:
                v = [r.value for r in found if r.cell == cell and r.value is not None]
                want[(*key, cell)] = (min(v), sum(v) / len(v), statistics.median(v), max(v)) if v else (None,) * 4
    assert len(want) > 100 and (5, "load", "hwthread", 3) in want and not any(k[0] == 6 for k in want)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = T.job_stats_series(samples, topology, config, metrics, scopes, least=3).collect()
            assert len(got) == len(want)
            assert {tuple(r[:4]): tuple(r[4:]) for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    with pytest.raises(Exception, match="no aggregation for more than one series"):
        T.job_stats_series(samples, topology, spark.createDataFrame([("load", "last")], "metric string, aggregation string"), metrics, scopes).collect()


def test_jobs_of_many_samples_are_folded_in_parts(monkeypatch):
    """the same rows whether a job's samples are held or not."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(4), rng.choice("xy"), rng.choice("ghk"), rng.randrange(4), rng.randrange(5), seq, float(rng.randrange(9)), 0, [rng.randrange(2)]) for seq in range(400))
    names = ["id", "metric", "hostname", "scope_id", "cell", "seq", "value", "how", "at_core"]
    samples = pa.table(dict(zip(names, map(list, zip(*rows))))).to_batches(max_chunksize=23)
    scopes, results = ("node", "core", "hwthread"), []
    for held in (1 << 18, 60, 0):
        monkeypatch.setattr(R, "HELD", held)
        cells = pa.Table.from_batches(R.cells_at(iter(samples), (), "hwthread", scopes, 3))
        assert cells.column("series").null_count == (cells.num_rows if held == 1 << 18 else 0 if not held else cells.column("series").null_count)
        cells = cells.sort_by([(c, "ascending") for c in ("id", "metric", "scope", "cell", "value")], null_placement="at_start")
        out = pa.Table.from_batches(R.cell_stats(iter(cells.to_batches(max_chunksize=17)), scopes, 3))
        results.append(sorted(map(tuple, zip(*out.to_pydict().values()))))
    assert len(results[0]) > 50 and results[0] == results[1] == results[2]


def test_dealt_rows_lie_together(spark):
    """Rows of a key, null or not, lie in one partition, with all that they had."""
    rows = [(rng.choice((None, *range(9))), rng.choice((None, "a", "bb")), rng.choice((None, [], ["x", None])), rng.random()) for rng in [random.Random(5)] for _ in range(500)]
    given = spark.createDataFrame(rows, "k long, name string, list array<string>, value double").repartition(5)
    out = dealt(given, "k", "name")
    assert out.schema == given.schema
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, rows))
    assert out.select("k", "name", F.spark_partition_id().alias("p")).distinct().count() == out.select("k", "name").distinct().count() == 30


def test_samples_inside_jobs(spark):
    """a host's jobs are not spread over days; brute force, with hosts and jobs in several batches."""
    rng = random.Random(2)
    jobs = [(k, rng.choice("cd"), rng.choice((None, 0, 5, 40)), rng.choice((0, 1, 7, 60, -3, None))) for k in range(40)]
    hosts = [(k, h) for k in range(40) for h in ("g", "h", None) if rng.random() < 0.6]
    samples = [(rng.choice(("c", "d", None)), rng.choice(("g", "h", "k", None)), rng.choice((None, *range(70))), n) for n in range(300)]
    frames = spark.createDataFrame(samples, "cluster string, hostname string, ts long, seq long"), spark.createDataFrame(jobs, "id long, cluster string, start_time long, duration long"), spark.createDataFrame(hosts, "id long, hostname string")
    for names, by_cluster in ((["id", "cluster", "start_time", "duration"], True), (["id", "start_time", "duration"], False)):
        want = [
            (c, h, t, n, k) for c, h, t, n in samples for k, d, s, took in jobs
            if h is not None and (k, h) in hosts and None not in (t, s, took) and s <= t < s + took and (c == d or not by_cluster)
        ]
        size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        try:
            for rows in (1, 5, 10_000):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
                out = J.samples_for_jobs(frames[0], frames[1].select(*names), frames[2])
                assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()
                assert sorted(map(repr, (tuple(r) for r in out.select("cluster", "hostname", "ts", "seq", "id").collect()))) == sorted(map(repr, want)) and len(want) > 100
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
