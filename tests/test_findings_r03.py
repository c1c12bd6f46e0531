"""Findings of round 3."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from halyard.operators import joins as J

JOB = "id long, cluster string, job_state string, shared string, start_time long, duration long"


def test_sql_keeps_samples_before_a_new_grid_on_the_old_one(spark, tmp_path):
    """the half step before a grid's first sample belongs to the grid before it."""
    first = dt.datetime(2024, 1, 1, 1)
    edge = first + dt.timedelta(hours=512, seconds=-1800)
    times = [first, edge - dt.timedelta(seconds=300), edge + dt.timedelta(seconds=300)]
    rows = [(4 * k, t, 5, "click", float(k), "") for k, t in enumerate(times)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT cell, value FROM ({entry.oracle_sql()['w4_grids_begun_anew']}) ORDER BY ALL").fetchall()
    got = entry.queries()["w4_grids_begun_anew"](spark, str(tmp_path)).select("cell", "value").orderBy("cell", "value")
    assert len(want) == 3 and [tuple(r) for r in got.collect()] == want


def test_concurrent_pairs_meet_once(spark, monkeypatch):
    """jobs of several common hosts, of many hosts, and finished ones that start after now."""
    rows = [(k, "c", ("running", "completed", "failed")[k % 3], ("none", "single_user", "multi_user")[k % 4 % 3], k * 7919 % 20_000_000, k * 104729 % 4_000_000) for k in range(1, 60)]
    rows += [(60, "c", "completed", "multi_user", 30_000_000, 5000), (61, "c", None, "multi_user", 0, 50_000_000), (62, None, "running", "multi_user", 5, 5)]
    where = [(k, f"h{h}") for k in range(1, 63) for h in range(7) if k * 31 % (h + 3) < 2 or k > 59] + [(60, None)]
    now, want = 21_000_000, set()
    at = {k: {h for j, h in where if j == k and h} for k, *_ in rows}
    end = {r[0]: now if r[2] == "running" else r[4] + r[5] for r in rows}
    for a in rows:
        for b in rows:
            if a[0] == b[0] or a[1] is None or a[1] != b[1] or not at[a[0]] & at[b[0]] or a[3] == "none" or end[a[0]] - a[4] <= 600 or b[2] is None:
                continue
            if b[4] <= end[a[0]] - 200 if b[2] == "running" else b[4] < end[a[0]] - 200 and end[b[0]] > a[4] + 200:
                want.add((a[0], b[0]))
    jobs, hosts = spark.createDataFrame(rows, JOB), spark.createDataFrame(where, "id long, hostname string")
    for few in (64, 3, 0):
        monkeypatch.setattr(J, "FEW_HOSTS", few, raising=False)
        got = [tuple(r) for r in J.concurrent_jobs(jobs, hosts, now).collect()]
        assert sorted(got) == sorted(want)


def test_concurrent_pairs_are_not_shuffled(spark):
    jobs = spark.createDataFrame([(1, "c", "running", "multi_user", 0, 5), (2, "c", "running", "multi_user", 9, 5)], JOB)
    out = J.concurrent_jobs(jobs, spark.createDataFrame([(1, "h"), (2, "h")], "id long, hostname string"), 9000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan


def test_cells_of_jobs_move_once(spark):
    """One shuffle by job and host holds for all that follows by series."""
    from halyard.operators import timeseries as T

    rows = [(7, "c", "h", "hwthread", k, "load", 100 + t, t, float(k or 0)) for k in (0, 1, None) for t in (0, 60)] + [(7, "c", "h", "hwthread", 1, "load", 230, 3, 9.0)]
    samples = spark.createDataFrame([(*r, r[6] // 60) for r in rows], "id long, cluster string, hostname string, scope string, scope_id long, metric string, ts long, seq long, value double, cell long")
    config = spark.createDataFrame([("load", "sum")], "metric string, aggregation string").hint("broadcast")
    topology = spark.createDataFrame([(0, 0), (1, 0)], "hwthread long, socket long").hint("broadcast")
    for frame in (T.job_node_stats(samples, topology, config, 60), T.job_metrics(T.job_cells(samples, topology, config, 60, ["load"]))):
        plan = frame._jdf.queryExecution().sparkPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.split("AdaptiveSparkPlan")[-1].count("Exchange hashpartitioning(id") == 1
    got = {r.cell: r.value for r in T.job_cells(samples, topology, config, 60, ["load"], ("socket",)).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None}
    # A thread without a number gives values, but is no series: three values of two series leave a cell null.
    assert {r.value for r in T.job_cells(samples, topology, config, 60, ["load"]).collect()} == {None}


def test_packed_documents_read_like_a_tree(spark, tmp_path):
    """an archive and checkpoints as rows hold and give what the trees do, in few files."""
    import json
    import os

    from halyard.sources import archive as A
    from halyard.sources import samples as S
    from halyard.sources.job_tree import pack_documents, write_documents

    rows = [(k, "c" if k % 9 else None, "p", 1000 * k, k) for k in range(200)]
    jobs = spark.createDataFrame(rows, "job_id long, cluster string, project string, start_time long, duration long").coalesce(2)
    tree, packed = str(tmp_path / "tree"), str(tmp_path / "packed")
    A.write_job_tree(jobs, tree)
    pack_documents(A.job_documents(jobs).union(spark.createDataFrame([("c/0/000/1", "meta.json", "{ not json")], "folder string, name string, body string")), packed)
    key = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert key(A.read_job_archive(spark, packed, packed=True)) == key(A.read_job_archive(spark, tree))
    assert A.rejected_documents(spark, packed, packed=True).count() == 1
    assert len([f for f in os.listdir(packed) if f.endswith(".parquet")]) <= 3

    def checkpoint(begin):
        return json.dumps({"from": begin, "metrics": {"load": {"data": [1.0, None, 3.0], "frequency": 60, "start": begin}}, "children": {"socket0": {"metrics": {"load": {"data": [4.0], "frequency": 60, "start": begin}}}}})

    docs = [(f"c/h{h}", f"{b}.json", checkpoint(b)) for h, bs in enumerate([(0, 100, 200), (100,), (50, 300), (400,)]) for b in bs] + [("c/h0", "x.json", "{"), ("c/h1", "7.json", "{ no")]
    docs = spark.createDataFrame(docs, "folder string, name string, body string")
    write_documents(docs, f"{tree}2")
    pack_documents(docs, f"{packed}2")
    for since in (0, 100, 150, 1000):
        assert key(S.read_samples_checkpoint(spark, f"{packed}2", since, packed=True)) == key(S.read_samples_checkpoint(spark, f"{tree}2", since))


def test_gaps_are_filled_where_the_cells_are(spark):
    """No series is made from its ends alone; null keys, repeated and null cells."""
    from halyard.operators import timeseries as T

    rows = [("a", 3, 1.0), ("a", 7, None), ("a", 8, 2.0), ("a", 8, 5.0), ("a", 8, None), (None, 1, 4.0), (None, -1, 6.0), ("b", None, 1.0), ("c", 2, None)]
    out = T.grid_fill(spark.createDataFrame(rows, "k string, cell long, value double"), ("k",))
    want = [("a", 3, 1.0), *(("a", k, None) for k in (4, 5, 6, 7)), ("a", 8, 5.0), (None, -1, 6.0), (None, 0, None), (None, 1, 4.0), ("c", 2, None)]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan


def test_lines_are_matched_once(spark):
    """the pattern stands in the plan once for each of its groups, in no filter."""
    from halyard.sources import line_protocol as L

    texts = ["m,host=h,type=cpu,type-id=3 value=1.5 7", "m,hostname=h,cluster=x value=2i 8 ", "m value=1 9", "m,host=h value=1", "m,host=h other=1 9", " m,host=h value=1 9", "n,host=h value=1 9", "m,host=a/b value=1 9", "m,host=h,type=node,type-id=4 value=-1e3 10", None, ""]
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "seq long, line string").withColumn("line", F.concat("line", F.lit("")))
    out = L.parse_line_protocol(lines, "c", spark.createDataFrame([("m",)], "metric string"), keep=("seq",))
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("c", "h", "hwthread", "3", "m", 7, 1.5, 0), ("c", "h", "node", "", "m", 10, -1000.0, 8), ("x", "h", "node", "", "m", 8, 2.0, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(L.LINE) == 4


def test_series_of_jobs_are_not_sorted(spark):
    """samples pass by the hashed ids of their partition's jobs."""
    jobs = spark.createDataFrame([(1, "running", "x"), (2, "completed", "archiving"), (3, "completed", "done"), (3, "completed", "done"), (None, "running", "x")], "id long, job_state string, monitoring_status string")
    live = spark.createDataFrame([(k, "live") for k in (1, 1, 2, 3, 4, None)], "id long, origin string")
    out = J.job_series(jobs, live, live.withColumn("origin", F.lit("archive")))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "live"), (1, "live"), (2, "live"), (3, "archive")]
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()


def test_jobs_are_joined_once_for_all_metrics(spark, sf):
    """the jobs' rows are made once, with a row for each metric."""
    plan = entry.queries()["v3_normalize"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Window") == 1
