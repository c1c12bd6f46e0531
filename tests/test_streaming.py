import json
import time

import pytest
from pyspark.sql import functions as F

from halyard.operators.timeseries import dedup_samples
from halyard.sources.line_protocol import parse_line_protocol
from halyard.streaming.streams import JobLifecycle, ingest_samples, ingest_series, ingest_series_batch, job_lifecycle, job_lifecycle_batch, node_state_rows, sync_sink


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def write_lines(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def test_ingest_equals_batch(spark, tmp_path):
    config = spark.createDataFrame([("load",)], "metric string")
    rows = [(k, f"load,hostname=h{k % 3} value={k} {1000 + 7 * k}") for k in range(60)]
    path = str(tmp_path / "in")
    write_lines(spark, path, rows, "seq long, line string")
    stream = ingest_samples(spark.readStream.schema("seq long, line string").json(path), "c0", config, 60)
    got = {(r.hostname, r.t): r.value for r in run_stream(stream, "ingested", "complete").collect()}
    batch = parse_line_protocol(spark.read.schema("seq long, line string").json(path), "c0", config, keep=("seq",))
    want = {(r.hostname, r.cell * 60): r.value for r in dedup_samples(batch.withColumn("cell", F.floor(F.col("ts") / 60)), 60).collect()}
    assert got == want


def event(function, seq, **e):
    return (function, json.dumps(e), seq)


START = dict(jobId=1, cluster="c", user="ann", numNodes=1, resources=[{"hostname": "h"}], subCluster="s")
EVENTS = [
    event("start_job", 1, **START, startTime=1000),
    event("start_job", 2, **START, startTime=2000),  # duplicate within a day
    event("stop_job", 3, jobId=1, cluster="c", startTime=1000, stopTime=900),  # before its start
    event("stop_job", 4, jobId=1, cluster="c", stopTime=4600, jobState="failed"),
    event("stop_job", 5, jobId=1, cluster="c", stopTime=5000),  # already stopped
    event("start_job", 6, **START, startTime=1000 + 86400),  # the id again, a day later
    event("stop_job", 7, jobId=1, cluster="c", stopTime=90000),
    event("start_job", 8, **{**START, "jobId": 2, "numNodes": 3}, startTime=5),
    event("stop_job", 9, jobId=3, cluster="c", stopTime=1),
    ("start_job", "not json", 10),
]


def test_lifecycle(spark, tmp_path):
    path = str(tmp_path / "ev")
    schema = "function string, event string, seq long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (EVENTS[:3], EVENTS[3:7], EVENTS[7:]):
        write_lines(spark, path, part, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(path)
    got = run_stream(job_lifecycle(stream), "lifecycle")
    rows = sorted((r.job_id, r.action, r.reason, r.start_time, r.duration, r.job_state) for r in got.collect())
    assert rows == [
        (1, "reject", "duplicate start", 2000, 0, "running"), (1, "reject", "not running", 0, 0, "completed"), (1, "reject", "stop before start", 1000, 0, "completed"),
        (1, "start", "", 1000, 0, "running"), (1, "start", "", 87400, 0, "running"), (1, "stop", "", 1000, 3600, "failed"), (1, "stop", "", 87400, 2600, "completed"),
        (2, "reject", "resources differ from nodes", 5, 0, "running"), (3, "reject", "unknown job", 0, 0, "completed"),
    ]
    batch = job_lifecycle_batch(spark.read.schema(schema).json(path))
    assert sorted(map(str, batch.select(got.columns).collect())) == sorted(map(str, got.collect()))


def test_node_states(spark, tmp_path):
    path = str(tmp_path / "ns")
    schema = "hostname string, states array<string>, time_stamp long"
    write_lines(spark, path, [("h1", ["IDLE"], 5), ("h2", ["down", "idle"], 5), ("h3", ["MIXED"], 5)], schema)
    health = spark.createDataFrame([("h1", "partial")], "hostname string, health_state string")
    got = run_stream(node_state_rows(spark.readStream.schema(schema).json(path), health), "nodes")
    assert sorted((r.hostname, r.node_state, r.health_state) for r in got.collect()) == [("h1", "idle", "partial"), ("h2", "down", "full"), ("h3", "mixed", "failed")]


def test_node_subclusters(spark, tmp_path):
    path = str(tmp_path / "ns")
    schema = "hostname string, cluster string, states array<string>, time_stamp long"
    write_lines(spark, path, [("n1", "a", ["IDLE"], 5), ("n9", "a", ["IDLE"], 5), ("n1", "b", ["IDLE"], 5)], schema)
    health = spark.createDataFrame([("n1", "full")], "hostname string, health_state string")
    lists = spark.createDataFrame([("a", "low", "n[1-3]"), ("a", "rest", "*")], "cluster string, subcluster string, nodes string")
    got = run_stream(node_state_rows(spark.readStream.schema(schema).json(path), health, lists), "subclusters")
    assert {(r.cluster, r.hostname): r.subcluster for r in got.collect()} == {("a", "n1"): "low", ("a", "n9"): "rest", ("b", "n1"): None}


def test_sync_sink(spark, tmp_path):
    schema = "job_id long, cluster string, start_time long"
    main, seen = str(tmp_path / "main"), []
    spark.createDataFrame([(1, "c", 5)], schema).write.parquet(main)
    sink = sync_sink(lambda: spark.read.schema(schema).parquet(main), lambda df: df.write.mode("append").parquet(main), str(tmp_path / "staging"), (lambda df: seen.append(df.count()),))
    path = str(tmp_path / "staged")
    write_lines(spark, path, [(1, "c", 5), (2, "c", 6), (2, "c", 6)], schema)
    q = spark.readStream.schema(schema).json(path).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(main).count() == 2 and seen == [1]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_late_by_series(spark, tmp_path):
    """One series sends old rows while another is far ahead; only its own begin counts."""
    config = spark.createDataFrame([("load",)], "metric string")
    path, schema = str(tmp_path / "in"), "seq long, line string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    batches = [[("ahead", 1_000_000), ("slow", 1000)], [("ahead", 2_000_000), ("slow", 1100), ("slow", 994), ("slow", 995)], [("slow", 1120), ("slow", 1010), ("ahead", 1_000_000), ("slow", 9000), ("slow", 1130)]]
    seq = 0
    for rows in batches:
        write_lines(spark, path, [((seq := seq + 1), f"load,hostname={h} value={seq} {t}") for h, t in rows], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    got = run_stream(ingest_series(stream, "c0", config, 10), "by_series", "update").collect()
    last = {}
    for r in got:
        if not r.late and r.seq >= last.get((r.hostname, r.cell), (0,))[0]:
            last[r.hostname, r.cell] = (r.seq, r.value)
    assert sorted((r.hostname, r.seq) for r in got if r.late) == [("ahead", 9), ("slow", 5), ("slow", 11)]
    batch = ingest_series_batch(spark.read.schema(schema).json(path), "c0", config, 10).collect()
    assert {(r.hostname, r.cell): r.value for r in batch} == {k: v for k, (_, v) in last.items()}


def test_state_ends(spark, tmp_path):
    """With an age limit the same rows come, and the state store has a clock."""
    path, schema = str(tmp_path / "ev"), "function string, event string, seq long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    write_lines(spark, path, EVENTS, schema)
    stream = job_lifecycle(spark.readStream.schema(schema).json(path), idle_days=400)
    q = stream.writeStream.format("memory").queryName("ends").outputMode("append").start()
    got, until = spark.table("ends"), time.time() + 60
    while got.count() < 9 and time.time() < until:  # a stream with a clock never rests
        time.sleep(0.5)
    q.stop()
    batch = job_lifecycle_batch(spark.read.schema(schema).json(path))
    assert sorted(map(str, batch.select(got.columns).collect())) == sorted(map(str, got.collect()))


def test_lifecycle_state_is_short():
    class Row:
        function, hosts, num_nodes, hpc_user, subcluster, stop_time, job_state = "start_job", 1, 1, "u", "s", None, None

    jobs = []
    for k in range(1000):
        start, stop = Row(), Row()
        start.start_time = stop.start_time = k * 86400
        stop.function, stop.stop_time = "stop_job", k * 86400 + 5
        assert JobLifecycle.apply(jobs, start)[1] == "start" and JobLifecycle.apply(jobs, stop)[1] == "stop"
        assert len(jobs) <= 2


def test_start_guard_of_a_hot_key(spark):
    from halyard.operators.lists import duplicate_start_guard

    starts = spark.range(300_000).selectExpr("id", "7L AS job_id", "'c' AS cluster", "id * 13 AS start_time").union(spark.sql("SELECT 1000000L, 7L, 'c', CAST(NULL AS BIGINT)"))
    got = {r.start_time for r in duplicate_start_guard(starts, 86400).where("accepted").collect()}
    want, last = {None}, None
    for t in range(0, 300_000 * 13, 13):
        if last is None or t - last >= 86400:
            want.add(t)
            last = t
    assert got == want
