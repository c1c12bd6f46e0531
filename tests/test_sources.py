import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from halyard.sources import archive as A
from halyard.sources import samples as S
from halyard.sources.line_protocol import parse_line_protocol


def meta(job_id, start, cluster="alpha", hosts=("h1", "h2"), **more):
    return {
        "jobId": job_id, "cluster": cluster, "subCluster": "main", "user": "ann", "project": "p", "partition": "q", "shared": "none", "jobState": "completed", "startTime": start,
        "duration": 7200, "walltime": 9000, "numNodes": len(hosts), "numHwthreads": 8, "resources": [{"hostname": h} for h in hosts],
        "statistics": {"flops_any": {"avg": 10.5, "min": 1, "max": 20, "unit": {"base": "F/s", "prefix": "G"}}, "cpu_power": {"avg": 250.0, "min": 0, "max": 300}},
        "tags": [{"type": "app", "name": "gromacs"}, {"type": "app", "name": "gromacs"}], "metaData": {"jobName": "x"}, **more,
    }


@pytest.fixture
def tree(tmp_path):
    docs = [meta(52017, 100), meta(52018, 200, hosts=("h3",)), meta(7, 300, cluster="beta")]
    for m in docs:
        folder = tmp_path / "tree" / m["cluster"] / str(m["jobId"] // 1000) / f"{m['jobId'] % 1000:03d}" / str(m["startTime"])
        folder.mkdir(parents=True)
        (folder / "meta.json").write_text(json.dumps(m, indent=1))
        data = {"flops_any": {"node": {"unit": {"base": "F/s"}, "timestep": 60, "series": [{"hostname": "h1", "statistics": {"avg": 1, "min": 0, "max": 2}, "data": [1.0, None, 3.0]}]}}}
        with gzip.open(folder / "data.json.gz", "wt") as f:
            json.dump(data, f)
    bad = tmp_path / "tree" / "alpha" / "9" / "009" / "1"
    bad.mkdir(parents=True)
    (bad / "meta.json").write_text("{ not json")
    return str(tmp_path / "tree")


def test_read_archive(spark, tree):
    jobs = A.read_job_archive(spark, tree, with_data=True)
    assert sorted((r.job_id, r.cluster, r.start_time, r.num_nodes) for r in jobs.collect()) == [(7, "beta", 300, 2), (52017, "alpha", 100, 2), (52018, "alpha", 200, 1)]
    rows = A.job_data_rows(jobs.where("job_id = 7")).orderBy("ts").collect()
    assert [(r.ts, r.value) for r in rows] == [(300, 1.0), (360, None), (420, 3.0)]
    assert A.rejected_documents(spark, tree).count() == 1


def test_parquet_round_trip_and_import(spark, tree, tmp_path):
    target = str(tmp_path / "pq")
    counts = A.convert_archive(spark, tree, target, "parquet").first()
    assert (counts.converted, counts.failed) == (3, 1)
    back, jobs = A.read_job_parquet(spark, target), A.read_job_archive(spark, tree)
    key = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.select(sorted(df.columns)).collect())
    assert key(back.select(jobs.columns)) == key(jobs)
    assert sorted(d for d in os.listdir(target) if d.startswith("cluster=")) == ["cluster=alpha", "cluster=beta"]
    lines = str(tmp_path / "lines")
    A.convert_archive(spark, target, lines, "json")
    assert A.read_job_json(spark, lines).count() == 3
    again = A.import_archive(spark, tree, target).first()
    assert (again.imported, again.skipped, again.failed) == (0, 3, 1)
    part = str(tmp_path / "part")
    A.write_job_parquet(jobs.where("cluster = 'beta'"), part)
    assert A.import_archive(spark, tree, part).first().imported == 2
    assert A.read_job_parquet(spark, part).count() == 3


def test_load_archive(spark, tree):
    config = spark.createDataFrame([("flops_any", "avg", ""), ("cpu_power", "", "power"), ("mem_used", "max", "")], "metric string, footprint string, energy string")
    lists = spark.createDataFrame([("alpha", "main", "h[1-9]")], "cluster string, subcluster string, nodes string")
    jobs, tags, links, rejects = A.load_archive(spark, tree, config, ["alpha"], lists)
    rows = {r.job_id: r for r in jobs.collect()}
    assert sorted(rows) == [52017, 52018]
    assert rows[52017].footprint == {"flops_any_avg": 10.5, "mem_used_max": 0.0}
    assert rows[52017].energy == pytest.approx(1.0)
    assert tags.count() == 1 and links.count() == 2
    assert "unknown cluster" in rejects.first().reasons


def test_node_states_and_csv(spark, tmp_path):
    states = spark.createDataFrame([("a", "h1", 5, "idle"), ("b", "h2", 6, "down")], "cluster string, hostname string, time_stamp long, node_state string")
    A.write_node_state_parquet(states, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2
    df = spark.createDataFrame([('say "hi"', 1), (None, 2)], "name string, n int").coalesce(1)
    A.export_csv(df, str(tmp_path / "c"))
    text = "".join((tmp_path / "c" / f).read_text() for f in os.listdir(tmp_path / "c") if f.endswith(".csv"))
    assert text == '"name","n"\n"say ""hi""","1"\n"","2"\n'


def test_checkpoint(spark, tmp_path):
    folder = tmp_path / "cp" / "alpha" / "h1"
    folder.mkdir(parents=True)
    doc = {
        "from": 0, "to": 100, "metrics": {"load_one": {"data": [1.0, None, 3.0], "frequency": 10, "start": 0}},
        "children": {"cpu3": {"metrics": {"flops": {"data": [5], "frequency": 10, "start": 50}}}, "socket0": {"metrics": {}, "children": {"x1": {"metrics": {"t": {"data": [7.5], "frequency": 1, "start": 9}}}}}},
    }
    (folder / "0.json").write_text(json.dumps(doc))
    (folder / "900.json").write_text("broken")  # names are begins, so it follows the first
    rows = S.read_samples_checkpoint(spark, str(tmp_path / "cp"))
    assert sorted((r.cluster, r.hostname, r.scope, r.scope_id, r.metric, r.ts, r.value) for r in rows.collect()) == [
        ("alpha", "h1", "hwthread", "3", "flops", 50, 5.0), ("alpha", "h1", "node", "", "load_one", 0, 1.0), ("alpha", "h1", "node", "", "load_one", 20, 3.0), ("alpha", "h1", "socket", "0.x1", "t", 9, 7.5),
    ]
    assert S.read_samples_checkpoint(spark, str(tmp_path / "cp"), 20).count() == 2
    S.write_samples_parquet(rows.withColumn("value", F.when(F.col("ts") == 9, float("nan")).otherwise(F.col("value"))), str(tmp_path / "out"))
    assert S.read_samples_parquet(spark, str(tmp_path / "out")).count() == 3


def test_cluster_config(spark, tmp_path):
    doc = {
        "name": "alpha",
        "subClusters": [{"name": n, "nodes": "h[1-4]", "topology": {"node": [0, 1, 2, 3], "socket": [[0, 1], [2, 3]], "memoryDomain": [[0, 1, 2, 3]], "core": [[0], [1], [2], [3]]}} for n in ("main", "big")],
        "metricConfig": [
            {"name": "load", "unit": {"base": "load"}, "scope": "node", "aggregation": "avg", "timestep": 60, "peak": 8, "normal": 8, "caution": 2, "alert": 1, "footprint": "avg", "subClusters": [{"name": "big", "peak": 80, "normal": 70, "caution": 20, "alert": 10}]},
            {"name": "gpu", "unit": {"prefix": "G", "base": "B"}, "scope": "accelerator", "timestep": 30, "peak": 1, "normal": 1, "caution": 1, "alert": 1, "restrict": True, "subClusters": [{"name": "main", "remove": True}]},
        ],
    }
    (tmp_path / "cluster.json").write_text(json.dumps(doc))
    config, topology, subclusters = S.read_cluster_config(spark, str(tmp_path / "cluster.json"))
    rows = {(r.subcluster, r.metric): r for r in config.collect()}
    assert sorted(rows) == [("big", "gpu"), ("big", "load"), ("main", "load")]
    assert (rows["big", "load"].peak, rows["big", "load"].footprint, rows["main", "load"].footprint) == (80, "", "avg")
    assert rows["big", "gpu"].unit == "GB"
    assert sorted((r.hwthread, r.socket, r.core, r.memory_domain) for r in topology.where("subcluster = 'main'").collect()) == [(0, 0, 0, 0), (1, 0, 1, 0), (2, 1, 2, 0), (3, 1, 3, 0)]
    assert {r.node_threads for r in subclusters.collect()} == {4}
    assert S.metric_availability(config, staff=False).first().metrics == ["load"]
    assert S.merged_config(config).where("metric = 'load'").first().peak == 80


def test_line_protocol(spark):
    config = spark.createDataFrame([("load",), ("flops",)], "metric string")
    lines = [
        "load,hostname=h1 value=1.5 10", "flops,cluster=c9,host=h2,type=cpu,type-id=3 value=7i 11", "load,hostname=../x value=1 12", "other,hostname=h1 value=1 13",
        "load,hostname=h1 field=1 14", "load value=1 15", "load,hostname=h1 value=2", "", "load,hostname=h1,type=node,type-id=4 value=-2e3 16",
    ]
    got = parse_line_protocol(spark.createDataFrame([(x,) for x in lines], "line string"), "c0", config).collect()
    assert sorted(tuple(r) for r in got) == [("c0", "h1", "node", "", "load", 10, 1.5), ("c0", "h1", "node", "", "load", 16, -2000.0), ("c9", "h2", "hwthread", "3", "flops", 11, 7.0)]


def test_checkpoint_depth_and_names(spark, tmp_path):
    folder = tmp_path / "cp" / "alpha" / "h1"
    folder.mkdir(parents=True)
    leaf = lambda v: {"m": {"data": [v], "frequency": 1, "start": 500}}
    deep = {"metrics": leaf(1), "children": {"socket1": {"metrics": leaf(2), "children": {"core2": {"metrics": leaf(3), "children": {"cpu3": {"metrics": leaf(4), "children": {"x": {"metrics": leaf(5)}}}}}}}}}
    for name in (0, 100, 400, 600):
        (folder / f"{name}.json").write_text(json.dumps(deep))
    (folder / "notes.json").write_text("{}")
    rows = S.read_samples_checkpoint(spark, str(tmp_path / "cp"), 450)
    (folder / "0.json").unlink()  # listed, but never opened
    (folder / "100.json").unlink()
    got = sorted((r.scope, r.scope_id, r.value) for r in rows.collect())
    assert got == sorted(2 * [("node", "", 1.0), ("socket", "1", 2.0), ("socket", "1.core2", 3.0), ("socket", "1.core2.cpu3", 4.0), ("socket", "1.core2.cpu3.x", 5.0)])


def test_tree_round_trip(spark, tree, tmp_path):
    pq, again, back = str(tmp_path / "pq"), str(tmp_path / "again"), str(tmp_path / "back")
    A.convert_archive(spark, tree, pq, "parquet")
    counts = A.convert_archive(spark, pq, again, "tree").first()
    assert (counts.converted, counts.failed) == (3, 0)
    assert os.path.isfile(f"{again}/alpha/52/017/100/meta.json")
    key = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.select(sorted(df.columns)).collect())
    assert key(A.read_job_archive(spark, again)) == key(A.read_job_archive(spark, tree))
    assert A.write_job_tree(A.read_job_archive(spark, tree, with_data=True), back)["converted"] == 6
    assert key(A.read_job_archive(spark, back, with_data=True)) == key(A.read_job_archive(spark, tree, with_data=True))
    odd = A.read_job_parquet(spark, pq).withColumn("cluster", F.when(F.col("job_id") > 7, F.col("cluster")))
    assert A.write_job_tree(odd, str(tmp_path / "odd")) == {"converted": 2, "failed": 1}


def test_batches_can_be_repeated(spark, tree, tmp_path, monkeypatch):
    from halyard.sources import commits

    jobs = A.read_job_archive(spark, tree).withColumn("id", F.col("job_id"))
    links = spark.createDataFrame([], "job_id long, tag_id string")
    tags = spark.createDataFrame([], "tag_id string, tag_type string")
    target = str(tmp_path / "archive")
    real = commits._text

    def die(value):
        raise RuntimeError("killed before the mark")

    monkeypatch.setattr(commits, "_text", die)
    with pytest.raises(RuntimeError):
        A.copy_jobs(jobs, links, tags, target, 250)
    monkeypatch.setattr(commits, "_text", real)
    assert spark.read.parquet(target).count() == 2  # moved in, not marked
    assert A.copy_jobs(jobs, links, tags, target, 250) == 2
    assert A.copy_jobs(jobs, links, tags, target, 250) == 0
    assert A.copy_jobs(jobs, links, tags, target, 1000) == 1
    assert sorted(r.job_id for r in spark.read.parquet(target).collect()) == [7, 52017, 52018]
    pq = str(tmp_path / "pq")
    A.write_job_parquet(A.read_job_archive(spark, tree).where("job_id = 7"), pq)
    monkeypatch.setattr(commits, "_text", die)
    with pytest.raises(RuntimeError):
        A.import_archive(spark, tree, pq)
    monkeypatch.setattr(commits, "_text", real)
    assert tuple(A.import_archive(spark, tree, pq).first()) == (2, 1, 1)
    assert tuple(A.import_archive(spark, tree, pq).first()) == (0, 3, 1)
    assert A.read_job_parquet(spark, pq).count() == 3


@pytest.mark.parametrize("width", [5, 3000])
def test_files_roll_by_bytes(spark, tmp_path, width):
    """No file holds more than the limit and one row, whatever the width of jobs; rows are
    all there, and the files of a cluster follow each other in time."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 5 == 0, "beta").when(F.col("id") % 97 == 1, None).otherwise("alpha").alias("cluster"),
        F.when(F.col("id") % 101 != 3, F.col("id") * 977 % 400_000).alias("start_time"), F.lit("s").alias("subcluster"), F.lit("p").alias("project"),
        F.expr(f"substr(repeat(sha2(cast(id as string), 256), 100), 1, {width})").alias("meta_data"), F.col("id").alias("job_id"),
    )
    path, limit = str(tmp_path / "rolled"), 65536
    A.write_job_parquet(rows, path, max_mb=limit / (1 << 20))
    back = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    plain = rows.select("job_id", A.row_bytes(rows).alias("bytes"))
    files = back.join(plain, "job_id").groupBy("file", "cluster").agg(F.sum("bytes").alias("bytes"), F.min("start_time").alias("lo"), F.max("start_time").alias("hi")).collect()
    assert back.count() == 4000 and back.select("job_id").distinct().count() == 4000
    assert max(f.bytes for f in files) <= limit + 64 + width
    whole = plain.agg(F.sum("bytes")).first()[0]
    assert whole / limit <= len(files) <= whole / limit + 4
    for cluster in {f.cluster for f in files}:
        spans = sorted((f.lo, f.hi) for f in files if f.cluster == cluster and f.lo is not None)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    A.write_job_parquet(rows.limit(0), str(tmp_path / "none"))
