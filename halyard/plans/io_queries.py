"""Registered queries: round trips of sources and sinks, and streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.fixtures import full_jobs, view
from halyard.plans.node_queries import REPEATED, repeated_jobs
from halyard.plans.registry import query
from halyard.scratch import scratch_path
from halyard.sources import archive as A
from halyard.sources import samples as S
from halyard.streaming import streams as M

JOB_SQL = "SELECT id, cluster, project, start_time, flops_any_avg, job_name FROM jobs"


def _stored_jobs(spark, d) -> str:
    path = scratch_path(spark, "job-parquet")
    A.write_job_parquet(full_jobs(spark, d).drop("job_name", "flops_any_avg", "mem_bw_avg", "mem_used_max"), path, max_mb=8)
    return path


@query("io2_read_job_parquet", JOB_SQL)
def io2(spark, d):
    rows = A.read_job_parquet(spark, _stored_jobs(spark, d))
    return rows.select("id", "cluster", "project", "start_time", F.col("footprint")["flops_any_avg"].alias("flops_any_avg"), F.col("meta_data")["jobName"].alias("job_name"))


@query("io3_write_job_parquet", "SELECT cluster, count(*) AS jobs, count(DISTINCT subcluster) AS subclusters, CAST(sum(duration) AS BIGINT) AS seconds FROM jobs GROUP BY cluster")
def io3(spark, d):
    rows = spark.read.parquet(_stored_jobs(spark, d))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("subcluster").alias("subclusters"), F.sum("duration").alias("seconds"))


@query("io9_convert_to_json", "SELECT job_id, cluster, start_time, duration, flops_any_avg FROM jobs")
def io9(spark, d):
    target = scratch_path(spark, "job-json")
    A.convert_archive(spark, _stored_jobs(spark, d), target, "json")
    return A.read_job_json(spark, target).select("job_id", "cluster", "start_time", "duration", F.col("footprint")["flops_any_avg"].alias("flops_any_avg"))


@query("io4_node_state_parquet", "SELECT id, hostname, cluster, time_stamp, node_state, health_state FROM node_states")
def io4(spark, d):
    path = scratch_path(spark, "node-states")
    A.write_node_state_parquet(view(spark, d, "node_states"), path)
    return spark.read.parquet(path).select("id", "hostname", "cluster", "time_stamp", "node_state", "health_state")


@query("io5_samples_parquet", "SELECT cluster, hostname, scope, scope_id, metric, ts, seq, value FROM samples WHERE seq % 10 <> 0")
def io5(spark, d):
    path = scratch_path(spark, "samples")
    S.write_samples_parquet(view(spark, d, "samples").withColumn("value", F.when(F.col("seq") % 10 != 0, F.col("value"))), path)
    return S.read_samples_parquet(spark, path).select("cluster", "hostname", "scope", "scope_id", "metric", "ts", "seq", "value")


@query("io11_export_csv", "SELECT project, CAST(count(*) AS VARCHAR) AS jobs, '' AS note FROM jobs GROUP BY project")
def io11(spark, d):
    path = scratch_path(spark, "csv")
    table = view(spark, d, "jobs").groupBy("project").agg(F.count(F.lit(1)).alias("jobs")).withColumn("note", F.lit(None).cast("string"))
    A.export_csv(table, path)
    rows = spark.read.csv(path, header=True, schema="project string, jobs string, note string", escape='"')
    return rows.withColumn("note", F.coalesce("note", F.lit("")))


def _lines(spark, d):
    text = F.concat("metric", F.lit(",hostname="), "hostname", F.lit(",type=hwthread,type-id="), "scope_id", F.lit(" value="), F.format_string("%.1f", "value"), F.lit(" "), "ts")
    return view(spark, d, "samples").select("seq", text.alias("line"))


@query("s1_ingest_samples", "SELECT 'c0' AS cluster, hostname, 'hwthread' AS scope, CAST(scope_id AS VARCHAR) AS scope_id, metric, ts // 3600 * 3600 AS t, arg_max(value, seq) AS value FROM samples GROUP BY hostname, scope_id, metric, ts // 3600")
def s1(spark, d):
    return M.ingest_samples(_lines(spark, d), "c0", view(spark, d, "metric_config"), 3600)


@query("s3_job_lifecycle", """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time, id) AS k FROM repeated),
 g AS (SELECT id, job_id, cluster, k, start_time, true AS accepted, start_time AS last FROM n WHERE k = 1 UNION ALL SELECT n.id, n.job_id, n.cluster, n.k, n.start_time, n.start_time - g.last >= 86400, CASE WHEN n.start_time - g.last >= 86400 THEN n.start_time ELSE g.last END FROM g JOIN n ON n.job_id = g.job_id AND n.k = g.k + 1)
 SELECT cluster, job_id, start_time, CASE WHEN accepted THEN 'start' ELSE 'reject' END AS action FROM g""", REPEATED)
def s3(spark, d):
    body = F.struct(
        F.col("job_id").alias("jobId"), "cluster", F.col("start_time").alias("startTime"), F.lit("u").alias("user"), F.lit(1).alias("numNodes"), F.array(F.struct(F.lit("h").alias("hostname"))).alias("resources")
    )
    events = repeated_jobs(spark, d).select(F.lit("start_job").alias("function"), F.to_json(body).alias("event"), (F.col("start_time") * 1_000_000_000 + F.col("id")).alias("seq"))
    return M.job_lifecycle_batch(events).select("cluster", "job_id", "start_time", "action")


@query("s3_job_lifecycle_stops", """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time, id) AS k FROM repeated),
 g AS (SELECT id, job_id, cluster, k, start_time, true AS accepted, start_time AS last FROM n WHERE k = 1 UNION ALL SELECT n.id, n.job_id, n.cluster, n.k, n.start_time, n.start_time - g.last >= 86400, CASE WHEN n.start_time - g.last >= 86400 THEN n.start_time ELSE g.last END FROM g JOIN n ON n.job_id = g.job_id AND n.k = g.k + 1)
 SELECT cluster, job_id, start_time, CASE WHEN accepted THEN 'start' ELSE 'reject' END AS action, CASE WHEN accepted THEN '' ELSE 'duplicate start' END AS reason, CAST(0 AS BIGINT) AS duration FROM g
 UNION ALL SELECT cluster, job_id, start_time, CASE WHEN accepted THEN 'stop' ELSE 'reject' END, CASE WHEN accepted THEN '' WHEN start_time = last THEN 'not running' ELSE 'unknown job' END, CASE WHEN accepted THEN id % 50000 ELSE 0 END FROM g""", REPEATED)
def s3_stops(spark, d):
    """Every start is followed by a stop of its own; stops of refused starts find no job, or one that has ended."""
    jobs = repeated_jobs(spark, d)
    same = [F.col("job_id").alias("jobId"), "cluster", F.col("start_time").alias("startTime")]
    start = F.struct(*same, F.lit("u").alias("user"), F.lit(1).alias("numNodes"), F.array(F.struct(F.lit("h").alias("hostname"))).alias("resources"))
    stop = F.struct(*same, (F.col("start_time") + F.col("id") % 50000).alias("stopTime"))
    seq = (F.col("start_time") * 1_000_000_000 + F.col("id")) * 2
    events = jobs.select(F.explode(F.array(F.struct(F.lit("start_job").alias("function"), F.to_json(start).alias("event"), seq.alias("seq")), F.struct(F.lit("stop_job").alias("function"), F.to_json(stop).alias("event"), (seq + 1).alias("seq")))).alias("e"))
    return M.job_lifecycle_batch(events.select("e.*")).select("cluster", "job_id", "start_time", "action", "reason", "duration")


@query("s2_ingest_series", """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY hostname, scope_id, metric ORDER BY seq) AS k FROM samples),
 g AS (SELECT hostname, scope_id, metric, seq, value, ts, k, ts - 1800 AS b FROM n WHERE k = 1 UNION ALL SELECT n.hostname, n.scope_id, n.metric, n.seq, n.value, n.ts, n.k, CASE WHEN n.ts - g.b >= 512 * 3600 THEN n.ts - 1800 ELSE g.b END FROM g JOIN n ON n.hostname = g.hostname AND n.scope_id = g.scope_id AND n.metric = g.metric AND n.k = g.k + 1)
 SELECT 'c0' AS cluster, hostname, 'hwthread' AS scope, CAST(scope_id AS VARCHAR) AS scope_id, metric, b // 3600 + (ts - b) // 3600 AS cell, arg_max(value, seq) AS value FROM g WHERE ts >= b GROUP BY hostname, scope_id, metric, b // 3600 + (ts - b) // 3600""")
def s2(spark, d):
    """Samples in order of arrival into each series' own buffer; late ones are refused."""
    return M.ingest_series_batch(_lines(spark, d), "c0", view(spark, d, "metric_config"), 3600)


@query("s5_node_state_stream", """SELECT id, hostname, CASE WHEN node_state = 'down' THEN 'down' ELSE node_state END AS node_state, CASE WHEN node_state = 'down' THEN 'full' ELSE coalesce(h, 'failed') END AS health_state
 FROM node_states LEFT JOIN (SELECT hostname, min(health_state) AS h FROM node_states WHERE node_id % 3 <> 0 GROUP BY hostname) USING (hostname)""")
def s5(spark, d):
    states = view(spark, d, "node_states")
    health = states.where("node_id % 3 <> 0").groupBy("hostname").agg(F.min("health_state").alias("health_state"))
    events = states.select("id", "hostname", F.array(F.upper("node_state")).alias("states"))
    return M.node_state_rows(events, health).select("id", "hostname", "node_state", "health_state")


@query("io8_merged_config", "SELECT metric, max(peak) AS peak, max(normal) AS normal, max(caution) AS caution, max(alert) AS alert, CAST(max(timestep) AS INTEGER) AS timestep FROM (SELECT m.*, CAST(60 + 30 * n_regionkey AS INTEGER) AS timestep FROM metric_config m CROSS JOIN nation) GROUP BY metric")
def io8(spark, d):
    clusters = view(spark, d, "nation").select(F.concat(F.lit("c"), "n_regionkey").alias("cluster"), F.lower("n_name").alias("subcluster"), (F.lit(60) + 30 * F.col("n_regionkey")).cast("int").alias("timestep"))
    return S.merged_config(clusters.crossJoin(F.broadcast(view(spark, d, "metric_config"))))  # configuration
