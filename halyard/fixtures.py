"""Adapter views: the driver's tables in the shapes of the job monitoring model.

Each view is one SELECT that Spark and DuckDB both read; ``EPOCH(x)`` is seconds
since 1970. ``view`` builds one as a DataFrame, ``ctes`` the same text as common
table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1009843200
SHORT = 300
#: Job windows re-based into the month of the samples.
REBASE, REBASE_SPAN = 1704067200, 2592000
STEP = 86400
#: Seconds since 1970 of a time without zone, whatever the session's time zone.
EPOCH_SQL = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({} AS TIMESTAMP_NTZ))"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

VIEWS: dict[str, str] = {
    "job_hosts": "SELECT DISTINCT l_orderkey AS id, concat('n', l_suppkey) AS hostname FROM lineitem",
    "job_stats": "SELECT l_orderkey AS id, CAST(floor(sum(CAST(floor(l_extendedprice) AS BIGINT)) / count(*)) AS DOUBLE) AS flops_any_avg,"
    " CAST(floor(sum(CAST(l_quantity AS BIGINT)) / count(*)) AS DOUBLE) AS mem_bw_avg, max(l_quantity) AS mem_used_max FROM lineitem GROUP BY l_orderkey",
    "jobs": """SELECT o.o_orderkey AS id, o.o_orderkey AS job_id, concat('u', o.o_custkey % 150) AS hpc_user,
 lower(c.c_mktsegment) AS project, concat('c', n.n_regionkey) AS cluster, lower(n.n_name) AS subcluster,
 o.o_orderpriority AS cluster_partition,
 CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS job_state,
 CASE o.o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'single_user' ELSE 'multi_user' END AS shared,
 EPOCH(o.o_orderdate) + (o.o_orderkey % 86400) AS start_time,
 CAST(floor(o.o_totalprice) AS BIGINT) % 172800 AS duration, CAST(86400 AS BIGINT) AS walltime,
 coalesce(h.num_nodes, 0) AS num_nodes, coalesce(h.num_nodes, 0) * 72 AS num_hwthreads,
 CASE WHEN o.o_orderkey % 4 = 0 THEN coalesce(h.num_nodes, 0) * 4 ELSE 0 END AS num_acc,
 CASE WHEN o.o_orderkey % 10 = 0 THEN 'interactive' ELSE concat('job_', lower(o.o_orderpriority)) END AS job_name,
 s.flops_any_avg, s.mem_bw_avg, s.mem_used_max
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT id, count(*) AS num_nodes FROM job_hosts GROUP BY id) h ON h.id = o.o_orderkey
LEFT JOIN job_stats s ON s.id = o.o_orderkey""",
    "tags": "SELECT DISTINCT p_brand AS tag_id, CASE WHEN p_brand LIKE '%1' THEN 'app' WHEN p_brand LIKE '%2' THEN 'jobClass' ELSE 'user' END AS tag_type,"
    " lower(p_brand) AS tag_name, CASE WHEN p_brand LIKE '%3' THEN 'admin' WHEN p_brand LIKE '%4' THEN 'u1' ELSE 'global' END AS tag_scope FROM part",
    "job_tags": "SELECT DISTINCT l.l_orderkey AS job_id, p.p_brand AS tag_id FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber = 1",
    "users": "SELECT DISTINCT concat('u', c_custkey % 150) AS username, concat('User ', c_custkey % 150) AS name FROM customer",
    # Values are whole hundredths, so sums do not depend on their order.
    "samples": """SELECT 'c0' AS cluster, concat('n', user_id) AS hostname, 'hwthread' AS scope, CAST(event_id % 4 AS BIGINT) AS scope_id,
 CASE event_type WHEN 'click' THEN 'flops_any' WHEN 'view' THEN 'mem_bw' WHEN 'purchase' THEN 'cpu_load' WHEN 'signup' THEN 'mem_used' ELSE 'cpu_power' END AS metric,
 EPOCH(ts) AS ts, event_id AS seq, CAST(floor(value * 100) AS DOUBLE) AS value FROM events""",
    "node_states": """SELECT event_id AS id, user_id AS node_id, concat('n', user_id) AS hostname, concat('c', user_id % 5) AS cluster, EPOCH(ts) AS time_stamp,
 CASE event_type WHEN 'click' THEN 'allocated' WHEN 'view' THEN 'idle' WHEN 'purchase' THEN 'mixed' WHEN 'signup' THEN 'reserved' ELSE 'down' END AS node_state,
 CASE WHEN value < 30 THEN 'full' WHEN value < 90 THEN 'partial' ELSE 'failed' END AS health_state FROM events""",
    "job_scripts": "SELECT doc_id AS id, text AS job_script, lang, source FROM documents",
    "metric_config": """SELECT * FROM (VALUES
 ('flops_any', 'hwthread', 'sum', 500.0D, 250.0D, 50.0D, 20.0D, 'avg', '', false),
 ('mem_bw', 'hwthread', 'sum', 500.0D, 250.0D, 50.0D, 20.0D, 'avg', '', false),
 ('cpu_load', 'hwthread', 'avg', 500.0D, 250.0D, 50.0D, 20.0D, 'avg', '', false),
 ('mem_used', 'hwthread', 'sum', 500.0D, 300.0D, 400.0D, 450.0D, 'max', '', true),
 ('cpu_power', 'hwthread', 'sum', 500.0D, 250.0D, 50.0D, 20.0D, '', 'power', false))
 AS t(metric, native_scope, aggregation, peak, normal, caution, alert, footprint, energy, lower_is_better)""",
    "topology": "SELECT * FROM (VALUES (0, 0, 0, 0), (1, 0, 0, 0), (2, 1, 1, 1), (3, 1, 1, 1)) AS t(hwthread, core, memory_domain, socket)",
}
#: Views that a view is built from.
_NEEDS = {"jobs": ("job_hosts", "job_stats")}


def _names(text: str) -> list[str]:
    return [n for n in (*VIEWS, *TABLES) if re.search(rf"(?:FROM|JOIN)\s+{n}\b", text)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a plain table, of the data under ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in _names(text)}
    body = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in inputs else m[0], text)
    body = re.sub(r"EPOCH\(([\w.]+)\)", lambda m: EPOCH_SQL.format(m[1]), body)
    return spark.sql(body, **inputs)


def duckdb_text(text: str) -> str:
    text = re.sub(r"EPOCH\(([\w.]+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)
    return re.sub(r"\b(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", text)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the views that it uses as common table expressions."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for n in known:
            if re.search(rf"(?:FROM|JOIN)\s+{n}\b", text) and n not in order:
                need(known[n])
                if n not in order:
                    order.append(n)

    need(sql)
    head = ",\n".join(f"{n} AS ({duckdb_text(known[n])})" for n in order)
    body = duckdb_text(sql).strip()
    if not head:
        return body
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {head},\n{re.sub(r'^WITH[ ]+RECURSIVE', '', body).strip()}"
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {head},\n{body[4:].strip()}"
    return f"WITH {head}\n{body}"


def full_jobs(spark: SparkSession, sf_dir: str, resources: bool = False) -> DataFrame:
    """Jobs with their nested columns: footprint, meta_data and, on demand,
    resources (one struct a host)."""
    jobs = view(spark, sf_dir, "jobs")
    entries = [(k, F.col(k)) for k in ("flops_any_avg", "mem_bw_avg", "mem_used_max")]
    pairs = F.create_map(*[x for k, c in entries for x in (F.lit(k), c)])
    jobs = jobs.withColumn("footprint", F.when(F.col("flops_any_avg").isNotNull(), pairs)).withColumn(
        "meta_data", F.create_map(F.lit("jobName"), F.col("job_name"))
    )
    if resources:
        hosts = view(spark, sf_dir, "job_hosts").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("hostname"))).alias("resources"))
        jobs = jobs.join(hosts, "id", "left")
    return jobs


#: Cluster documents of five clusters: even ones list half of their hosts as
#: subcluster a (two sockets), all else is b (one socket). Metrics as in
#: ``metric_config``, with overrides of clusters and subclusters, one metric removed.
CLUSTERS = ("c0", "c1", "c2", "c3", "c4")


def cluster_documents() -> list[dict]:
    limits = {"peak": 500.0, "normal": 250.0, "caution": 50.0, "alert": 20.0}
    used = {"peak": 500.0, "normal": 300.0, "caution": 400.0, "alert": 450.0, "lowerIsBetter": True}
    two = {"node": [0, 1, 2, 3], "socket": [[0, 1], [2, 3]], "memoryDomain": [[0, 1], [2, 3]], "core": [[0, 1], [2, 3]]}
    one = {"node": [0, 1, 2, 3], "socket": [[0, 1, 2, 3]], "memoryDomain": [[0, 1], [2, 3]], "core": [[0], [1], [2], [3]]}
    out = []
    for k, cluster in enumerate(CLUSTERS):
        listed = [{"name": "a", "nodes": ",".join(f"n{u}" for u in range(k, 75, 5)), "topology": two}] if k % 2 == 0 else []
        metrics = {
            "flops_any": {**limits, "aggregation": "sum", "footprint": "avg"}, "mem_bw": {**limits, "aggregation": "avg" if k == 2 else "sum", "footprint": "avg"},
            "cpu_load": {**limits, "aggregation": "avg", "footprint": "avg"}, "mem_used": {**used, "aggregation": "sum", "footprint": "max"},
            "cpu_power": {**limits, "aggregation": "sum", "energy": "energy" if k == 4 else "power"},
        }
        if k == 0:
            metrics["cpu_load"]["subClusters"] = [{"name": "a", "remove": True}]
            metrics["mem_used"]["subClusters"] = [{"name": "b", **used, "peak": 600.0, "footprint": "avg"}]
        if k == 3:
            metrics["flops_any"]["subClusters"] = [{"name": "b", **limits, "footprint": "max"}]
        config = [{"name": n, "unit": {"base": "x"}, "scope": "hwthread", "timestep": STEP, **m} for n, m in metrics.items()]
        out.append({"name": cluster, "subClusters": [*listed, {"name": "b", "nodes": "*", "topology": one}], "metricConfig": config})
    return out


def cluster_config(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(configuration, topology, subclusters) of the documents, through the reader."""
    import json

    from halyard.scratch import scratch_path
    from halyard.sources.samples import read_cluster_config

    path = scratch_path(spark, "clusters")
    spark.createDataFrame([(json.dumps(cluster_documents()),)], "value string").coalesce(1).write.text(path)
    return read_cluster_config(spark, path)


def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples, each host in one of five clusters."""
    return view(spark, sf_dir, "samples").withColumn("cluster", F.concat(F.lit("c"), F.substring("hostname", 2, 20).cast("long") % 5))
