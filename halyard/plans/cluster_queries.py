"""Registered queries: operators over five clusters, with the configuration that the
reader gives for each cluster, subcluster and metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.fixtures import REBASE, REBASE_SPAN, STEP, cluster_config, cluster_samples, view
from halyard.operators import energy as W
from halyard.operators import joins as J
from halyard.operators import nodes as N
from halyard.operators import timeseries as T
from halyard.operators.config import with_subcluster
from halyard.plans.node_queries import LATEST
from halyard.plans.registry import query

NUMBER = "CAST(substr({}, 2) AS BIGINT)"
SUB = "CASE WHEN {c} IN ('c0', 'c2', 'c4') AND concat('c', {u} % 5) = {c} AND {u} < 75 THEN 'a' ELSE 'b' END"


def _sub(cluster: str, host: str) -> str:
    return SUB.format(c=cluster, u=NUMBER.format(host))


ROLL = "CASE WHEN count(value) = any_value(series) THEN CASE WHEN any_value(aggregation) = 'avg' THEN sum(value) / any_value(series) ELSE sum(value) END END AS value"
EXTRA = {
    "config5": """SELECT s.cluster, s.subcluster, m.metric, CASE WHEN s.cluster = 'c2' AND m.metric = 'mem_bw' THEN 'avg' ELSE m.aggregation END AS aggregation,
 CASE WHEN s.cluster = 'c0' AND s.subcluster = 'b' AND m.metric = 'mem_used' THEN 600.0D ELSE m.peak END AS peak, m.normal, m.caution, m.alert,
 CASE WHEN s.cluster = 'c0' AND s.subcluster = 'b' AND m.metric = 'mem_used' THEN 'avg' WHEN s.cluster = 'c3' AND m.metric = 'flops_any' THEN 'max' ELSE m.footprint END AS footprint,
 CASE WHEN s.cluster = 'c4' AND m.metric = 'cpu_power' THEN 'energy' ELSE m.energy END AS energy, m.lower_is_better
 FROM metric_config m CROSS JOIN (VALUES ('c0', 'a'), ('c0', 'b'), ('c1', 'b'), ('c2', 'a'), ('c2', 'b'), ('c3', 'b'), ('c4', 'a'), ('c4', 'b')) s(cluster, subcluster)
 WHERE NOT (s.cluster = 'c0' AND s.subcluster = 'a' AND m.metric = 'cpu_load')""",
    "topology5": "SELECT * FROM (VALUES ('a', 0, 0, 0), ('a', 1, 0, 0), ('a', 2, 1, 1), ('a', 3, 1, 1), ('b', 0, 0, 0), ('b', 1, 1, 0), ('b', 2, 2, 0), ('b', 3, 3, 0)) AS t(subcluster, hwthread, core, socket)",
    "samples5": f"SELECT concat('c', {NUMBER.format('hostname')} % 5) AS cluster, {_sub(f'''concat('c', {NUMBER.format('hostname')} % 5)''', 'hostname')} AS subcluster, hostname, scope, scope_id, metric, ts, seq, value FROM samples",
    "placed5": f"SELECT *, (min(ts) OVER w - {STEP} // 2) // {STEP} + (ts - (min(ts) OVER w - {STEP} // 2)) // {STEP} AS cell FROM samples5 WINDOW w AS (PARTITION BY cluster, hostname, scope, scope_id, metric)",
    "cells5": "SELECT cluster, subcluster, hostname, scope, scope_id, metric, cell, arg_max(value, seq) AS value FROM placed5 GROUP BY ALL",
    "rolled5": f"""SELECT c.cluster, c.subcluster, c.hostname, 'node' AS scope, CAST(0 AS BIGINT) AS scope_id, c.metric, cell, {ROLL} FROM cells5 c JOIN config5 m ON m.cluster = c.cluster AND m.subcluster = c.subcluster AND m.metric = c.metric
 JOIN (SELECT cluster, hostname, metric, count(DISTINCT scope_id) AS series FROM cells5 GROUP BY ALL) s ON s.cluster = c.cluster AND s.hostname = c.hostname AND s.metric = c.metric GROUP BY c.cluster, c.subcluster, c.hostname, c.metric, cell""",
    "parted5": """SELECT c.*, t.core, t.socket, m.aggregation FROM cells5 c JOIN topology5 t ON t.subcluster = c.subcluster AND t.hwthread = c.scope_id JOIN config5 m ON m.cluster = c.cluster AND m.subcluster = c.subcluster AND m.metric = c.metric""",
    "rebased5": f"SELECT id, cluster, num_nodes, {REBASE} + start_time % {REBASE_SPAN} AS start_time, duration FROM jobs",
    "job_samples5": "SELECT j.id, s.* FROM rebased5 j JOIN job_hosts h USING (id) JOIN placed5 s ON s.cluster = j.cluster AND s.hostname = h.hostname AND s.ts >= j.start_time AND s.ts < j.start_time + j.duration",
    "job_cells5": "SELECT id, cluster, subcluster, hostname, scope_id, metric, cell, arg_max(value, seq) AS value FROM job_samples5 GROUP BY ALL",
    "job_nodes5": f"""SELECT c.id, c.hostname, c.metric, cell, {ROLL} FROM job_cells5 c JOIN config5 m ON m.cluster = c.cluster AND m.subcluster = c.subcluster AND m.metric = c.metric
 JOIN (SELECT id, hostname, metric, count(DISTINCT scope_id) AS series FROM job_cells5 GROUP BY ALL) s ON s.id = c.id AND s.hostname = c.hostname AND s.metric = c.metric GROUP BY c.id, c.hostname, c.metric, cell""",
    # Statistics of jobs, with the place of their first host.
    "job_places": f"SELECT j.id, j.cluster, {_sub('j.cluster', 'h.hostname')} AS subcluster, j.num_nodes, j.duration FROM jobs j JOIN (SELECT id, min(hostname) AS hostname FROM job_hosts GROUP BY id) h ON h.id = j.id",
    "line_stats": "SELECT l_orderkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'flops_any' WHEN 1 THEN 'mem_used' WHEN 2 THEN 'cpu_power' ELSE 'cpu_load' END AS metric, CAST(max(l_quantity) AS DOUBLE) AS avg, CAST(min(l_quantity) AS DOUBLE) AS min, CAST(max(l_quantity) + 7 AS DOUBLE) AS max FROM lineitem GROUP BY 1, 2",
}


def cells(spark, d):
    _, _, subclusters = cluster_config(spark)
    return with_subcluster(T.dedup_samples(cluster_samples(spark, d), STEP), subclusters)


def _job_samples(spark, d):
    """Samples of jobs by cluster and host, with the host's subcluster."""
    _, _, subclusters = cluster_config(spark)
    start = (F.lit(REBASE) + F.col("start_time") % REBASE_SPAN).cast("long")
    jobs = view(spark, d, "jobs").select("id", "cluster", start.alias("start_time"), "duration")
    rows = J.samples_for_jobs(T.with_cells(cluster_samples(spark, d), STEP), jobs, view(spark, d, "job_hosts"))
    return with_subcluster(rows, subclusters)


KEYS = "cluster, subcluster, hostname, scope, scope_id, metric"
for _scope in ("core", "socket"):
    query(f"t4_clusters_{_scope}", f"""SELECT p.cluster, p.subcluster, p.hostname, '{_scope}' AS scope, CAST(p.{_scope} AS BIGINT) AS scope_id, p.metric, cell, {ROLL} FROM parted5 p
 JOIN (SELECT cluster, hostname, metric, {_scope} AS t, count(DISTINCT scope_id) AS series FROM parted5 GROUP BY ALL) s ON s.cluster = p.cluster AND s.hostname = p.hostname AND s.metric = p.metric AND s.t = p.{_scope} GROUP BY p.cluster, p.subcluster, p.hostname, p.{_scope}, p.metric, cell""", EXTRA)(
        lambda spark, d, scope=_scope: T.scope_rollup(cells(spark, d), cluster_config(spark)[1], cluster_config(spark)[0], "hwthread", scope)
    )


def rolled(spark, d):
    config, topology, _ = cluster_config(spark)
    return T.scope_rollup(cells(spark, d), topology, config, "hwthread", "node")


query("t4_clusters_node", f"SELECT {KEYS}, cell, value FROM rolled5", EXTRA)(rolled)
query("t5_clusters", f"SELECT {KEYS}, cell, value FROM cells5 UNION ALL SELECT {KEYS}, cell, value FROM rolled5 WHERE metric IN ('flops_any', 'mem_bw')", EXTRA)(
    lambda spark, d: T.add_node_scope(cells(spark, d), cluster_config(spark)[1], cluster_config(spark)[0], "hwthread")
)
query("j6_clusters", "SELECT id, cluster, subcluster, seq, metric, value FROM job_samples5", EXTRA)(lambda spark, d: _job_samples(spark, d).select("id", "cluster", "subcluster", "seq", "metric", "value"))
query("t7_clusters", "SELECT c.id, c.hostname, c.metric, c.cell, c.value, s.a AS avg, s.lo AS min, s.hi AS max, s.n AS samples FROM job_nodes5 c JOIN (SELECT id, hostname, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(value) AS n FROM job_nodes5 GROUP BY ALL) s USING (id, hostname, metric) WHERE value IS NOT NULL AND metric IN ('flops_any', 'cpu_load', 'mem_bw')", EXTRA)(
    lambda spark, d: T.job_metrics(T.job_cells(_job_samples(spark, d), cluster_config(spark)[1], cluster_config(spark)[0], STEP, ["flops_any", "cpu_load", "mem_bw"])).drop("cluster", "scope", "scope_id")
)
query("t8_clusters", "SELECT id, hostname, metric, avg(value) AS avg, min(value) AS min, max(value) AS max, count(value) AS samples FROM job_nodes5 GROUP BY ALL HAVING avg(value) IS NOT NULL", EXTRA)(
    lambda spark, d: T.job_node_stats(_job_samples(spark, d), cluster_config(spark)[1], cluster_config(spark)[0], STEP)
)
SERIES_KEYS = "cluster, hostname, scope, scope_id, metric"
query("t9_clusters", f"SELECT {SERIES_KEYS}, coalesce(avg(value), 0) AS avg, coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max, count(value) AS samples FROM (SELECT {SERIES_KEYS}, value FROM cells5 UNION ALL SELECT {SERIES_KEYS}, value FROM rolled5) GROUP BY {SERIES_KEYS}", EXTRA)(
    lambda spark, d: T.scoped_job_stats(cells(spark, d), cluster_config(spark)[1], cluster_config(spark)[0], "hwthread", ["hwthread", "node"])
)
LO, HI = 1704500000, 1705700000
A_, B_ = LO // STEP, -(-HI // STEP) - 1
query("t10_clusters", f"""WITH r AS (SELECT cluster, subcluster, hostname, metric, cell, value FROM rolled5 WHERE metric IN ('flops_any', 'cpu_load') AND cell BETWEEN {A_} AND {B_}) SELECT r.*, a AS avg, lo AS min, hi AS max, node_state, health_state
 FROM r JOIN (SELECT cluster, hostname, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi FROM r GROUP BY ALL) s USING (cluster, hostname, metric) LEFT JOIN (SELECT cluster, hostname, node_state, health_state FROM {LATEST}) l USING (cluster, hostname)""", EXTRA)(
    lambda spark, d: T.node_metrics(cells(spark, d), cluster_config(spark)[1], cluster_config(spark)[0], N.latest_node_state(view(spark, d, "node_states")), ["flops_any", "cpu_load", "nothing"], LO, HI, STEP)
)
NOW_S = 1706600000


@query("t13_clusters", f"""WITH l AS (SELECT cluster, hostname, scope_id, metric, min(ts) AS first, max(ts) AS last FROM samples5 GROUP BY ALL), h AS (SELECT DISTINCT cluster, subcluster, hostname FROM samples5),
 g AS (SELECT cluster, hostname, metric, bool_or(first - {STEP} // 2 + ((last - first + {STEP} // 2) // {STEP} + 1) * {STEP} < {NOW_S} - 5 * {STEP}) AS stale FROM l GROUP BY ALL),
 s AS (SELECT h.cluster, h.hostname, c.metric, g.stale FROM h JOIN config5 c USING (cluster, subcluster) LEFT JOIN g ON g.cluster = h.cluster AND g.hostname = h.hostname AND g.metric = c.metric)
 SELECT cluster, hostname, coalesce(list(metric ORDER BY metric) FILTER (stale IS NULL), CAST([] AS VARCHAR[])) AS missing, coalesce(list(metric ORDER BY metric) FILTER (stale), CAST([] AS VARCHAR[])) AS degraded, CASE WHEN count(*) FILTER (NOT stale) = 0 THEN 'failed' WHEN count(*) FILTER (stale IS NULL OR stale) = 0 THEN 'full' ELSE 'partial' END AS health_state FROM s GROUP BY cluster, hostname""", EXTRA)
def t13(spark, d):
    config, _, subclusters = cluster_config(spark)
    samples = cluster_samples(spark, d)
    hosts = with_subcluster(samples.select("cluster", "hostname").distinct(), subclusters)
    expected = config.select("cluster", "subcluster", "metric", F.col("timestep").cast("long").alias("step"))
    return T.metric_health(samples, expected, hosts, NOW_S).select("cluster", "hostname", "missing", "degraded", "health_state")


@query("j10_clusters", "SELECT s.cluster, s.subcluster, s.seq, s.metric, c.peak, c.normal, c.caution, c.alert, c.footprint, c.lower_is_better FROM samples5 s JOIN config5 c ON c.cluster = s.cluster AND c.subcluster = s.subcluster AND c.metric = s.metric", EXTRA)
def j10(spark, d):
    config, _, subclusters = cluster_config(spark)
    rows = J.with_thresholds(with_subcluster(cluster_samples(spark, d), subclusters), config)
    return rows.select("cluster", "subcluster", "seq", "metric", "peak", "normal", "caution", "alert", "footprint", "lower_is_better")


query("a17_clusters", """SELECT s.cluster, s.metric, floor(CASE WHEN any_value(aggregation) = 'avg' THEN avg(a) ELSE sum(a) END + 0.5D) AS avg, min(lo) AS min, max(hi) AS max, CAST(sum(n) AS BIGINT) AS samples
 FROM (SELECT cluster, subcluster, hostname, scope_id, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(value) AS n FROM cells5 GROUP BY ALL) s JOIN config5 c ON c.cluster = s.cluster AND c.subcluster = s.subcluster AND c.metric = s.metric GROUP BY s.cluster, s.metric""", EXTRA)(
    lambda spark, d: T.selector_stats(cells(spark, d), cluster_config(spark)[0]).withColumn("avg", F.floor(F.col("avg") + 0.5).cast("double"))
)
query("a25_clusters", "SELECT cluster, metric, cell, floor(sum(value) * 0.001D * 100 + 0.5D) / 100 AS value, (SELECT count(DISTINCT hostname) FROM cells5 x WHERE x.cluster = cells5.cluster AND x.metric = cells5.metric) AS nodes FROM cells5 GROUP BY cluster, metric, cell", EXTRA)(
    lambda spark, d: T.cluster_metrics(cells(spark, d), by=("cluster",))
)


def job_stats(spark, d):
    """(id, metric, avg, min, max, cluster, subcluster, num_nodes, duration): the place is the first host's."""
    _, _, subclusters = cluster_config(spark)
    first = view(spark, d, "job_hosts").groupBy("id").agg(F.min("hostname").alias("hostname"))
    jobs = with_subcluster(view(spark, d, "jobs").select("id", "cluster", "num_nodes", "duration").join(first, "id"), subclusters).drop("hostname")
    line = F.col("l_linenumber") % 4
    metric = F.when(line == 0, "flops_any").when(line == 1, "mem_used").when(line == 2, "cpu_power").otherwise("cpu_load")
    stats = view(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), metric.alias("metric")).agg(
        F.max("l_quantity").cast("double").alias("avg"), F.min("l_quantity").cast("double").alias("min"), (F.max("l_quantity") + 7).cast("double").alias("max")
    )
    return stats.join(jobs, "id")


@query("c8_clusters", """SELECT DISTINCT p.id, concat(c.metric, '_', c.footprint) AS name, coalesce(CASE c.footprint WHEN 'avg' THEN l.avg WHEN 'max' THEN l.max ELSE l.min END, 0.0D) AS value
 FROM (SELECT * FROM job_places WHERE id IN (SELECT id FROM line_stats)) p JOIN config5 c ON c.cluster = p.cluster AND c.subcluster = p.subcluster AND c.footprint <> '' LEFT JOIN line_stats l ON l.id = p.id AND l.metric = c.metric""", EXTRA)
def c8(spark, d):
    return W.footprint(job_stats(spark, d), cluster_config(spark)[0]).select("id", F.explode("footprint").alias("name", "value"))


@query("c10_clusters", """SELECT p.id, CASE WHEN c.energy = 'power' THEN floor(l.avg * p.num_nodes * (p.duration / CAST(3600 AS DOUBLE)) / 1000 * 100 + 0.5D) / 100 ELSE 0.0D END AS energy
 FROM job_places p JOIN line_stats l ON l.id = p.id JOIN config5 c ON c.cluster = p.cluster AND c.subcluster = p.subcluster AND c.metric = l.metric AND c.energy IN ('power', 'energy')""", EXTRA)
def c10(spark, d):
    rows = job_stats(spark, d)
    return W.energy(rows.select("id", "num_nodes", "duration").distinct(), rows.drop("num_nodes", "duration"), cluster_config(spark)[0]).select("id", "energy")


HOUR = 3600
KEYS5 = "cluster, hostname, scope, scope_id, metric"


@query("w4_grids_begun_anew", f"""WITH RECURSIVE grids AS (SELECT cluster, hostname, scope, scope_id, metric, min(ts) AS f, min(ts) - {HOUR} // 2 AS b FROM samples5 GROUP BY ALL
 UNION ALL SELECT g.cluster, g.hostname, g.scope, g.scope_id, g.metric, min(s.ts), min(s.ts) - {HOUR} // 2 FROM grids g JOIN samples5 s ON s.cluster = g.cluster AND s.hostname = g.hostname AND s.scope = g.scope AND s.scope_id = g.scope_id AND s.metric = g.metric AND s.ts >= g.b + 512 * {HOUR} GROUP BY g.cluster, g.hostname, g.scope, g.scope_id, g.metric, g.b)
 SELECT {KEYS5}, cell, arg_max(value, seq) AS value FROM (SELECT s.cluster, s.hostname, s.scope, s.scope_id, s.metric, s.seq, s.value, max(g.b) // {HOUR} + (s.ts - max(g.b)) // {HOUR} AS cell FROM samples5 s JOIN grids g ON s.cluster = g.cluster AND s.hostname = g.hostname AND s.scope = g.scope AND s.scope_id = g.scope_id AND s.metric = g.metric AND g.f <= s.ts GROUP BY s.cluster, s.hostname, s.scope, s.scope_id, s.metric, s.ts, s.seq, s.value) GROUP BY {KEYS5}, cell""", EXTRA)
def w4_anew(spark, d):
    """An hour's step: a month is more than one grid of 512 cells. A grid holds the samples
    from its first on (``f``); those in the half step before stay on the grid before it."""
    return T.dedup_samples(cluster_samples(spark, d), HOUR)
