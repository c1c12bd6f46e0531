"""Registered queries: time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.fixtures import STEP, view
from halyard.operators import joins as J
from halyard.operators import nodes as N
from halyard.operators import stats as A
from halyard.operators import timeseries as T
from halyard.plans.node_queries import LATEST, REBASED, rebased_jobs
from halyard.plans.registry import query

EXTRA = {
    **REBASED,
    "begins": f"SELECT *, min(ts) OVER (PARTITION BY cluster, hostname, scope, scope_id, metric) - {STEP} // 2 AS begins FROM samples",
    "placed": f"SELECT * EXCLUDE (begins), begins // {STEP} + (ts - begins) // {STEP} AS cell FROM begins",
    "cells": "SELECT cluster, hostname, scope, scope_id, metric, cell, arg_max(value, seq) AS value FROM placed GROUP BY ALL",
    "node_cells": """SELECT c.cluster, c.hostname, 'node' AS scope, CAST(0 AS BIGINT) AS scope_id, c.metric, cell, CASE WHEN count(value) = any_value(series) THEN CASE WHEN any_value(aggregation) = 'avg' THEN sum(value) / any_value(series) ELSE sum(value) END END AS value
 FROM cells c JOIN (SELECT cluster, hostname, metric, count(DISTINCT scope_id) AS series FROM cells GROUP BY ALL) s USING (cluster, hostname, metric) JOIN metric_config m ON m.metric = c.metric GROUP BY c.cluster, c.hostname, c.metric, cell""",
    "job_samples": "SELECT j.id, s.* FROM rebased j JOIN job_hosts h USING (id) JOIN placed s ON s.hostname = h.hostname AND s.ts >= j.start_time AND s.ts < j.start_time + j.duration",
    "job_cells": "SELECT id, hostname, scope_id, metric, cell, arg_max(value, seq) AS value FROM job_samples GROUP BY ALL",
    "job_node_cells": """SELECT c.id, c.hostname, c.metric, cell, CASE WHEN count(value) = any_value(series) THEN CASE WHEN any_value(aggregation) = 'avg' THEN sum(value) / any_value(series) ELSE sum(value) END END AS value
 FROM job_cells c JOIN (SELECT id, hostname, metric, count(DISTINCT scope_id) AS series FROM job_cells GROUP BY ALL) s USING (id, hostname, metric) JOIN metric_config m ON m.metric = c.metric GROUP BY c.id, c.hostname, c.metric, cell""",
}


def cells(spark, d):
    return T.dedup_samples(view(spark, d, "samples"), STEP)


def node_cells(spark, d):
    return T.scope_rollup(cells(spark, d), view(spark, d, "topology"), view(spark, d, "metric_config"), "hwthread", "node")


def job_hosts(spark, d):
    """The hosts of jobs; lines move once, as numbers, to where the jobs' rows go."""
    lines = view(spark, d, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    return lines.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("n"), "l_suppkey").alias("hostname"))


def job_samples(spark, d, metrics=None):
    samples = view(spark, d, "samples")
    samples = samples if metrics is None else samples.where(F.col("metric").isin(*metrics))
    return J.samples_for_jobs(T.with_cells(samples, STEP), rebased_jobs(spark, d), job_hosts(spark, d))


KEYS = "cluster, hostname, scope, scope_id, metric"
query("w4_dedup_samples", f"SELECT {KEYS}, cell, value FROM cells", EXTRA)(cells)
GRID = f"SELECT {KEYS}, cell, value FROM (SELECT {KEYS}, unnest(range(min(cell), max(cell) + 1)) AS cell FROM cells GROUP BY {KEYS}) LEFT JOIN cells USING ({KEYS}, cell)"
query("w7_grid_fill", GRID, EXTRA)(lambda spark, d: T.grid_fill(cells(spark, d)))
query("t1_align", GRID, EXTRA)(lambda spark, d: T.align(view(spark, d, "samples"), STEP))
LO, HI = 1704500000, 1705700000
A_, B_ = LO // STEP, -(-HI // STEP) - 1
query("t2_read_range", f"SELECT {KEYS}, cell, value FROM cells WHERE cell BETWEEN {A_} AND {B_}", EXTRA)(lambda spark, d: T.read_range(cells(spark, d), LO, HI, STEP))
query("t2_read_range_padded", f"""WITH i AS (SELECT * FROM cells WHERE cell BETWEEN {A_} AND {B_}) SELECT {KEYS}, cell, value FROM i UNION ALL SELECT {KEYS}, unnest(range({A_}, m)) AS cell, CAST(NULL AS DOUBLE) FROM (SELECT {KEYS}, min(cell) AS m FROM i GROUP BY {KEYS})""", EXTRA)(
    lambda spark, d: T.read_range(cells(spark, d), LO, HI, STEP, pad=True)
)
query("t3_select_series", f"SELECT {KEYS}, seq FROM samples WHERE hostname IN ('n1', 'n2', 'n30') AND scope_id = 2", EXTRA)(
    lambda spark, d: T.select_series(view(spark, d, "samples"), {"cluster": None, "hostname": ["n1", "n2", "n30"], "scope_id": "2"}).select("cluster", "hostname", "scope", "scope_id", "metric", "seq")
)
OWN_OF = "CAST(substring(hostname, 2, 20) AS BIGINT) % 2 = 0 AND scope_id = 0"  # hosts that also send series of their own


def scoped_samples(spark, d):
    samples = view(spark, d, "samples")
    return samples.unionByName(samples.where(OWN_OF).withColumn("scope", F.lit("node")))


query("t3_nearest_series", f"""WITH b AS (SELECT * FROM samples UNION ALL SELECT * REPLACE ('node' AS scope) FROM samples WHERE {OWN_OF})
 SELECT {KEYS}, seq FROM b QUALIFY scope = 'node' OR NOT bool_or(scope = 'node') OVER (PARTITION BY cluster, hostname, metric)""", EXTRA)(
    lambda spark, d: T.nearest_series(scoped_samples(spark, d)).select("cluster", "hostname", "scope", "scope_id", "metric", "seq")
)
for _scope in ("core", "socket"):
    query(f"t4_rollup_{_scope}", f"""WITH p AS (SELECT c.cluster, c.hostname, c.metric, t.{_scope} AS target, c.scope_id, cell, value, aggregation FROM cells c JOIN topology t ON t.hwthread = c.scope_id JOIN metric_config m ON m.metric = c.metric), s AS (SELECT cluster, hostname, metric, target, count(DISTINCT scope_id) AS series FROM p GROUP BY ALL)
 SELECT cluster, hostname, '{_scope}' AS scope, CAST(target AS BIGINT) AS scope_id, metric, cell, CASE WHEN count(value) = any_value(series) THEN CASE WHEN any_value(aggregation) = 'avg' THEN sum(value) / any_value(series) ELSE sum(value) END END AS value FROM p JOIN s USING (cluster, hostname, metric, target) GROUP BY cluster, hostname, metric, target, cell""", EXTRA)(
        lambda spark, d, scope=_scope: T.scope_rollup(cells(spark, d), view(spark, d, "topology"), view(spark, d, "metric_config"), "hwthread", scope)
    )
query("t4_rollup_node", f"SELECT {KEYS}, cell, value FROM node_cells", EXTRA)(node_cells)
query("t5_add_node_scope", f"SELECT {KEYS}, cell, value FROM cells UNION ALL SELECT {KEYS}, cell, value FROM node_cells WHERE metric IN ('flops_any', 'mem_bw')", EXTRA)(
    lambda spark, d: T.add_node_scope(cells(spark, d), view(spark, d, "topology"), view(spark, d, "metric_config"), "hwthread")
)
query("a16_series_stats", f"SELECT {KEYS}, avg(value) AS avg, min(value) AS min, max(value) AS max, count(value) AS samples FROM cells GROUP BY {KEYS}", EXTRA)(lambda spark, d: T.series_stats(cells(spark, d)))
query("a17_selector_stats", """SELECT metric, floor((CASE WHEN any_value(aggregation) = 'avg' THEN avg(a) ELSE sum(a) END) / 10000.0D + 0.5D) AS avg, min(lo) AS min, max(hi) AS max, CAST(sum(n) AS BIGINT) AS samples
 FROM (SELECT cluster, hostname, scope, scope_id, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(value) AS n FROM cells GROUP BY ALL) JOIN metric_config USING (metric) GROUP BY metric""", EXTRA)(
    lambda spark, d: T.selector_stats(cells(spark, d), view(spark, d, "metric_config")).withColumn("avg", F.floor(F.col("avg") / 10000.0 + 0.5).cast("double"))
)
NODE_STATS = "(SELECT l_orderkey AS id, 'flops_any' AS metric, CAST(l_quantity AS DOUBLE) AS avg, l_discount AS min, l_tax + 1 AS max FROM lineitem)"


def node_stats(spark, d):
    return view(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("flops_any").alias("metric"), F.col("l_quantity").alias("avg"), F.col("l_discount").alias("min"), (F.col("l_tax") + 1).alias("max"))


R = "floor(({}) * 100 + 0.5D) / 100"
query("a18_job_stats", f"""SELECT j.id, m.metric, {R.format('coalesce(a / nullif(num_nodes, 0), 0.0D)')} AS avg, {R.format('least(0.0D, coalesce(lo, 0.0D))')} AS min, {R.format('greatest(0.0D, coalesce(hi, 0.0D))')} AS max FROM jobs j CROSS JOIN (SELECT unnest(['flops_any', 'mem_bw']) AS metric) m
 LEFT JOIN (SELECT id, metric, sum(avg) AS a, min(min) AS lo, max(max) AS hi FROM {NODE_STATS} GROUP BY id, metric) s ON s.id = j.id AND s.metric = m.metric""")(
    lambda spark, d: T.job_stats(node_stats(spark, d), view(spark, d, "jobs"), ["flops_any", "mem_bw"])
)
query("a19_archive_job_stats", f"SELECT s.id, metric, {R.format('a / nullif(num_nodes, 0)')} AS avg, lo AS min, hi AS max FROM (SELECT id, metric, sum(avg) AS a, min(min) AS lo, max(max) AS hi FROM {NODE_STATS} GROUP BY id, metric) s JOIN jobs j ON j.id = s.id")(
    lambda spark, d: T.archive_job_stats(node_stats(spark, d), view(spark, d, "jobs"))
)
query("w6_stats_series", """SELECT metric, cell, min(value) AS min, avg(value) AS mean, median(value) AS median, max(value) AS max FROM cells WHERE metric IN (SELECT metric FROM cells GROUP BY metric HAVING count(DISTINCT (hostname, scope_id)) >= 8) GROUP BY metric, cell""", EXTRA)(
    lambda spark, d: T.stats_series(cells(spark, d), ("metric",))
)
query("a25_cluster_metrics", "SELECT metric, cell, floor(sum(value) * 0.001D * 100 + 0.5D) / 100 AS value, (SELECT count(DISTINCT hostname) FROM cells x WHERE x.metric = cells.metric) AS nodes FROM cells GROUP BY metric, cell", EXTRA)(
    lambda spark, d: T.cluster_metrics(cells(spark, d))
)
query("a15_roofline", """WITH b AS (SELECT hostname, cell, max(value) FILTER (metric = 'flops_any') AS f, max(value) FILTER (metric = 'mem_bw') AS b FROM node_cells GROUP BY hostname, cell), p AS (SELECT log10(f / b) AS x, log10(f) AS y FROM b WHERE f > 0 AND b > 0),
 k AS (SELECT least(floor((y - 2) / 3 * 20), 19) AS r, least(floor((x + 2) / 4 * 30), 29) AS c, count(*) AS n FROM p WHERE x >= -2 AND x < 2 AND y >= 2 AND y <= 5 GROUP BY 1, 2)
 SELECT CAST(g.g // 30 AS BIGINT) AS row, CAST(g.g % 30 AS BIGINT) AS col, coalesce(n, 0) AS n FROM range(600) g(g) LEFT JOIN k ON k.r = g.g // 30 AND k.c = g.g % 30""", EXTRA)(
    lambda spark, d: A.roofline_heatmap(node_cells(spark, d), 20, 30, -2.0, 2.0, 2.0, 5.0)
)


@query("t6_downsample_all", "SELECT metric, ts // 3600 AS cell, sum(value) AS value FROM samples GROUP BY ALL")
def t6_all(spark, d):
    hourly = view(spark, d, "samples").groupBy("metric", F.floor(F.col("ts") / 3600).alias("cell")).agg(F.sum("value").alias("value"))
    return T.downsample_lttb(hourly, 0, ("metric",))


@query("t6_downsample_lttb")
def t6(spark, d):
    """No SQL: the fold depends on the point picked before; tests hold it against a loop."""
    hourly = view(spark, d, "samples").groupBy("metric", F.floor(F.col("ts") / 3600).alias("cell")).agg(F.sum("value").alias("value"))
    return T.downsample_lttb(hourly, 60, ("metric",))


def job_cells(spark, d, metrics, scopes=("node",)):
    return T.job_cells(job_samples(spark, d, metrics), view(spark, d, "topology"), view(spark, d, "metric_config"), STEP, metrics, scopes)


query("t7_job_metrics", "SELECT c.id, c.hostname, c.metric, c.cell, c.value, s.a AS avg, s.lo AS min, s.hi AS max, s.n AS samples FROM job_node_cells c JOIN (SELECT id, hostname, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(value) AS n FROM job_node_cells GROUP BY ALL) s USING (id, hostname, metric) WHERE value IS NOT NULL AND metric IN ('flops_any', 'mem_used')", EXTRA)(
    lambda spark, d: T.job_metrics(job_cells(spark, d, ["flops_any", "mem_used"])).drop("cluster", "scope", "scope_id")
)
# Every metric at three scopes: sums of whole hundredths, so no order of adding shows.
SCOPED = {
    **EXTRA,
    "job_socket_cells": """SELECT c.id, c.hostname, c.metric, t.socket, cell, CASE WHEN count(value) = any_value(series) THEN sum(value) END AS value FROM job_cells c JOIN topology t ON t.hwthread = c.scope_id
 JOIN (SELECT id, hostname, metric, socket, count(DISTINCT scope_id) AS series FROM job_cells JOIN topology ON hwthread = scope_id GROUP BY ALL) s ON s.id = c.id AND s.hostname = c.hostname AND s.metric = c.metric AND s.socket = t.socket GROUP BY c.id, c.hostname, c.metric, t.socket, cell""",
    "job_scoped": """SELECT * FROM (SELECT id, hostname, 'hwthread' AS scope, scope_id, metric, cell, value FROM job_cells UNION ALL SELECT id, hostname, 'socket', CAST(socket AS BIGINT), metric, cell, value FROM job_socket_cells
 UNION ALL SELECT id, hostname, 'node', CAST(0 AS BIGINT), metric, cell, value FROM job_node_cells) WHERE metric IN ('flops_any', 'mem_bw', 'mem_used', 'cpu_power')""",
}
SUMMED, THREE = ["flops_any", "mem_bw", "mem_used", "cpu_power", "unknown"], ("node", "socket", "hwthread")
ONE_SERIES = "id, hostname, scope, scope_id, metric"
query("t7_job_metrics_scopes", f"SELECT {ONE_SERIES}, cell, value, a AS avg, lo AS min, hi AS max, n AS samples FROM job_scoped JOIN (SELECT {ONE_SERIES}, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(value) AS n FROM job_scoped GROUP BY ALL) USING ({ONE_SERIES}) WHERE value IS NOT NULL", SCOPED)(
    lambda spark, d: T.job_metrics(job_cells(spark, d, SUMMED, THREE)).drop("cluster")
)
query("t7_job_stats_series", """SELECT id, metric, scope, cell, min(value) AS min, avg(value) AS mean, median(value) AS median, max(value) AS max FROM job_scoped WHERE (id, metric, scope) IN (SELECT (id, metric, scope) FROM job_scoped GROUP BY id, metric, scope HAVING count(DISTINCT (hostname, scope_id)) >= 3) GROUP BY id, metric, scope, cell""", SCOPED)(
    lambda spark, d: T.job_stats_series(job_samples(spark, d, SUMMED), view(spark, d, "topology"), view(spark, d, "metric_config"), SUMMED, THREE, least=3)
)


@query("t9_archived_stats", "SELECT l_orderkey AS id, concat('n', l_suppkey) AS hostname, 'socket' AS scope, CAST(l_linenumber AS BIGINT) AS scope_id, 'flops_any' AS metric, l_quantity AS avg, l_discount AS min, l_extendedprice AS max FROM lineitem WHERE l_linenumber % 2 = 1")
def t9_archived(spark, d):
    odd = F.col("l_linenumber") % 2 == 1
    series = view(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("n"), "l_suppkey").alias("hostname"), F.when(odd, "socket").otherwise("core").alias("scope"), F.col("l_linenumber").cast("long").alias("scope_id"),
        F.lit("flops_any").alias("metric"), F.col("l_quantity").alias("avg"), F.col("l_discount").alias("min"), F.col("l_extendedprice").alias("max"),
    )
    return T.archived_job_stats(series, ["flops_any"], ["socket", "node"])


query("t8_job_node_stats", "SELECT id, hostname, metric, avg(value) AS avg, min(value) AS min, max(value) AS max, count(value) AS samples FROM job_node_cells GROUP BY ALL HAVING avg(value) IS NOT NULL", EXTRA)(
    lambda spark, d: T.job_node_stats(job_samples(spark, d), view(spark, d, "topology"), view(spark, d, "metric_config"), STEP)
)
query("t9_scoped_stats", f"SELECT {KEYS}, coalesce(avg(value), 0) AS avg, coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max, count(value) AS samples FROM (SELECT {KEYS}, value FROM cells UNION ALL SELECT {KEYS}, value FROM node_cells) GROUP BY {KEYS}", EXTRA)(
    lambda spark, d: T.scoped_job_stats(cells(spark, d), view(spark, d, "topology"), view(spark, d, "metric_config"), "hwthread", ["hwthread", "node"])
)
query("t10_node_metrics", f"""WITH r AS (SELECT hostname, metric, cell, value FROM node_cells WHERE metric IN ('flops_any', 'cpu_load') AND cell BETWEEN {A_} AND {B_}) SELECT r.*, a AS avg, lo AS min, hi AS max, node_state, health_state
 FROM r JOIN (SELECT hostname, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi FROM r GROUP BY ALL) s USING (hostname, metric) LEFT JOIN {LATEST} l USING (hostname)""", EXTRA)(
    lambda spark, d: T.node_metrics(cells(spark, d), view(spark, d, "topology"), view(spark, d, "metric_config"), N.latest_node_state(view(spark, d, "node_states")).drop("cluster"), ["flops_any", "cpu_load", "nothing"], LO, HI, STEP)
)


@query("t11_node_metrics_list", f"""WITH p AS (SELECT hostname FROM {LATEST} ORDER BY hostname LIMIT 20 OFFSET 20), r AS (SELECT hostname, metric, cell, value FROM node_cells WHERE metric = 'flops_any' AND cell BETWEEN {A_} AND {B_} AND hostname IN (SELECT hostname FROM p))
 SELECT r.*, a AS avg, lo AS min, hi AS max, node_state, health_state FROM r JOIN (SELECT hostname, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi FROM r GROUP BY ALL) s USING (hostname, metric) LEFT JOIN {LATEST} l USING (hostname)""", EXTRA)
def t11(spark, d):
    from halyard.operators.lists import node_list_page

    latest = N.latest_node_state(view(spark, d, "node_states")).drop("cluster")  # the samples are of one cluster
    shown = node_list_page(latest, 2, 20).select("hostname")
    rows = cells(spark, d).join(shown, "hostname", "left_semi")
    return T.node_metrics(rows, view(spark, d, "topology"), view(spark, d, "metric_config"), latest, ["flops_any"], LO, HI, STEP)


PAGE_SQL = f"(SELECT hostname, node_state, health_state, count(*) OVER () AS total, count(*) OVER () > 40 AS has_next FROM {LATEST} ORDER BY hostname LIMIT 20 OFFSET 20)"


@query("t11_node_metrics_page", f"""WITH p AS {PAGE_SQL}, r AS (SELECT hostname, scope, scope_id, metric, cell, value FROM (SELECT * FROM cells UNION ALL SELECT * FROM node_cells) WHERE metric IN ('flops_any', 'mem_bw') AND cell BETWEEN {A_} AND {B_} AND hostname IN (SELECT hostname FROM p))
 SELECT r.*, a AS avg, lo AS min, hi AS max, n AS samples, node_state, health_state, total, has_next FROM r JOIN (SELECT hostname, scope, scope_id, metric, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(value) AS n FROM r GROUP BY ALL) s USING (hostname, scope, scope_id, metric) JOIN p USING (hostname) WHERE value IS NOT NULL""", EXTRA)
def t11_page(spark, d):
    latest = N.latest_node_state(view(spark, d, "node_states")).drop("cluster")  # the samples are of one cluster
    rows = T.node_metrics_list(cells(spark, d), view(spark, d, "topology"), view(spark, d, "metric_config"), latest, ["flops_any", "mem_bw"], LO, HI, STEP, 2, 20, scopes=("node", "hwthread"))
    return rows.drop("cluster")


NOW_S = 1706600000
EXPECT = "(VALUES ('flops_any', 86400), ('mem_bw', 43200), ('cpu_load', 86400)) AS e(metric, step)"


@query("t13_metric_health", f"""WITH e AS (SELECT * FROM {EXPECT}), l AS (SELECT hostname, scope_id, metric, min(ts) AS first, max(ts) AS last FROM samples GROUP BY ALL), g AS (SELECT hostname, metric, bool_or(first - step // 2 + ((last - first + step // 2) // step + 1) * step < {NOW_S} - 5 * step) AS stale FROM l JOIN e USING (metric) GROUP BY ALL),
 h AS (SELECT hostname FROM samples UNION SELECT hostname FROM job_hosts), s AS (SELECT hostname, metric, stale FROM h CROSS JOIN e LEFT JOIN g USING (hostname, metric))
 SELECT hostname, coalesce(list(metric ORDER BY metric) FILTER (stale IS NULL), CAST([] AS VARCHAR[])) AS missing, coalesce(list(metric ORDER BY metric) FILTER (stale), CAST([] AS VARCHAR[])) AS degraded, CASE WHEN count(*) FILTER (NOT stale) = 0 THEN 'failed' WHEN count(*) FILTER (stale IS NULL OR stale) = 0 THEN 'full' ELSE 'partial' END AS health_state FROM s GROUP BY hostname""")
def t13(spark, d):
    expected = spark.createDataFrame([("flops_any", 86400), ("mem_bw", 43200), ("cpu_load", 86400)], "metric string, step long")
    hosts = view(spark, d, "samples").select("hostname").union(view(spark, d, "job_hosts").select("hostname"))
    return T.metric_health(view(spark, d, "samples"), expected, hosts, NOW_S).select("hostname", "missing", "degraded", "health_state")
