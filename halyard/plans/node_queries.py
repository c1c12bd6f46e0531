"""Registered queries: joins, nodes, lists and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.fixtures import EPOCH_SQL, NOW, REBASE, REBASE_SPAN, SHORT, full_jobs, view
from halyard.functions import scalars as S
from halyard.operators import filters as P
from halyard.operators import joins as J
from halyard.operators import lists as X
from halyard.operators import nodes as N
from halyard.operators import stats as A
from halyard.plans.job_queries import STATS, TOOK
from halyard.plans.registry import query

CUT = 1705500000


def V(name):
    return lambda spark, d: view(spark, d, name)


query("flagship_top_users", f"SELECT hpc_user AS name, {STATS} FROM jobs WHERE cluster = 'c1' AND job_state <> 'running' GROUP BY hpc_user ORDER BY total_node_hours DESC, name LIMIT 10")(
    lambda spark, d: X.top_list(
        A.jobs_stats_grouped(P.filter_jobs(view(spark, d, "jobs"), P.JobFilter(cluster=P.StringFilter(eq="c1"), state=("completed", "failed"))), "hpc_user", NOW, SHORT), "total_node_hours"
    )
)
query("x4_top_projects", "SELECT project AS name, count(*) AS total_jobs FROM jobs GROUP BY project ORDER BY total_jobs DESC, name LIMIT 3")(
    lambda spark, d: X.top_list(A.jobs_stats_grouped(view(spark, d, "jobs"), "project", NOW, SHORT, measures=("total_jobs",)), "total_jobs", 3)
)
query("j1_job_tags", "SELECT j.id, tag_id, tag_type, tag_name FROM jobs j JOIN job_tags jt ON jt.job_id = j.id JOIN tags USING (tag_id)")(
    lambda spark, d: J.job_tag_list(view(spark, d, "jobs"), view(spark, d, "job_tags"), view(spark, d, "tags"))
)
query("j1_readable_tags", "SELECT j.id, tag_id, tag_type, tag_name FROM jobs j JOIN job_tags jt ON jt.job_id = j.id JOIN tags USING (tag_id) WHERE tag_scope IN ('global', 'u1')")(
    lambda spark, d: J.job_tag_list(view(spark, d, "jobs"), view(spark, d, "job_tags"), view(spark, d, "tags"), P.User("u1", frozenset({"user"})))
)
for _mode, _cond in (("all", "true"), ("user", "tag_type NOT IN ('app', 'jobClass')")):
    query(f"j4_anti_tagged_{_mode}", f"SELECT id FROM jobs WHERE id NOT IN (SELECT job_id FROM job_tags JOIN tags USING (tag_id) WHERE {_cond})")(
        lambda spark, d, mode=_mode: J.anti_tagged(view(spark, d, "jobs"), view(spark, d, "job_tags"), view(spark, d, "tags"), mode).select("id")
    )
LATEST = "(SELECT * FROM node_states QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY time_stamp DESC, id DESC) = 1)"
STATE_COLS = ["id", "node_id", "hostname", "cluster", "time_stamp", "node_state", "health_state"]
query("w1_latest_node_state", f"SELECT {', '.join(STATE_COLS)} FROM {LATEST}")(lambda spark, d: N.latest_node_state(view(spark, d, "node_states")))
query("w2_expired_node_states", f"SELECT id FROM (SELECT *, max(time_stamp) OVER (PARTITION BY node_id) AS m FROM node_states) WHERE time_stamp < {CUT} AND time_stamp < m")(
    lambda spark, d: N.expired_node_states(view(spark, d, "node_states"), CUT).select("id")
)


@query("j3_nodes_with_state", f"SELECT c.c_custkey AS node_id, s.id, s.node_state FROM customer c JOIN {LATEST} s ON s.node_id = c.c_custkey")
def j3(spark, d):
    nodes = view(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return N.nodes_with_state(nodes, view(spark, d, "node_states")).select("node_id", "id", "node_state")


CONCURRENT = f"""WITH p AS (SELECT id, cluster, job_state, shared, start_time, CASE WHEN job_state = 'running' THEN {NOW} ELSE start_time + duration END AS e, hostname FROM jobs JOIN job_hosts USING (id))
 SELECT DISTINCT a.id, b.id AS other FROM p a JOIN p b ON a.cluster = b.cluster AND a.hostname = b.hostname AND a.id <> b.id WHERE a.shared <> 'none' AND a.e - a.start_time > 600
 AND ((b.job_state <> 'running' AND b.start_time < a.e - 200 AND b.e > a.start_time + 200) OR (b.job_state = 'running' AND b.start_time <= a.e - 200))"""


def j5(spark, d):
    # A host may be named twice here, so lines move once, as numbers.
    lines = view(spark, d, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey")
    hosts = lines.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("n"), "l_suppkey").alias("hostname"))
    return J.concurrent_jobs(view(spark, d, "jobs"), hosts, NOW)


for _name in ("j5_concurrent_jobs", "j5_concurrent_jobs_all"):  # two names of one query
    query(_name, CONCURRENT)(j5)


REBASED = {"rebased": f"SELECT id, job_state, hpc_user, num_nodes, {REBASE} + start_time % {REBASE_SPAN} AS start_time, duration FROM jobs"}


def rebased_jobs(spark, d):
    start = (F.lit(REBASE) + F.col("start_time") % REBASE_SPAN).cast("long")
    return view(spark, d, "jobs").select("id", "job_state", "hpc_user", "num_nodes", start.alias("start_time"), "duration")


query("j6_samples_for_jobs", "SELECT j.id, s.seq, s.metric, s.value FROM rebased j JOIN job_hosts h USING (id) JOIN samples s ON s.hostname = h.hostname AND s.ts >= j.start_time AND s.ts < j.start_time + j.duration", REBASED)(
    lambda spark, d: J.samples_for_jobs(view(spark, d, "samples").select("hostname", "ts", "seq", "metric", "value"), rebased_jobs(spark, d), view(spark, d, "job_hosts")).select("id", "seq", "metric", "value")
)
query("j7_user_names", "SELECT s.name, s.total_jobs, coalesce(u.name, '') AS display_name FROM (SELECT hpc_user AS name, count(*) AS total_jobs FROM jobs GROUP BY hpc_user) s LEFT JOIN users u ON u.username = s.name")(
    lambda spark, d: A.with_user_names(A.jobs_stats_grouped(view(spark, d, "jobs"), "hpc_user", NOW, measures=("total_jobs",)), view(spark, d, "users"))
)
query("j8_nodes_not_in_db", "SELECT DISTINCT concat('n', c_custkey) AS hostname FROM customer WHERE concat('n', c_custkey) NOT IN (SELECT hostname FROM node_states) AND contains(concat('n', c_custkey), '1')")(
    lambda spark, d: J.nodes_not_in_db(view(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_custkey")).alias("hostname")), view(spark, d, "node_states"), "1")
)
FIRST_HOST = {"hosted": "SELECT j.id, j.cluster, CASE WHEN j.id % 5 = 0 THEN j.subcluster ELSE 'none' END AS subcluster, (SELECT min(hostname) FROM job_hosts h WHERE h.id = j.id) AS first_host FROM jobs j"}


@query("j9_assign_subcluster", """SELECT id, CASE WHEN subcluster <> 'none' AND cluster <> 'c4' THEN subcluster WHEN cluster IN ('c0', 'c1') AND regexp_matches(first_host, '^n([1-4][0-9])$') THEN 'low' WHEN cluster IN ('c0', 'c1') AND first_host IN ('n7', 'n05') THEN 'seven'
 WHEN cluster IN ('c0', 'c2') THEN 'rest' END AS assigned FROM hosted""", FIRST_HOST)
def j9(spark, d):
    jobs = view(spark, d, "jobs")
    first = view(spark, d, "job_hosts").groupBy("id").agg(F.min("hostname").alias("first_host"))
    known = jobs.where("cluster <> 'c4'").select("cluster", "subcluster").distinct().withColumn("nodes", F.lit("x[1-2]"))
    lists = [("c0", "low", "n[10-49]"), ("c1", "low", "n[10-29,30-49]"), ("c0", "seven", "n7,n05"), ("c1", "seven", "n7"), ("c0", "rest", "*"), ("c2", "rest", "*")]
    lists = known.unionByName(spark.createDataFrame(lists, "cluster string, subcluster string, nodes string"))
    hosted = jobs.join(first, "id", "left").withColumn("subcluster", F.when(F.col("id") % 5 == 0, F.col("subcluster")).otherwise("none"))
    return J.assign_subcluster(hosted.select("id", "cluster", "subcluster", "first_host"), lists).select("id", "assigned")


query("j10_thresholds", "SELECT seq, metric, peak, normal, caution, alert FROM samples JOIN (SELECT * FROM metric_config WHERE metric <> 'cpu_load') USING (metric)")(
    lambda spark, d: J.with_thresholds(view(spark, d, "samples"), view(spark, d, "metric_config").where("metric <> 'cpu_load'")).select("seq", "metric", "peak", "normal", "caution", "alert")
)


@query("j11_node_roofline", f"""SELECT m.hostname, m.flops, coalesce(s.node_state, 'notindb') AS node_state, coalesce(b.n, 0) AS jobs FROM (SELECT concat('n', l_suppkey) AS hostname, max(l_quantity) AS flops FROM lineitem GROUP BY l_suppkey) m
 LEFT JOIN {LATEST} s ON s.hostname = m.hostname LEFT JOIN (SELECT hostname, count(*) AS n FROM job_hosts JOIN jobs USING (id) WHERE job_state = 'running' GROUP BY hostname) b ON b.hostname = m.hostname""")
def j11(spark, d):
    metrics = view(spark, d, "lineitem").groupBy(F.concat(F.lit("n"), "l_suppkey").alias("hostname")).agg(F.max("l_quantity").alias("flops"))
    return J.node_roofline_info(metrics, N.latest_node_state(view(spark, d, "node_states")), view(spark, d, "jobs"), view(spark, d, "job_hosts")).select("hostname", "flops", "node_state", "jobs")


query("a21_allocated_nodes", "SELECT subcluster, count(DISTINCT hostname) AS nodes, count(*) AS allocations FROM jobs JOIN job_hosts USING (id) WHERE job_state = 'running' AND cluster = 'c1' GROUP BY subcluster")(
    lambda spark, d: N.allocated_nodes(view(spark, d, "jobs"), view(spark, d, "job_hosts"), "c1")
)
query("a22_used_nodes", "SELECT cluster, list_sort(list(DISTINCT hostname)) AS hosts FROM jobs JOIN job_hosts USING (id) WHERE job_state = 'running' AND start_time < 950000000 GROUP BY cluster")(
    lambda spark, d: N.used_nodes(view(spark, d, "jobs"), view(spark, d, "job_hosts"), 950000000)
)
query("a23_count_states", f"WITH l AS {LATEST} SELECT 'node' AS kind, node_state AS state, count(*) AS n FROM l GROUP BY node_state UNION ALL SELECT 'health', health_state, count(*) FROM l GROUP BY health_state")(
    lambda spark, d: N.count_states(N.latest_node_state(view(spark, d, "node_states")))
)
query("a24_state_timeline", "SELECT state, list(time_stamp ORDER BY time_stamp) AS times, list(n ORDER BY time_stamp) AS counts FROM (SELECT node_state AS state, time_stamp, count(*) AS n FROM node_states GROUP BY 1, 2) GROUP BY state")(
    lambda spark, d: N.state_timeline(view(spark, d, "node_states"), "node_state")
)
query("w8_stacked_timeline", """WITH c AS (SELECT node_state AS state, time_stamp // 3600 * 3600 AS time_stamp, count(*) AS n FROM node_states GROUP BY 1, 2)
 SELECT time_stamp, state, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY time_stamp ORDER BY state) AS BIGINT) AS stacked FROM (SELECT DISTINCT time_stamp FROM c) CROSS JOIN (SELECT DISTINCT state FROM c) LEFT JOIN c USING (time_stamp, state)""")(
    lambda spark, d: N.stacked_timeline(view(spark, d, "node_states"), "node_state", 3600)
)
query("a32_node_jobs", "SELECT hostname, list_sort(list(DISTINCT hpc_user)) AS users, list_sort(list(DISTINCT project)) AS projects FROM jobs JOIN job_hosts USING (id) GROUP BY hostname")(
    lambda spark, d: N.node_jobs_summary(view(spark, d, "jobs"), view(spark, d, "job_hosts"))
)


@query("a33_job_detail", """SELECT j.id, j.hpc_user, coalesce(t.tags, CAST([] AS VARCHAR[])) AS tags, CASE WHEN j.job_state = 'completed' THEN s.flops_any_avg END AS flops, CASE WHEN j.job_state = 'completed' THEN s.mem_used_max END AS mem_used FROM jobs j
 LEFT JOIN (SELECT job_id, list_sort(list(tag_name)) AS tags FROM job_tags JOIN tags USING (tag_id) GROUP BY job_id) t ON t.job_id = j.id LEFT JOIN job_stats s ON s.id = j.id""")
def a33(spark, d):
    jobs = view(spark, d, "jobs").withColumn("monitoring_status", F.when(F.col("job_state") == "completed", "success").otherwise("running")).select("id", "hpc_user", "monitoring_status")
    stats = view(spark, d, "job_stats").select("id", F.col("flops_any_avg").alias("flops"), F.col("mem_used_max").alias("mem_used"))
    rows = J.job_tag_list(jobs, view(spark, d, "job_tags"), view(spark, d, "tags"))
    return X.job_detail(jobs, rows, stats).drop("monitoring_status")


for _tail in ("", "_all"):  # two names of one query
    query(f"x1_order_by_column{_tail}", "SELECT id, start_time FROM jobs ORDER BY start_time DESC, id")(lambda spark, d: X.order_jobs(view(spark, d, "jobs"), "startTime", "col", "DESC").select("id", "start_time"))
    query(f"x1_order_by_footprint{_tail}", "SELECT id, flops_any_avg FROM jobs WHERE flops_any_avg IS NOT NULL ORDER BY flops_any_avg, id")(
        lambda spark, d: X.order_jobs(full_jobs(spark, d), "flops_any_avg", "foot", "ASC").select("id", "flops_any_avg")
    )
query("x2_page", "SELECT id, duration FROM jobs ORDER BY duration, id LIMIT 25 OFFSET 50")(lambda spark, d: X.page(X.order_jobs(view(spark, d, "jobs"), "duration"), 3, 25).select("id", "duration"))


@query("x3_jobs_list", "SELECT id, (SELECT count(*) FROM jobs WHERE cluster = 'c2') AS total, (SELECT count(*) FROM jobs WHERE cluster = 'c2') > 20 AS has_next FROM jobs WHERE cluster = 'c2' ORDER BY start_time, id LIMIT 10 OFFSET 10")
def x3(spark, d):
    rows, info = X.jobs_list(X.order_jobs(view(spark, d, "jobs").where("cluster = 'c2'"), "startTime"), 2, 10)
    return rows.select("id").crossJoin(info)


@query("x5_metric_stats", """SELECT id, start_time, CAST(2 AS INTEGER) AS metrics, fa AS flops_avg, ba AS bw_avg, bm AS bw_max FROM jobs JOIN (SELECT l_orderkey AS id,
 CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) / count(*) AS fa, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS ba, max(l_quantity) AS bm FROM lineitem GROUP BY l_orderkey) USING (id)""")
def x5(spark, d):
    from halyard.plans.job_queries import node_averages

    stats = node_averages(spark, d).groupBy("id", "metric").agg(F.avg("avg").alias("avg"), F.min("avg").alias("min"), F.max("avg").alias("max"))
    rows = X.jobs_metric_stats(view(spark, d, "jobs").select("id", "start_time"), stats)
    flops, bandwidth = F.col("stats")[0], F.col("stats")[1]
    return rows.select("id", "start_time", F.size("stats").alias("metrics"), flops["avg"].alias("flops_avg"), bandwidth["avg"].alias("bw_avg"), bandwidth["max"].alias("bw_max"))


query("x6_node_list_page", f"SELECT hostname, node_state, (SELECT count(*) FROM {LATEST} WHERE contains(hostname, '1')) AS total, (SELECT count(*) FROM {LATEST} WHERE contains(hostname, '1')) > 20 AS has_next FROM {LATEST} WHERE contains(hostname, '1') ORDER BY hostname LIMIT 10 OFFSET 10")(
    lambda spark, d: X.node_list_page(N.latest_node_state(view(spark, d, "node_states")), 2, 10, "1").select("hostname", "node_state", "total", "has_next")
)
query("x6_node_list_configured", "SELECT hostname, CAST(NULL AS VARCHAR) AS node_state, count(*) OVER () AS total, count(*) OVER () > 20 AS has_next FROM (SELECT DISTINCT hostname FROM job_hosts WHERE contains(hostname, '1')) ORDER BY hostname LIMIT 10 OFFSET 10")(
    lambda spark, d: X.node_list_page(N.latest_node_state(view(spark, d, "node_states")).where("cluster = 'unknown'"), 2, 10, "1", view(spark, d, "job_hosts")).select("hostname", "node_state", "total", "has_next")
)
SCOPED = "SELECT hostname, metric, CASE seq % 5 WHEN 0 THEN 'hwthread' WHEN 1 THEN 'core' WHEN 2 THEN 'socket' ELSE 'node' END AS scope, scope_id, seq FROM samples WHERE NOT (metric = 'mem_bw' AND seq % 5 = 1)"


@query("x7_scoped_stats_table", "SELECT hostname, metric, scope, scope_id, seq FROM scoped WHERE scope = CASE metric WHEN 'mem_bw' THEN 'socket' ELSE 'core' END", {"scoped": SCOPED})
def x7(spark, d):
    k = F.col("seq") % 5
    rows = view(spark, d, "samples").withColumn("scope", F.when(k == 0, "hwthread").when(k == 1, "core").when(k == 2, "socket").otherwise("node"))
    rows = rows.where(~((F.col("metric") == "mem_bw") & (k == 1))).select("hostname", "metric", "scope", "scope_id", "seq")
    return X.scoped_stats_table(rows)


query("x8_job_ids", "SELECT id FROM jobs WHERE job_state <> 'running' ORDER BY id LIMIT 100 OFFSET 40")(lambda spark, d: X.job_ids(view(spark, d, "jobs"), 100, 40))


@query("x9_node_health", f"""SELECT hostname, node_state, health_state, CASE WHEN id % 2 = 0 THEN ['mem_bw'] ELSE CAST([] AS VARCHAR[]) END AS missing, CASE WHEN id % 2 = 0 THEN [node_state] ELSE CAST([] AS VARCHAR[]) END AS degraded FROM {LATEST} WHERE contains(hostname, '2') AND health_state = 'partial'""")
def x9(spark, d):
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"missing": ["mem_bw"], "degraded": ["'), "node_state", F.lit('"]}')))
    return N.node_health_table(N.latest_node_state(view(spark, d, "node_states")).withColumn("health_metrics", text), "2", "partial")


REPEATED = {"repeated": "SELECT o_orderkey AS id, o_custkey AS job_id, concat('c', o_custkey % 3) AS cluster, EPOCH(o_orderdate) AS start_time FROM orders"}


def repeated_jobs(spark, d):
    return view(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("cluster"), F.expr(EPOCH_SQL.format("o_orderdate")).alias("start_time")
    )


query("w3_find_job", "SELECT id, start_time FROM repeated WHERE job_id = 100 AND cluster = 'c1' ORDER BY id DESC LIMIT 1", REPEATED)(lambda spark, d: X.find_job(repeated_jobs(spark, d), 100, "c1").select("id", "start_time"))
query("w3_newest_jobs", "SELECT max(id) AS id, job_id, cluster FROM repeated GROUP BY job_id, cluster", REPEATED)(lambda spark, d: X.newest_jobs(repeated_jobs(spark, d)).select("id", "job_id", "cluster"))
GUARD = 100 * 86400


@query("w5_start_guard", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time, id) AS k FROM repeated),
 g AS (SELECT id, job_id, k, true AS accepted, start_time AS last FROM n WHERE k = 1 UNION ALL SELECT n.id, n.job_id, n.k, n.start_time - g.last >= {GUARD}, CASE WHEN n.start_time - g.last >= {GUARD} THEN n.start_time ELSE g.last END FROM g JOIN n ON n.job_id = g.job_id AND n.k = g.k + 1)
 SELECT id, accepted FROM g""", REPEATED)
def w5(spark, d):
    return X.duplicate_start_guard(repeated_jobs(spark, d), GUARD).select("id", "accepted")


@query("u1_job_series", """SELECT id, 'live' AS origin, l_quantity AS value FROM (SELECT l_orderkey AS id, l_quantity FROM lineitem) JOIN jobs USING (id) WHERE job_state = 'running' OR id % 7 = 0
 UNION ALL SELECT id, 'archive', l_discount FROM (SELECT l_orderkey AS id, l_discount FROM lineitem) JOIN jobs USING (id) WHERE NOT (job_state = 'running' OR id % 7 = 0)""")
def u1(spark, d):
    jobs = view(spark, d, "jobs").withColumn("monitoring_status", F.when(F.col("id") % 7 == 0, "archiving").otherwise("success"))
    items = view(spark, d, "lineitem")
    live = items.select(F.col("l_orderkey").alias("id"), F.lit("live").alias("origin"), F.col("l_quantity").alias("value"))
    return J.job_series(jobs, live, items.select(F.col("l_orderkey").alias("id"), F.lit("archive").alias("origin"), F.col("l_discount").alias("value")))


@query("t14_join_health", f"SELECT hostname, node_state, CASE WHEN node_state = 'down' THEN 'full' ELSE coalesce(h, 'failed') END AS health_state FROM {LATEST} LEFT JOIN (SELECT hostname, min(health_state) AS h FROM node_states WHERE node_id % 3 <> 0 GROUP BY hostname) USING (hostname)")
def t14(spark, d):
    states = view(spark, d, "node_states")
    health = states.where("node_id % 3 <> 0").groupBy("hostname").agg(F.min("health_state").alias("health_state"))
    return N.join_health(N.latest_node_state(states).select("hostname", "node_state"), health)


# Scalar functions.
@query("c3_expand_node_list", """SELECT p_partkey, concat('w', lpad(CAST(k AS VARCHAR), 3, '0')) AS host FROM part, unnest(range(p_partkey % 50, p_partkey % 50 + p_size % 4 + 1)) AS t(k) UNION ALL SELECT p_partkey, 'login' || p_size FROM part UNION ALL SELECT p_partkey, 'w' || p_size FROM part""")
def c3(spark, d):
    low, high = F.col("p_partkey") % 50, F.col("p_partkey") % 50 + F.col("p_size") % 4
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    text = F.concat(F.lit("w["), pad(low), F.lit("-"), pad(high), F.lit(","), F.col("p_size").cast("string"), F.lit("],login"), F.col("p_size").cast("string"))
    return view(spark, d, "part").select("p_partkey", F.explode(S.expand_node_list(text)).alias("host"))


@query("c4_normalize_unit", """SELECT p_partkey, CASE WHEN v > 1e9 THEN 1e-9 WHEN v > 1e6 THEN 1e-6 WHEN v > 1e3 THEN 1e-3 WHEN v < 1 AND v > 0 THEN 1e3 ELSE 1.0D END::DOUBLE AS factor, CASE WHEN v > 1e9 THEN 'P' WHEN v > 1e6 THEN 'T' WHEN v > 1e3 THEN 'G' WHEN v < 1 AND v > 0 THEN 'K' ELSE 'M' END AS prefix
 FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice * 1000000 WHEN 1 THEN p_retailprice * 1000 WHEN 2 THEN p_retailprice WHEN 3 THEN p_retailprice / 100000 ELSE 0.0 END AS v FROM part)""")
def c4(spark, d):
    k, price = F.col("p_partkey") % 5, F.col("p_retailprice")
    value = F.when(k == 0, price * 1000000).when(k == 1, price * 1000).when(k == 2, price).when(k == 3, price / 100000).otherwise(0.0)
    factor, prefix = S.normalize_unit(F.col("v"), F.lit("M"))
    return view(spark, d, "part").select("p_partkey", value.alias("v")).select("p_partkey", factor.alias("factor"), prefix.alias("prefix"))


query("c5_convert_prefix", "SELECT p_partkey, CAST(p_size AS DOUBLE) * (CASE p_partkey % 3 WHEN 0 THEN 1000.0D WHEN 1 THEN 1.0D ELSE 0.001D END) AS value FROM part", )(
    lambda spark, d: view(spark, d, "part").select("p_partkey", S.convert_prefix(F.col("p_size").cast("double"), F.element_at(F.array(F.lit("T"), F.lit("G"), F.lit("M")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit("G")).alias("value"))
)


@query("c9_split_footprint", "SELECT id, 'flops_any' AS metric, 'avg' AS stat, flops_any_avg AS value FROM jobs WHERE flops_any_avg IS NOT NULL UNION ALL SELECT id, 'mem_bw', 'avg', mem_bw_avg FROM jobs WHERE mem_bw_avg IS NOT NULL UNION ALL SELECT id, 'mem_used', 'max', mem_used_max FROM jobs WHERE mem_used_max IS NOT NULL")
def c9(spark, d):
    from halyard.operators.energy import split_footprint

    return split_footprint(full_jobs(spark, d))


@query("c8_footprint", "SELECT l_orderkey AS id, CAST(floor(avg(CAST(l_quantity AS BIGINT))) AS DOUBLE) AS flops_any_avg, 0.0D AS mem_bw_avg, max(l_quantity) AS mem_used_max FROM lineitem GROUP BY l_orderkey")
def c8(spark, d):
    from halyard.operators.energy import footprint

    stats = view(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.floor(F.avg(F.col("l_quantity").cast("long"))).cast("double").alias("avg"), F.max("l_quantity").alias("max"))
    metric = F.explode(F.array(F.lit("flops_any"), F.lit("mem_used"), F.lit("unknown")))
    rows = stats.withColumn("metric", metric).withColumn("min", F.lit(0.0))
    out = footprint(rows, view(spark, d, "metric_config").where("metric <> 'cpu_load'"))
    return out.select("id", *[F.col("footprint")[k].alias(k) for k in ("flops_any_avg", "mem_bw_avg", "mem_used_max")])


R2 = "floor({} * 100.0D + 0.5D) / 100.0D"


@query("c10_energy", f"SELECT id, {R2.format('mem_bw_avg * num_nodes * (CAST(duration AS DOUBLE) / 3600) / 1000')} AS cpu_power, {R2.format(R2.format('mem_bw_avg * num_nodes * (CAST(duration AS DOUBLE) / 3600) / 1000'))} AS energy FROM jobs WHERE mem_bw_avg IS NOT NULL")
def c10(spark, d):
    from halyard.operators.energy import energy

    stats = view(spark, d, "jobs").where("mem_bw_avg IS NOT NULL").select("id", F.lit("cpu_power").alias("metric"), F.col("mem_bw_avg").alias("avg"))
    out = energy(view(spark, d, "jobs"), stats, view(spark, d, "metric_config"))
    return out.select("id", F.col("energy_footprint")["cpu_power"].alias("cpu_power"), "energy")


query("c11_energy_hardware", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'cpu|Cpu|CPU') THEN 'CPU' WHEN regexp_matches(p_name, 'acc|Acc|ACC') THEN 'Accelerator' WHEN regexp_matches(p_name, 'mem|Mem|MEM') THEN 'Memory' WHEN regexp_matches(p_name, 'core|Core|CORE') THEN 'Core' ELSE 'Other' END AS hardware FROM (SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 0 THEN 'cpu_' WHEN 1 THEN 'Acc' WHEN 2 THEN 'MEM' WHEN 3 THEN 'core' WHEN 4 THEN 'cORE' ELSE '' END, p_brand) AS p_name FROM part)")(
    lambda spark, d: view(spark, d, "part").select("p_partkey", S.energy_hardware(F.concat(F.element_at(F.array(*map(F.lit, ("cpu_", "Acc", "MEM", "core", "cORE", ""))), (F.col("p_partkey") % 6 + 1).cast("int")), "p_brand")).alias("hardware"))
)
query("c12_carbon", "SELECT id, floor(CAST(duration AS DOUBLE) * 400.0D / 10 + 0.5D) / 100 AS kg FROM jobs")(lambda spark, d: view(spark, d, "jobs").select("id", S.carbon_mass(F.col("duration").cast("double"), 400).alias("kg")))
query("c13_quality", """SELECT seq, CAST(CASE WHEN lower_is_better THEN CASE WHEN v <= peak AND v >= alert THEN 3 WHEN v < alert AND v >= caution THEN 2 WHEN v < caution AND v >= 0 THEN 1 ELSE -1 END
 ELSE CASE WHEN v <= alert AND v >= 0 THEN 3 WHEN v <= caution AND v > alert THEN 2 WHEN v <= normal AND v > caution THEN 1 WHEN v <= peak AND v > normal THEN 0 ELSE -1 END END AS INTEGER) AS impact FROM (SELECT *, value / 20 AS v FROM samples) JOIN metric_config USING (metric)""")(
    lambda spark, d: J.with_thresholds(view(spark, d, "samples").withColumn("v", F.col("value") / 20), view(spark, d, "metric_config")).select("seq", S.footprint_quality(*[F.col(c) for c in ("v", "peak", "normal", "caution", "alert", "lower_is_better")]).alias("impact"))
)
query("c14_scaled_threshold", "SELECT id, CASE WHEN shared = 'none' THEN 500.0D ELSE floor(500.0D * num_hwthreads / 144 + 0.5D) END AS peak FROM jobs")(
    lambda spark, d: view(spark, d, "jobs").select("id", S.scaled_threshold(F.lit(500.0), F.col("shared"), F.lit("max"), F.col("num_hwthreads"), F.lit(144)).alias("peak"))
)
for _name in ("c15_scheduler_state", "c15_scheduler_state_all"):  # two names of one query
    query(_name, """SELECT node_id, CASE WHEN s && ['allocated'] THEN 'allocated' WHEN s && ['reserved'] THEN 'reserved' WHEN s && ['idle'] AND s && ['down'] THEN 'down' WHEN s && ['idle'] THEN 'idle' WHEN s && ['down'] THEN 'down' WHEN s && ['mixed'] THEN 'mixed' ELSE 'unknown' END AS state
 FROM (SELECT node_id, list(DISTINCT lower(node_state)) AS s FROM node_states GROUP BY node_id)""")(lambda spark, d: N.scheduler_states(view(spark, d, "node_states")))
query("c16_peak_fraction", "SELECT seq, coalesce(least(1.0D, value / 100 / peak), 0.0D) AS part FROM samples LEFT JOIN (SELECT * FROM metric_config WHERE metric <> 'mem_bw') USING (metric)")(
    lambda spark, d: view(spark, d, "samples").join(view(spark, d, "metric_config").where("metric <> 'mem_bw'"), "metric", "left").select("seq", S.peak_fraction(F.col("value") / 100, F.col("peak")).alias("part"))
)
query("c19_intensity", "SELECT id, flops_any_avg / nullif(mem_bw_avg, 0) AS x, least(1.0D, CAST(duration AS DOUBLE) / 86400) AS shade FROM jobs WHERE flops_any_avg / nullif(mem_bw_avg, 0) IS NOT NULL")(
    lambda spark, d: view(spark, d, "jobs").select("id", S.arithmetic_intensity(F.col("flops_any_avg"), F.col("mem_bw_avg")).alias("x"), F.least(F.lit(1.0), F.col("duration") / 86400).alias("shade")).where("x IS NOT NULL")
)
query("c20_scale_by", "SELECT seq, value * 2.5D AS scaled, value AS kept FROM samples")(lambda spark, d: view(spark, d, "samples").select("seq", S.scale_by(F.col("value"), 2.5).alias("scaled"), S.scale_by(F.col("value"), 0).alias("kept")))


@query("c21_sanitize", "SELECT id, CASE WHEN flops_any_avg IS NULL OR duration % 3 = 0 THEN 0.0D ELSE flops_any_avg END AS avg, CASE WHEN flops_any_avg IS NULL OR duration % 3 = 0 THEN 0.0D ELSE CAST(num_nodes AS DOUBLE) END AS lo, CASE WHEN flops_any_avg IS NULL OR duration % 3 = 0 THEN 0.0D ELSE mem_used_max END AS hi FROM jobs")
def c21(spark, d):
    low = F.when(F.col("duration") % 3 != 0, F.col("num_nodes").cast("double"))
    return view(spark, d, "jobs").select("id", *[c.alias(n) for c, n in zip(S.sanitize_stats(F.col("flops_any_avg"), low, F.col("mem_used_max")), ("avg", "lo", "hi"))])


@query("c23_legacy_footprint", "SELECT id, CAST(num_nodes AS DOUBLE) AS load_avg, CASE WHEN num_acc <> 0 THEN CAST(num_acc AS DOUBLE) END AS net_bw_avg FROM jobs")
def c23(spark, d):
    made = S.legacy_footprint({"load_avg": (F.col("num_nodes"), False), "net_bw_avg": (F.col("num_acc"), True)})
    return view(spark, d, "jobs").select("id", made.alias("m")).select("id", F.col("m")["load_avg"].alias("load_avg"), F.col("m")["net_bw_avg"].alias("net_bw_avg"))


@query("io12_split_component", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'socket' WHEN 1 THEN 'memoryDomain' WHEN 2 THEN 'hwthread' WHEN 3 THEN 'accelerator' WHEN 4 THEN 'core' ELSE 'node' END AS scope, CASE event_id % 6 WHEN 4 THEN '1x' WHEN 5 THEN '' ELSE CAST(user_id AS VARCHAR) END AS scope_id FROM events""")
def io12(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("socket", "memoryDomain", "cpu", "accelerator", "core1x", "node"))), (F.col("event_id") % 6 + 1).cast("int"))
    text = F.concat(name, F.when(F.col("event_id") % 6 >= 4, "").otherwise(F.col("user_id").cast("string")))
    scope, number = S.split_component(text)
    return view(spark, d, "events").select("event_id", scope.alias("scope"), number.alias("scope_id"))
