"""Registered queries: filters, joins, statistics and lists of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.fixtures import NOW, SHORT, full_jobs, view
from halyard.functions import scalars as S
from halyard.operators import filters as P
from halyard.operators import stats as A
from halyard.operators.filters import JobFilter, Range, StringFilter, TimeRange, User
from halyard.plans.registry import query

KEEP = ["id", "hpc_user", "project", "cluster", "job_state", "start_time", "duration", "num_nodes"]
COLS = ", ".join(KEEP)
START = 800000000


def _filter(name, wanted: JobFilter, where: str, hosts: bool = False, tags: bool = False):
    def run(spark, d):
        jobs = full_jobs(spark, d, resources=hosts)
        return P.filter_jobs(jobs, wanted, view(spark, d, "job_tags") if tags else None, NOW).select(*KEEP)

    query(name, f"SELECT {COLS} FROM jobs WHERE {where}")(run)


_filter(
    "f1_filter_jobs",
    JobFilter(cluster=StringFilter(eq="c1"), state=("completed", "failed"), start_time=TimeRange(START, 980000000), duration=Range(3600, 0), project=StringFilter(contains="build")),
    f"cluster = 'c1' AND job_state IN ('completed', 'failed') AND start_time BETWEEN {START} AND 980000000 AND duration >= 3600 AND project ILIKE '%build%'",
)
_filter("f2_string_eq", JobFilter(user=StringFilter(eq="u7", neq="u7")), "hpc_user = 'u7'")
_filter("f2_string_neq", JobFilter(project=StringFilter(neq="machinery")), "project <> 'machinery'")
_filter("f2_string_starts", JobFilter(user=StringFilter(starts_with="U1")), "hpc_user ILIKE 'U1%'")
_filter("f2_string_ends", JobFilter(subcluster=StringFilter(ends_with="N_7")), "subcluster ILIKE '%N_7'")
_filter("f2_string_contains", JobFilter(partition=StringFilter(contains="h_g")), "cluster_partition ILIKE '%h_g%'")
_filter("f2_string_in", JobFilter(project=StringFilter(is_in=("building", "machinery"))), "project IN ('building', 'machinery')")
_filter("f3_ranges", JobFilter(duration=Range(1000, 90000), num_nodes=Range(0, 3), num_hwthreads=Range(72, 0), num_acc=Range(0, 0)), "duration BETWEEN 1000 AND 90000 AND num_nodes <= 3 AND num_hwthreads >= 72")
_filter("f5_time_range", JobFilter(start_time=TimeRange(START, 900000000)), f"start_time BETWEEN {START} AND 900000000")
_filter("f5_time_open", JobFilter(start_time=TimeRange(end=900000000)), "start_time <= 900000000")
_filter("f5_time_unknown_name", JobFilter(start_time=TimeRange(named="lastyear")), "true")
_filter("f6_state_shared", JobFilter(state=("running",), shared="multi_user"), "job_state = 'running' AND shared = 'multi_user'")
_filter("f6_db_ids", JobFilter(db_id=(1, 2, 3, 5, 8, 13, 999)), "id IN (1, 2, 3, 5, 8, 13, 999)")
_filter("f8_footprint_range", JobFilter(metric_stats={"flops_any_avg": Range(20000, 60000), "mem_bw_avg": Range(10, 0)}), "flops_any_avg BETWEEN 20000 AND 60000 AND mem_bw_avg >= 10")
_filter("f8_footprint_bad_name", JobFilter(metric_stats={"flops-any": Range(1, 2)}), "false")
_filter("f9_job_name", JobFilter(job_name=StringFilter(contains="URGENT")), "job_name ILIKE '%URGENT%'")
_filter("f10_host_eq", JobFilter(node=StringFilter(eq="n7")), "id IN (SELECT id FROM job_hosts WHERE hostname = 'n7')", hosts=True)
_filter("f10_host_starts", JobFilter(node=StringFilter(starts_with="n9")), "id IN (SELECT id FROM job_hosts WHERE hostname ILIKE 'n9%')", hosts=True)
_filter("f10_host_neq", JobFilter(node=StringFilter(neq="n7")), "id IN (SELECT id FROM job_hosts WHERE hostname <> 'n7')", hosts=True)
_filter("f11_tags", JobFilter(tags=("Brand#11", "Brand#23")), "id IN (SELECT job_id FROM job_tags WHERE tag_id IN ('Brand#11', 'Brand#23'))", tags=True)
_filter("f12_interactive", JobFilter(schedule="interactive"), "job_name = 'interactive'")
_filter("f12_batch", JobFilter(schedule="batch"), "job_name <> 'interactive'")


def _secure(name, user, where):
    query(name, f"SELECT {COLS} FROM jobs WHERE {where}")(lambda spark, d: P.secure_jobs(view(spark, d, "jobs"), user).select(*KEEP))


_secure("f13_secure_user", User("u3", frozenset({"user"})), "hpc_user = 'u3'")
_secure("f13_secure_manager", User("u3", frozenset({"manager"}), ("building", "household")), "project IN ('building', 'household') OR hpc_user = 'u3'")
_secure("f13_secure_admin", User("root", frozenset({"admin"})), "true")


@query("f15_filter_nodes", "SELECT id, hostname, time_stamp FROM node_states WHERE cluster = 'c1' AND hostname ILIKE '%1%' AND node_state = 'idle' AND health_state = 'partial' AND time_stamp > 1704500000")
def f15(spark, d):
    states = P.filter_nodes(view(spark, d, "node_states"), cluster=StringFilter(eq="c1"), hostname=StringFilter(contains="1"), node_state="idle", health_state="partial", time_start=1704500000)
    return states.select("id", "hostname", "time_stamp")


def _search(name, term, sql):
    query(name, sql)(lambda spark, d: P.search_term(view(spark, d, "jobs"), view(spark, d, "users"), term))


_search("f16_search_project", "building", "SELECT CASE WHEN (SELECT count(*) FROM jobs WHERE hpc_user = 'building') > 0 THEN 'user' WHEN (SELECT count(*) FROM users WHERE name ILIKE '%building%') > 0 THEN 'name' WHEN (SELECT count(*) FROM jobs WHERE project = 'building') > 0 THEN 'project' ELSE 'job_name' END AS kind, 'building' AS value")
_search("f16_search_name", "User 14", "SELECT 'name' AS kind, min(username) AS value FROM users WHERE name ILIKE '%User 14%'")
query("f17_find_values", "SELECT DISTINCT project AS value FROM jobs WHERE project ILIKE '%u%'")(lambda spark, d: P.find_values(view(spark, d, "jobs"), "project", "u"))
query("f17_partitions", "SELECT DISTINCT cluster_partition AS value FROM jobs WHERE cluster = 'c2'")(lambda spark, d: P.find_values(view(spark, d, "jobs").where("cluster = 'c2'"), "cluster_partition"))


@query("f18_project_metrics", """SELECT seq, metric, scope FROM (SELECT *, max(CASE WHEN scope IN ('core') THEN 1 ELSE 0 END) OVER (PARTITION BY hostname, metric) AS hit
 FROM (SELECT seq, hostname, metric, CASE WHEN seq % 3 = 0 THEN 'core' ELSE scope END AS scope FROM samples WHERE metric IN ('flops_any', 'mem_bw'))) WHERE hit = 0 OR scope = 'core'""")
def f18(spark, d):
    rows = view(spark, d, "samples").withColumn("scope", F.when(F.col("seq") % 3 == 0, "core").otherwise(F.col("scope")))
    return P.project_metrics(rows, ["flops_any", "mem_bw"], ["core"], keys=("hostname",)).select("seq", "metric", "scope")


TOOK = f"(CASE WHEN job_state = 'running' THEN {NOW} - start_time ELSE duration END)"
STATS = f"""count(*) AS total_jobs, count(DISTINCT hpc_user) AS total_users, CAST(coalesce(sum({TOOK}), 0) // 3600 AS BIGINT) AS total_walltime,
 CAST(coalesce(sum(num_nodes), 0) AS BIGINT) AS total_nodes, CAST(coalesce(sum({TOOK} * num_nodes), 0) // 3600 AS BIGINT) AS total_node_hours,
 CAST(coalesce(sum(num_hwthreads), 0) AS BIGINT) AS total_cores, CAST(coalesce(sum({TOOK} * num_hwthreads), 0) // 3600 AS BIGINT) AS total_core_hours,
 CAST(coalesce(sum(num_acc), 0) AS BIGINT) AS total_accs, CAST(coalesce(sum({TOOK} * num_acc), 0) // 3600 AS BIGINT) AS total_acc_hours,
 CAST(count(*) FILTER (job_state = 'running') AS BIGINT) AS running_jobs, CAST(count(*) FILTER (duration < {SHORT}) AS BIGINT) AS short_jobs"""

query("a1_jobs_stats", f"SELECT {STATS} FROM jobs")(lambda spark, d: A.jobs_stats(view(spark, d, "jobs"), NOW, SHORT))
query("a1_jobs_stats_some", "SELECT count(*) AS total_jobs, CAST(sum(num_nodes) AS BIGINT) AS total_nodes FROM jobs WHERE cluster = 'c3'")(
    lambda spark, d: A.jobs_stats(view(spark, d, "jobs").where("cluster = 'c3'"), NOW, SHORT, ("total_jobs", "total_nodes"))
)
for _by in ("hpc_user", "project", "cluster", "subcluster"):
    query(f"a2_stats_by_{_by}", f"SELECT {_by} AS name, {STATS} FROM jobs WHERE {_by} IS NOT NULL GROUP BY {_by}")(
        lambda spark, d, by=_by: A.jobs_stats_grouped(view(spark, d, "jobs"), by, NOW, SHORT)
    )
query("a3_count_jobs", "SELECT count(DISTINCT id) AS jobs FROM jobs JOIN job_tags ON job_tags.job_id = id")(
    lambda spark, d: A.count_jobs(view(spark, d, "jobs").drop("job_id").join(view(spark, d, "job_tags"), F.col("id") == F.col("job_id")))
)
query("a4_job_count_by_cluster", "SELECT cluster AS name, count(*) AS jobs FROM jobs GROUP BY cluster")(lambda spark, d: A.job_count(view(spark, d, "jobs"), "cluster"))
query("a4_job_count_running", "SELECT subcluster AS name, count(*) AS jobs FROM jobs WHERE job_state = 'running' GROUP BY subcluster")(lambda spark, d: A.job_count(view(spark, d, "jobs"), "subcluster", "running"))
query("a4_job_count_short", f"SELECT count(*) AS jobs FROM jobs WHERE duration < {SHORT}")(lambda spark, d: A.job_count(view(spark, d, "jobs"), None, "short", SHORT))
for _col in ("num_nodes", "num_hwthreads", "num_acc"):
    query(f"a7_hist_{_col}", f"SELECT {_col} AS value, count(*) AS jobs FROM jobs GROUP BY {_col}")(lambda spark, d, col=_col: A.hist_value(view(spark, d, "jobs"), col))
for _preset, (_bins, _size) in {**A.DURATION_PRESETS, "other": A.DEFAULT_PRESET}.items():
    query(
        f"a8_hist_duration_{_preset}",
        f"SELECT CAST(b.b * {_size} AS BIGINT) AS value, count(j.id) AS jobs FROM range(1, {_bins + 1}) b(b) LEFT JOIN (SELECT * FROM jobs) j ON {TOOK.replace('job_state', 'j.job_state')} // {_size} + 1 = b.b GROUP BY b.b",
    )(lambda spark, d, preset=_preset: A.hist_duration(view(spark, d, "jobs"), preset, NOW))
for _key, _peak in (("flops_any_avg", 70000.0), ("mem_bw_avg", 50.0), ("mem_used_max", 50.0)):
    _w = int(_peak) // 10
    query(
        f"a10_hist_metric_{_key}",
        f"""SELECT CAST(b.b AS BIGINT) AS bin, CAST((b.b - 1) * {_w} AS BIGINT) AS low, CAST(b.b * {_w} AS BIGINT) AS high, count(v.v) AS jobs FROM range(1, 11) b(b)
 LEFT JOIN (SELECT CASE WHEN {_key} = {_peak} THEN CAST({_key} AS DOUBLE) * CAST(0.999999999 AS DOUBLE) ELSE {_key} END AS v FROM jobs WHERE job_state <> 'running' AND {_key} <= {_peak}) v
 ON floor(v.v / CAST({_peak} AS DOUBLE) * 10) + 1 = b.b GROUP BY b.b""",
    )(lambda spark, d, key=_key, peak=_peak: A.hist_metric(full_jobs(spark, d), key, 10, peak))
query(
    "a11_hist_metric_running",
    """SELECT CAST(b.b AS BIGINT) AS bin, CAST((b.b - 1) * 7000 AS BIGINT) AS low, CAST(b.b * 7000 AS BIGINT) AS high, count(j.id) AS jobs FROM range(1, 11) b(b)
 LEFT JOIN (SELECT * FROM jobs WHERE job_state = 'running') j ON floor(floor(flops_any_avg) / 7000) + 1 = b.b GROUP BY b.b""",
)(lambda spark, d: A.hist_metric_running(view(spark, d, "jobs").where("job_state = 'running'"), "flops_any_avg", 10, 70000.0))
query("a9_tag_counts", "SELECT tag_type, tag_name, count(job_id) AS jobs FROM tags LEFT JOIN job_tags USING (tag_id) GROUP BY tag_type, tag_name")(
    lambda spark, d: A.tag_counts(view(spark, d, "tags"), view(spark, d, "job_tags"))
)


@query("a9_tag_counts_user", """SELECT tag_type, tag_name, count(v.job_id) AS jobs FROM (SELECT * FROM tags WHERE tag_scope IN ('global', 'u1')) t
 LEFT JOIN (SELECT jt.* FROM job_tags jt JOIN jobs j ON j.id = jt.job_id WHERE j.hpc_user = 'u1') v USING (tag_id) GROUP BY tag_type, tag_name""")
def a9_user(spark, d):
    user = User("u1", frozenset({"user"}))
    return A.tag_counts(P.readable_tags(view(spark, d, "tags"), user), view(spark, d, "job_tags"), P.secure_jobs(view(spark, d, "jobs"), user))


NODE_AVG = "(SELECT id, 'flops_any' AS metric, CAST(floor(l_extendedprice) AS DOUBLE) AS avg FROM (SELECT l_orderkey AS id, l_extendedprice FROM lineitem) UNION ALL SELECT l_orderkey AS id, 'mem_bw' AS metric, l_quantity AS avg FROM lineitem)"


def node_averages(spark, d):
    items = view(spark, d, "lineitem")
    price = items.select(F.col("l_orderkey").alias("id"), F.lit("flops_any").alias("metric"), F.floor("l_extendedprice").cast("double").alias("avg"))
    return price.unionByName(items.select(F.col("l_orderkey").alias("id"), F.lit("mem_bw").alias("metric"), F.col("l_quantity").alias("avg")))


@query("a12_job_averages", f"""SELECT j.id, j.job_state, CASE WHEN job_state = 'running' THEN f.v ELSE flops_any_avg END AS flops_any, CASE WHEN job_state = 'running' THEN b.v ELSE mem_bw_avg END AS mem_bw
 FROM jobs j LEFT JOIN (SELECT id, sum(avg) AS v FROM {NODE_AVG} WHERE metric = 'flops_any' GROUP BY id) f ON f.id = j.id LEFT JOIN (SELECT id, sum(avg) AS v FROM {NODE_AVG} WHERE metric = 'mem_bw' GROUP BY id) b ON b.id = j.id""")
def a12(spark, d):
    return A.job_averages(full_jobs(spark, d), node_averages(spark, d), ["flops_any", "mem_bw"])


@query("a13_footprints", """SELECT id, flops_any_avg AS flops_any, mem_bw_avg AS mem_bw, CAST(duration AS DOUBLE) / 60 * num_nodes AS node_weight,
 CASE WHEN num_hwthreads = 0 THEN 1.0D ELSE CAST(duration AS DOUBLE) / 60 * num_hwthreads END AS core_weight, CASE WHEN num_acc = 0 THEN 1.0D ELSE CAST(duration AS DOUBLE) / 60 * num_acc END AS acc_weight FROM jobs""")
def a13(spark, d):
    return A.jobs_footprints(full_jobs(spark, d), ["flops_any", "mem_bw"])


@query("a14_weighted_histogram", """WITH s AS (SELECT mem_bw_avg AS v, CAST(duration AS DOUBLE) AS w FROM jobs), b AS (SELECT least(0.0D, min(v)) AS lo, greatest(0.0D, max(v)) + 1 AS hi FROM s)
 SELECT CAST(r.r AS BIGINT) AS bin, CAST(floor(lo + CAST(r.r + 1 AS DOUBLE) / 12 * (hi - lo)) AS BIGINT) AS label, coalesce(w, 0.0D) AS weight FROM range(12) r(r) CROSS JOIN b
 LEFT JOIN (SELECT floor((v - lo) / (hi - lo) * 12) AS bin, sum(w) AS w FROM s CROSS JOIN b WHERE v IS NOT NULL GROUP BY 1) x ON x.bin = r.r""")
def a14(spark, d):
    jobs = view(spark, d, "jobs").withColumn("w", F.col("duration").cast("double"))
    return A.weighted_histogram(jobs, "mem_bw_avg", "w", 12)


@query("a27_archive_info", "SELECT cluster, count(*) AS jobs, min(start_time) AS first_start, max(start_time) AS last_start, CAST(sum(num_nodes * 100) AS BIGINT) AS bytes FROM jobs GROUP BY ROLLUP (cluster)")
def a27(spark, d):
    return A.archive_info(view(spark, d, "jobs").withColumn("bytes", F.col("num_nodes") * 100))


@query("a26_cluster_usage", """WITH z AS (SELECT lower(n_name) AS subcluster, 60 + n_nationkey AS nodes, 100000 AS cores, 2000 AS accs FROM nation), r AS (SELECT * FROM jobs WHERE job_state = 'running'),
 u AS (SELECT subcluster, count(DISTINCT hostname) AS an FROM r JOIN job_hosts USING (id) GROUP BY subcluster),
 s AS (SELECT subcluster, count(*) AS rj, count(DISTINCT hpc_user) AS au, sum(num_hwthreads) AS ac, sum(num_acc) AS aa, floor(sum(flops_any_avg)) AS fl, floor(sum(mem_bw_avg)) AS mb FROM r GROUP BY subcluster)
 SELECT subcluster, CAST(coalesce(an, 0) AS BIGINT) AS allocated_nodes, CAST(coalesce(ac, 0) AS BIGINT) AS allocated_cores, CAST(coalesce(aa, 0) AS BIGINT) AS allocated_accs, CAST(coalesce(rj, 0) AS BIGINT) AS running_jobs,
 CAST(coalesce(au, 0) AS BIGINT) AS active_users, CAST(coalesce(fl, 0) AS BIGINT) AS flops, CAST(coalesce(mb, 0) AS BIGINT) AS mem_bw, CAST(greatest(0, nodes - coalesce(an, 0)) AS BIGINT) AS idle_nodes,
 CAST(greatest(0, cores - coalesce(ac, 0)) AS BIGINT) AS idle_cores, CAST(greatest(0, accs - coalesce(aa, 0)) AS BIGINT) AS idle_accs FROM z LEFT JOIN u USING (subcluster) LEFT JOIN s USING (subcluster)""")
def a26(spark, d):
    nation = view(spark, d, "nation")
    sizes = nation.select(F.lower("n_name").alias("subcluster"), (F.lit(60) + F.col("n_nationkey")).alias("nodes"), F.lit(100000).alias("cores"), F.lit(2000).alias("accs"))
    return A.cluster_usage_summary(view(spark, d, "jobs"), view(spark, d, "job_hosts"), sizes, NOW)


query("c1_effective_duration", f"SELECT id, {TOOK} AS seconds FROM jobs")(lambda spark, d: view(spark, d, "jobs").select("id", S.effective_duration(NOW).alias("seconds")))
