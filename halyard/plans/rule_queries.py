"""Registered queries: rules, validation, retention, line protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.fixtures import NOW, full_jobs, view
from halyard.operators import nodes as N
from halyard.operators import retention as E
from halyard.operators import rules as R
from halyard.plans.node_queries import LATEST
from halyard.plans.registry import query
from halyard.sources import line_protocol as L

APPS = {"thx": ["ththe", "the [a-z]+ing"], "lic": ["license"], "mail": ["@mail[0-9]"]}
APP_SQL = " UNION ALL ".join(
    f"SELECT id, '{app}' AS app FROM job_scripts WHERE " + " OR ".join(f"regexp_matches(lower(job_script), '(?m)^[^#\\n]*{p}')" for p in pats) for app, pats in APPS.items()
)
query("r1_detect_app", APP_SQL)(lambda spark, d: R.detect_app(view(spark, d, "job_scripts"), APPS))

RULES = [
    R.Rule(
        "Low load", "lowload", ("flops_any",), "flops_any.avg < load_threshold", ('job.shared == "none"', "job.duration > min_duration"), (("load_threshold", "flops_any.limits.peak * low_factor"),),
        "average {{.flops_any.avg}} is below {{.load_threshold}} ({{.low_factor}})",
    ),
    R.Rule("Bandwidth bound", "membound", ("mem_bw", "flops_any"), "mem_bw.avg >= mem_bw.limits.peak * bw_factor && !(flops_any.avg > 60000.0)", ("job.num_nodes > 0",), (), "bandwidth {{.mem_bw.avg}}"),
]
PARAMS = {"low_factor": 0.4, "min_duration": 600.0, "bw_factor": 0.6}


def rule_jobs(spark, d):
    """Jobs with maps of statistics and limits."""
    stat = lambda c: F.struct(F.col(c).alias("avg"), F.lit(0.0).alias("min"), F.col(c).alias("max"))
    limit = lambda peak: F.struct(F.lit(peak).alias("peak"))
    stats = F.create_map(F.lit("flops_any"), stat("flops_any_avg"), F.lit("mem_bw"), stat("mem_bw_avg"))
    limits = F.create_map(F.lit("flops_any"), limit(70000.0), F.lit("mem_bw"), limit(50.0))
    return view(spark, d, "jobs").withColumn("stats", F.when(F.col("flops_any_avg").isNotNull(), stats)).withColumn("limits", limits)


LOW = "shared = 'none' AND duration > 600 AND flops_any_avg < 70000.0D * 0.4D"
BOUND = "num_nodes > 0 AND mem_bw_avg >= 50.0D * 0.6D AND NOT (flops_any_avg > 60000.0)"
query("r2_classify_jobs", f"""SELECT id, list_filter([CASE WHEN {LOW} THEN 'lowload' END, CASE WHEN {BOUND} THEN 'membound' END], lambda x: x IS NOT NULL) AS tags,
 concat_ws(chr(10), CASE WHEN {LOW} THEN concat('average ', flops_any_avg, ' is below 28000.0 (0.4)') END, CASE WHEN {BOUND} THEN concat('bandwidth ', mem_bw_avg) END) AS message FROM jobs WHERE flops_any_avg IS NOT NULL AND (({LOW}) OR ({BOUND}))""")(
    lambda spark, d: R.classify_jobs(rule_jobs(spark, d), RULES, PARAMS)
)


@query("r5_rerun_taggers", f"""SELECT a.id, 'app' AS tag_type, app AS tag_name FROM ({APP_SQL}) a JOIN jobs USING (id) WHERE job_state <> 'running' UNION ALL SELECT id, 'jobClass', 'lowload' FROM jobs WHERE job_state <> 'running' AND {LOW}
 UNION ALL SELECT id, 'jobClass', 'membound' FROM jobs WHERE job_state <> 'running' AND {BOUND}""")
def r5(spark, d):
    jobs = rule_jobs(spark, d).join(view(spark, d, "job_scripts").select("id", "job_script"), "id", "left")
    return R.rerun_taggers(jobs, APPS, RULES, PARAMS)


@query("r3_tag_changes", """WITH k AS (SELECT * FROM tags WHERE tag_name <> 'brand#11'), n AS (SELECT tag_id, tag_type, tag_name FROM k UNION ALL SELECT 'user:fresh', 'user', 'fresh'),
 l AS (SELECT job_id, tag_id FROM job_tags UNION SELECT id, 'user:fresh' FROM jobs WHERE id % 9 = 0) SELECT l.job_id, l.tag_id, n.tag_name FROM l JOIN n USING (tag_id) WHERE NOT (n.tag_name = 'brand#22' AND l.job_id % 2 = 0)""")
def r3(spark, d):
    jobs, tags = view(spark, d, "jobs"), view(spark, d, "tags")
    none = F.lit(None).cast("string")
    adds = jobs.where("id % 9 = 0").select("id", F.lit("user").alias("tag_type"), F.lit("fresh").alias("tag_name"), none.alias("tag_scope"))
    even = jobs.where("id % 2 = 0").select(F.col("id")).crossJoin(F.broadcast(tags.where("tag_name = 'brand#22'").select("tag_type", "tag_name")))  # one tag
    whole = tags.where("tag_name = 'brand#11'").select(F.lit(None).cast("long").alias("id"), "tag_type", "tag_name")
    kept, links = R.apply_tag_changes(tags, view(spark, d, "job_tags"), adds, even.unionByName(whole))
    return links.join(kept.select("tag_id", "tag_name"), "tag_id").select("job_id", "tag_id", "tag_name")


def checked(spark, d):
    jobs = full_jobs(spark, d, resources=True)
    jobs = jobs.withColumn("assigned", F.when(F.col("subcluster") != "china", F.col("subcluster"))).withColumn("hpc_user", F.when(F.col("id") % 11 != 0, F.col("hpc_user")))
    return R.sanity_check(jobs, ["c0", "c1", "c2", "c3"])


REASONS = """list_filter([CASE WHEN cluster = 'c4' THEN 'unknown cluster' END, CASE WHEN subcluster = 'china' THEN 'no subcluster' END, CASE WHEN id % 11 = 0 THEN 'no user' END, CASE WHEN num_nodes = 0 THEN 'no resources' END, CASE WHEN num_nodes < 1 THEN 'no nodes' END], lambda x: x IS NOT NULL)"""
query("v1_rejects", f"SELECT id, {REASONS} AS reasons FROM jobs WHERE len({REASONS}) > 0")(lambda spark, d: R.split_checked(checked(spark, d))[1].select("id", "reasons"))
query("v1_good", f"SELECT id FROM jobs WHERE len({REASONS}) = 0")(lambda spark, d: R.split_checked(checked(spark, d))[0].select("id"))


@query("v2_load_tags", "SELECT tag_type, tag_name, count(*) AS n FROM tags GROUP BY ALL")
def v2(spark, d):
    """Tags linked to jobs, once a (name, type), so n is 1. The archive loader does not run here."""
    rows = view(spark, d, "job_tags").join(view(spark, d, "tags"), "tag_id")
    return rows.select("tag_type", "tag_name").dropDuplicates().groupBy("tag_type", "tag_name").agg(F.count(F.lit(1)).alias("n"))


@query("v3_normalize", """WITH s AS (SELECT id, 'mem_bw' AS metric, 'node' AS scope, mem_bw_avg * 1000000000.0D AS value FROM jobs WHERE mem_bw_avg IS NOT NULL UNION ALL SELECT id, 'cpu_load', 'node', mem_bw_avg * 1000000000.0D FROM jobs WHERE mem_bw_avg IS NOT NULL)
 SELECT id, metric, CASE WHEN metric = 'cpu_load' THEN value WHEN value > 1e9 THEN value * CAST(1e-9 AS DOUBLE) WHEN value > 1e6 THEN value * CAST(1e-6 AS DOUBLE) ELSE value END AS value, CASE WHEN metric = 'cpu_load' THEN '' WHEN value > 1e9 THEN 'G' WHEN value > 1e6 THEN 'M' ELSE '' END AS prefix FROM s""")
def v3(spark, d):
    kinds = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit")) for m, u in (("mem_bw", "B/s"), ("cpu_load", "load"))])
    jobs = view(spark, d, "jobs").where("mem_bw_avg IS NOT NULL").select("id", (F.col("mem_bw_avg") * 1e9).alias("value"))
    both = jobs.select("id", "value", F.lit("node").alias("scope"), F.lit("").alias("prefix"), F.inline(kinds))
    return R.normalize_job_data(both).select("id", "metric", "value", "prefix")


@query("c22_migrate_meta", "SELECT id, CASE id % 3 WHEN 0 THEN 'multi_user' WHEN 1 THEN 'none' ELSE 'single_user' END AS shared, start_time AS submit_time, 0.0D AS energy, CAST(0 AS BIGINT) AS requested_memory FROM jobs")
def c22(spark, d):
    old = view(spark, d, "jobs").select("id", "start_time", (F.col("id") % 3).alias("exclusive"), F.lit(1.0).alias("load_avg"))
    return R.migrate_job_meta(old).drop("start_time")


END = 900000000
TAGGED = "(SELECT job_id FROM job_tags JOIN tags USING (tag_id) WHERE tag_type NOT IN ('app', 'jobClass'))"


def _parts(spark, d):
    return view(spark, d, "jobs"), view(spark, d, "job_tags"), view(spark, d, "tags")


@query("e1_jobs_between", f"SELECT id, start_time FROM jobs WHERE start_time BETWEEN 850000000 AND {END} AND id NOT IN {TAGGED}")
def e1(spark, d):
    jobs, links, tags = _parts(spark, d)
    return E.jobs_between(jobs, 850000000, END, links, tags, "user").select("id", "start_time")


@query("e2_retain_delete", f"SELECT id FROM jobs WHERE NOT (start_time < {END} AND id NOT IN {TAGGED})")
def e2(spark, d):
    jobs, links, tags = _parts(spark, d)
    return E.retain_delete(jobs, END, links, tags, "user")[0].select("id")


@query("e2_retain_delete_links", f"SELECT job_id, tag_id FROM job_tags WHERE job_id NOT IN (SELECT id FROM jobs WHERE start_time < {END} AND id NOT IN {TAGGED})")
def e2_links(spark, d):
    jobs, links, tags = _parts(spark, d)
    return E.retain_delete(jobs, END, links, tags, "user")[1]


@query("e3_retain_copy", f"SELECT id FROM jobs WHERE start_time > 850000000 AND start_time <= {END}")
def e3(spark, d):
    jobs, links, tags = _parts(spark, d)
    return E.retain_copy(jobs, 850000000, END, links, tags)[0].select("id")


@query("e4_retain_move", f"SELECT 'moved' AS part, id FROM jobs WHERE start_time < {END} UNION ALL SELECT 'kept', id FROM jobs WHERE start_time >= {END}")
def e4(spark, d):
    jobs, links, tags = _parts(spark, d)
    moved, kept, _ = E.retain_move(jobs, END, links, tags)
    return moved.select(F.lit("moved").alias("part"), "id").unionByName(kept.select(F.lit("kept").alias("part"), "id"))


@query("e5_retain_node_states", "SELECT id FROM (SELECT *, max(time_stamp) OVER (PARTITION BY node_id) AS m FROM node_states) WHERE NOT (time_stamp < 1705500000 AND time_stamp < m)")
def e5(spark, d):
    return E.retain_node_states(view(spark, d, "node_states"), 1705500000)[1].select("id")


USED = "(SELECT DISTINCT 'c0' AS cluster, hostname FROM jobs JOIN job_hosts USING (id) WHERE job_state = 'running' AND start_time < 800000000)"


@query("e6_retain_samples", f"""SELECT seq FROM samples s JOIN (SELECT hostname, scope_id, metric, max(ts) AS last FROM samples GROUP BY ALL) l USING (hostname, scope_id, metric) WHERE NOT (last < 1705900000 AND hostname NOT IN (SELECT hostname FROM {USED}))""")
def e6(spark, d):
    jobs = view(spark, d, "jobs").withColumn("cluster", F.lit("c0"))
    return E.retain_samples(view(spark, d, "samples"), 1705900000, N.used_nodes(jobs, view(spark, d, "job_hosts"), 800000000)).select("seq")


query("e7_archive_clean", f"SELECT id FROM jobs WHERE start_time >= 850000000 AND start_time <= {END}")(lambda spark, d: E.archive_clean(view(spark, d, "jobs"), 850000000, END).select("id"))


@query("e9_metadata_updates", "SELECT id, CASE WHEN id % 4 = 0 THEN 'renamed' ELSE job_name END AS name, CASE WHEN id % 4 = 0 THEN 'second' END AS message FROM jobs")
def e9(spark, d):
    jobs = full_jobs(spark, d).select("id", "meta_data")
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit(n).alias("seq")) for n, (k, v) in enumerate((("message", "first"), ("jobName", "renamed"), ("message", "second")))])
    updates = jobs.where("id % 4 = 0").select("id", F.explode(rows).alias("u")).select("id", "u.key", "u.value", "u.seq")
    return E.apply_metadata_updates(jobs, updates).select("id", F.col("meta_data")["jobName"].alias("name"), F.col("meta_data")["message"].alias("message"))


@query("io10_import_jobs", "SELECT id, job_id FROM jobs WHERE id % 3 <> 0")
def io10(spark, d):
    jobs = view(spark, d, "jobs")
    return E.import_jobs(jobs, jobs.where("id % 3 = 0")).select("id", "job_id")


@query("s4_sync_jobs", "SELECT id FROM jobs WHERE job_state = 'running' AND id % 5 <> 0")
def s4(spark, d):
    jobs = view(spark, d, "jobs")
    staged = jobs.where("job_state = 'running'")
    return E.sync_jobs(staged.union(staged), jobs.where("id % 5 = 0 OR job_state <> 'running'")).select("id")


@query("s7_stop_exceeded", f"SELECT id, CASE WHEN o THEN 'failed' ELSE job_state END AS job_state, CASE WHEN o THEN 0 ELSE duration END AS duration, CASE WHEN o THEN 'failed' ELSE 'running' END AS monitoring_status FROM (SELECT *, job_state = 'running' AND start_time < 950000000 - 100 - walltime AS o FROM jobs)")
def s7(spark, d):
    jobs = view(spark, d, "jobs").withColumn("monitoring_status", F.lit("running"))
    return E.stop_exceeded(jobs, 950000000, 100).select("id", "job_state", "duration", "monitoring_status")


ITEM = "(SELECT l_orderkey AS id, l_quantity FROM lineitem)"
R100 = "floor(({}) * 100 + 0.5D) / 100"


@query("s8_refresh_footprints", f"""SELECT j.id, {R100.format('coalesce(a / nullif(num_nodes, 0), 0.0D)')} AS flops_any_avg, 0.0D AS cpu_load_avg FROM jobs j LEFT JOIN (SELECT id, sum(l_quantity) AS a FROM {ITEM} GROUP BY id) s USING (id) WHERE job_state = 'running' AND {NOW} - start_time > 600""")
def s8(spark, d):
    stats = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("flops_any").alias("metric"), F.col("l_quantity").alias("avg"), F.lit(0.0).alias("min"), F.col("l_quantity").alias("max"))
    out = E.refresh_footprints(view(spark, d, "jobs"), stats, view(spark, d, "metric_config"), NOW, 600)
    return out.select("id", *[F.col("footprint")[k].alias(k) for k in ("flops_any_avg", "cpu_load_avg")])


P = R100.format("a / nullif(num_nodes, 0)")


@query("s9_finalize_jobs", f"""WITH s AS (SELECT id, sum(l_quantity) AS a FROM {ITEM} GROUP BY id), p AS (SELECT j.id, {P} AS avg, num_nodes, duration FROM jobs j JOIN s USING (id) WHERE job_state <> 'running')
 SELECT j.id, CASE WHEN p.id IS NULL THEN 'failed' ELSE 'success' END AS monitoring_status, {R100.format(R100.format('avg * p.num_nodes * (CAST(p.duration AS DOUBLE) / 3600) / 1000'))} AS energy FROM jobs j LEFT JOIN p ON p.id = j.id WHERE job_state <> 'running'""")
def s9(spark, d):
    jobs = view(spark, d, "jobs").where("job_state <> 'running'")
    series = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("cpu_power").alias("metric"), F.col("l_quantity").alias("avg"), F.lit(0.0).alias("min"), F.lit(1.0).alias("max"))
    return E.finalize_jobs(jobs, series, view(spark, d, "metric_config")).select("id", "monitoring_status", "energy")


@query("io7_line_protocol", """SELECT 'c0' AS cluster, hostname, CASE seq % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'hwthread' ELSE 'socket' END AS scope, CASE seq % 3 WHEN 0 THEN '' ELSE CAST(scope_id AS VARCHAR) END AS scope_id, metric, ts, value FROM samples WHERE seq % 7 <> 0 AND metric <> 'cpu_power'""")
def io7(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("node", "hwthread", "socket"))), (F.col("seq") % 3 + 1).cast("int"))
    rows = view(spark, d, "samples")
    tags = F.concat(F.lit(",hostname="), "hostname", F.when(F.col("seq") % 2 == 0, ",cluster=c0").otherwise(""), F.lit(",type="), kind, F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit(",type-id="), "scope_id")))
    field = F.when(F.col("seq") % 7 == 0, "other=1").otherwise(F.concat(F.lit("value="), F.format_string("%.1f", "value")))
    lines = rows.select(F.concat("metric", tags, F.lit(" "), field, F.lit(" "), "ts").alias("line"))
    return L.parse_line_protocol(lines, "c0", view(spark, d, "metric_config").where("metric <> 'cpu_power'"))


query("x9_latest_states", f"SELECT node_state, count(*) AS n FROM {LATEST} GROUP BY node_state")(
    lambda spark, d: N.latest_node_state(view(spark, d, "node_states")).groupBy("node_state").agg(F.count(F.lit(1)).alias("n"))
)
