"""Joins of jobs with tags, hosts, samples, users and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from halyard.functions.scalars import expand_node_list
from halyard.operators.config import host_keys, with_config
from halyard.operators.filters import User, readable_tags
from halyard.operators.overlap import ASKS, MANY, RUNS, TOLD, inside, overlapping
from halyard.operators.packed import dealt
from halyard.scratch import scratch_path

#: A job of at most so many hosts names those before it on each of its rows.
FEW_HOSTS = 64


def job_tag_list(jobs: DataFrame, job_tags: DataFrame, tags: DataFrame, user: User | None = None) -> DataFrame:
    """(id, tag_id, tag_type, tag_name): the tags of jobs, for a user those that
    they may read."""
    tags = tags if user is None else readable_tags(tags, user)
    links = job_tags.select(F.col("job_id").alias("id"), "tag_id")
    return jobs.select("id").join(links, "id").join(tags, "tag_id").select("id", "tag_id", "tag_type", "tag_name")


def anti_tagged(jobs: DataFrame, job_tags: DataFrame, tags: DataFrame, mode: str) -> DataFrame:
    """``all``: jobs without tags; ``user``: without tags that people set;
    ``none``: all jobs."""
    if mode == "none":
        return jobs
    links = job_tags
    if mode == "user":
        links = links.join(tags.where(~F.col("tag_type").isin("app", "jobClass")).select("tag_id"), "tag_id", "left_semi")
    elif mode != "all":
        raise ValueError(f"unknown mode {mode}")
    return jobs.join(links.select(F.col("job_id").alias("id")), "id", "left_anti")


def concurrent_jobs(jobs: DataFrame, hosts: DataFrame, now: int, buffer: int = 200, min_duration: int = 600) -> DataFrame:
    """(id, other): jobs of one cluster that shared a host with a shared job.

    Finished others must overlap the job by more than the buffer on both sides;
    running ones must have started early enough; a running job lasts up to now.
    ``hosts`` may name a host of a job more than once.

    Rows of a job and host move once, by host, and are sorted by start; one pass then
    forms the pairs (``overlap.py``). A pair is given at its first common host, so pairs
    are not shuffled to make them distinct: a row carries the hosts of its job that come
    before its own. Jobs of more than ``FEW_HOSTS`` hosts carry none; their pairs alone
    are made distinct.
    """
    spark = jobs.sparkSession
    running = F.coalesce(F.col("job_state") == "running", F.lit(False))
    end = F.when(running, F.lit(now)).otherwise(F.col("start_time") + F.col("duration"))
    spans = jobs.select("id", "cluster", "shared", "job_state", running.alias("runs"), F.col("start_time").cast("long").alias("s"), end.cast("long").alias("e"))
    asks = F.coalesce((F.col("shared") != "none") & (F.col("e") - F.col("s") > min_duration), F.lit(False))
    role = asks.cast("int") * ASKS + F.col("job_state").isNotNull().cast("int") * TOLD + F.col("runs").cast("int") * RUNS
    spans = spans.where("cluster IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL").select("id", "cluster", "s", "e", role.alias("role")).where(F.col("role").bitwiseAND(ASKS | TOLD) > 0)
    listed = hosts.groupBy("id").agg(F.array_sort(F.collect_set("hostname")).alias("all"))
    held = scratch_path(spark, "placed")  # a row a job, read by the queries below
    placed = spans.join(listed, "id")
    placed.write.parquet(held)
    placed = spark.read.schema(placed.schema).parquet(held)
    many = F.size("all") > FEW_HOSTS
    rows = placed.select("cluster", "id", "s", "e", (F.col("role") + many.cast("int") * MANY).cast("byte").alias("role"), "all", F.posexplode("all").alias("at", "hostname"))
    before = F.when(F.col("role").bitwiseAND(MANY) == 0, F.slice("all", F.lit(1), F.col("at")))
    rows = rows.select("cluster", "hostname", "id", "s", "e", "role", before.alias("before"))
    rows = dealt(rows, "cluster", "hostname").sortWithinPartitions("cluster", "hostname", "s")
    kind = jobs.schema["id"].dataType.simpleString()

    def met(crowd: bool) -> DataFrame:
        return rows.mapInArrow(lambda batches: overlapping(batches, buffer, crowd), f"id {kind}, other {kind}")

    if placed.where(many).isEmpty():
        return met(False)
    return met(False).unionByName(met(True).distinct())


def samples_for_jobs(samples: DataFrame, jobs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Samples of a job's hosts in [start, start + duration), with the job's id.

    By (cluster, host); jobs without a cluster, as those of one cluster alone, meet hosts
    by name. Jobs and samples of a host are dealt to one task, jobs first, each once; of the
    samples, sorted by time, those of a job are a range (``overlap.py``).
    """
    spans = jobs.select("id", *[c for c in ("cluster",) if c in jobs.columns], "start_time", "duration").join(hosts, "id").where("duration > 0")
    at = host_keys(samples, spans)
    more = [c for c in spans.columns if c not in (*at, *samples.columns, "start_time", "duration")]
    own = [c for c in samples.columns if c not in at]
    none = lambda frame, names: [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in names]
    end = (F.col("start_time") + F.col("duration")).cast("long").alias("_end")
    begun = spans.select(*at, F.col("start_time").cast("long").alias("_time"), end, *more, *none(samples, own))
    taken = samples.select(*at, F.floor("ts").cast("long").alias("_time"), F.lit(None).cast("long").alias("_end"), *none(spans, more), *own)
    rows = dealt(begun.unionByName(taken).dropna(subset=[*at, "_time"]), *at).sortWithinPartitions(*at, F.col("_end").isNull(), "_time")
    fields = [*(samples.schema[c] for c in (*at, *own)), *(spans.schema[c] for c in more)]
    return rows.mapInArrow(lambda batches: inside(batches, tuple(at), tuple(more), tuple(own)), StructType([StructField(f.name, f.dataType) for f in fields]))


def nodes_not_in_db(configured: DataFrame, nodes: DataFrame, part: str = "") -> DataFrame:
    """Configured hosts without a node row, sorted; by cluster where both name it."""
    at = host_keys(configured, nodes)
    out = configured.select(*at).distinct().join(nodes.select(*at), at, "left_anti")
    return (out.where(F.col("hostname").contains(part)) if part else out).orderBy(*reversed(at))


def assign_subcluster(jobs: DataFrame, node_lists: DataFrame) -> DataFrame:
    """Adds ``assigned``: a valid own subcluster, else the one that lists the first
    host, else the cluster's catch-all (list ``*``), else null. ``node_lists``:
    cluster, subcluster, nodes; ``jobs`` has first_host."""
    valid = node_lists.select("cluster", "subcluster").distinct().withColumn("_own", F.col("subcluster"))
    listed = node_lists.where("nodes <> '*'").withColumn("first_host", F.explode(expand_node_list(F.col("nodes"))))
    listed = listed.groupBy("cluster", "first_host").agg(F.min("subcluster").alias("_by_host"))
    rest = node_lists.where("nodes = '*'").groupBy("cluster").agg(F.min("subcluster").alias("_rest"))
    out = jobs.join(valid, ["cluster", "subcluster"], "left").join(listed, ["cluster", "first_host"], "left").join(rest, "cluster", "left")
    return out.withColumn("assigned", F.coalesce("_own", "_by_host", "_rest")).drop("_own", "_by_host", "_rest")


def with_thresholds(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Attaches a metric's configuration, on the row's subcluster where it is kept by
    that; metrics without one, or removed there, are dropped."""
    return with_config(rows, config)


def node_roofline_info(node_metrics: DataFrame, states: DataFrame, jobs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host: metrics, scheduler state or ``notindb``, running jobs on it."""
    busy = jobs.where("job_state = 'running'").select("id").join(hosts, "id").groupBy("hostname").agg(F.count(F.lit(1)).alias("n"))
    out = node_metrics.join(states.select("hostname", "node_state"), "hostname", "left").join(busy, "hostname", "left")
    return out.withColumn("node_state", F.coalesce("node_state", F.lit("notindb"))).withColumn("jobs", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def job_series(jobs: DataFrame, live: DataFrame, archived: DataFrame) -> DataFrame:
    """Series of running or still archiving jobs from the live samples, of all
    others from the archive. ``live`` and ``archived`` have an id column. A partition's
    job ids are hashed, so that no series is sorted, however many samples it has."""
    fresh = jobs.where("job_state = 'running' OR monitoring_status = 'archiving'").select("id")
    done = jobs.where("NOT (job_state = 'running' OR monitoring_status = 'archiving')").select("id")
    return live.join(fresh.hint("shuffle_hash"), "id", "left_semi").unionByName(archived.join(done.hint("shuffle_hash"), "id", "left_semi"))
