"""Nodes and their state log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.scalars import scheduler_state
from halyard.operators.config import host_keys


def latest_node_state(states: DataFrame) -> DataFrame:
    """Newest row a node; of equal times the larger id."""
    order = Window.partitionBy("node_id").orderBy(F.col("time_stamp").desc(), F.col("id").desc())
    return states.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def expired_node_states(states: DataFrame, cutoff: int) -> DataFrame:
    """Rows before the cutoff, but for those of a node's newest time (ties kept)."""
    newest = F.max("time_stamp").over(Window.partitionBy("node_id"))
    return states.withColumn("_newest", newest).where((F.col("time_stamp") < cutoff) & (F.col("time_stamp") < F.col("_newest"))).drop("_newest")


def nodes_with_state(nodes: DataFrame, states: DataFrame) -> DataFrame:
    return nodes.join(latest_node_state(states), "node_id")


def allocated_nodes(jobs: DataFrame, hosts: DataFrame, cluster: str) -> DataFrame:
    """Running jobs' hosts a subcluster: distinct ones, and with repetition."""
    running = jobs.where((F.col("job_state") == "running") & (F.col("cluster") == cluster)).select("id", "subcluster")
    return running.join(hosts, "id").groupBy("subcluster").agg(F.countDistinct("hostname").alias("nodes"), F.count(F.lit(1)).alias("allocations"))


def used_nodes(jobs: DataFrame, hosts: DataFrame, ts: int) -> DataFrame:
    """(cluster, hosts): sorted distinct hosts of jobs that run since before ts."""
    running = jobs.where((F.col("job_state") == "running") & (F.col("start_time") < ts)).select("id", "cluster")
    return running.join(hosts, "id").groupBy("cluster").agg(F.array_sort(F.collect_set("hostname")).alias("hosts"))


def count_states(latest: DataFrame) -> DataFrame:
    """(state, n) by scheduler and by health state, in one pass."""
    both = latest.select(F.explode(F.array(F.struct(F.lit("node").alias("kind"), F.col("node_state").alias("state")), F.struct(F.lit("health").alias("kind"), F.col("health_state").alias("state")))).alias("s"))
    return both.groupBy("s.kind", "s.state").agg(F.count(F.lit(1)).alias("n"))


def state_timeline(states: DataFrame, column: str) -> DataFrame:
    """(state, times, counts) as parallel arrays in time order."""
    counted = states.groupBy(F.col(column).alias("state"), "time_stamp").agg(F.count(F.lit(1)).alias("n"))
    lists = counted.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("time_stamp", "n"))).alias("p"))
    return lists.select("state", F.col("p.time_stamp").alias("times"), F.col("p.n").alias("counts"))


def stacked_timeline(states: DataFrame, column: str, step: int = 1) -> DataFrame:
    """Counts of states on all their times, missing ones 0, and the running sum
    over states by name. ``step`` rounds times down."""
    at = (F.floor(F.col("time_stamp") / step) * step).cast("long")
    counted = states.groupBy(F.col(column).alias("state"), at.alias("time_stamp")).agg(F.count(F.lit(1)).alias("n"))
    kinds = counted.select("state").distinct()  # a handful of states
    grid = counted.select("time_stamp").distinct().crossJoin(F.broadcast(kinds))
    dense = grid.join(counted, ["time_stamp", "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    below = Window.partitionBy("time_stamp").orderBy("state").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("stacked", F.sum("n").over(below))


def scheduler_states(states: DataFrame) -> DataFrame:
    """(node_id, state): one state a node by priority, out of all it was in."""
    sets = states.groupBy("node_id").agg(F.collect_set(F.upper("node_state")).alias("s"))
    return sets.select("node_id", scheduler_state(F.col("s")).alias("state"))


def node_jobs_summary(jobs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Sorted distinct users and projects of each host's jobs."""
    placed = jobs.select("id", "hpc_user", "project").join(hosts, "id")
    return placed.groupBy("hostname").agg(F.array_sort(F.collect_set("hpc_user")).alias("users"), F.array_sort(F.collect_set("project")).alias("projects"))


def node_health_table(latest: DataFrame, part: str = "", health: str | None = None) -> DataFrame:
    """Latest states with the metric lists of their JSON; by health, then host."""
    lists = F.from_json("health_metrics", "missing array<string>, degraded array<string>")
    out = latest.withColumn("_m", lists)
    if part:
        out = out.where(F.col("hostname").contains(part))
    if health:
        out = out.where(F.col("health_state") == health)
    none = F.array().cast("array<string>")
    return out.select(
        "hostname", "node_state", "health_state", F.coalesce("_m.missing", none).alias("missing"), F.coalesce("_m.degraded", none).alias("degraded")
    ).orderBy("health_state", "hostname")


def join_health(updates: DataFrame, health: DataFrame) -> DataFrame:
    """Health of node updates: full for down nodes, else as checked, else failed."""
    at = host_keys(updates, health)
    out = updates.join(health.select(*at, F.col("health_state").alias("_h")), at, "left")
    return out.withColumn("health_state", F.when(F.col("node_state") == "down", "full").otherwise(F.coalesce("_h", F.lit("failed")))).drop("_h")
