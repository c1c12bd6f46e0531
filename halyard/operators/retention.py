"""Retention, archive and lifecycle rewrites of job, node and sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.joins import anti_tagged
from halyard.operators.nodes import expired_node_states


def jobs_between(jobs: DataFrame, begin: int, end: int, job_tags: DataFrame, tags: DataFrame, omit: str = "none") -> DataFrame:
    """Finished choice by start: before ``end`` (begin 0), or in [begin, end]; tagged
    ones left out by ``omit``; in the order of the archive."""
    if begin and begin >= end:
        raise ValueError("the range is empty")
    out = jobs.where(F.col("start_time").between(begin, end)) if begin else jobs.where(F.col("start_time") < end)
    return anti_tagged(out, job_tags, tags, omit).orderBy("cluster", "subcluster", "project", "start_time", "id")


def retain_delete(jobs: DataFrame, before: int, job_tags: DataFrame, tags: DataFrame, omit: str = "none") -> tuple[DataFrame, DataFrame]:
    """(jobs, links) that remain when old jobs go with their tag links."""
    gone = anti_tagged(jobs.where(F.col("start_time") < before), job_tags, tags, omit).select("id")
    return jobs.join(gone, "id", "left_anti"), job_tags.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def retain_copy(jobs: DataFrame, marker: int, cutoff: int, job_tags: DataFrame, tags: DataFrame, omit: str = "none") -> tuple[DataFrame, int]:
    """(jobs since the marker up to the cutoff, new marker). A run that is repeated
    with the old marker gives the same rows."""
    rows = jobs_between(jobs, marker + 1 if marker else 0, cutoff, job_tags, tags, omit) if cutoff > marker + 1 else jobs.where(F.lit(False))
    return rows, max(marker, cutoff)


def retain_move(jobs: DataFrame, before: int, job_tags: DataFrame, tags: DataFrame, omit: str = "none") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moved jobs, remaining jobs, remaining links)."""
    moved = jobs_between(jobs, 0, before, job_tags, tags, omit)
    return (moved, *retain_delete(jobs, before, job_tags, tags, omit))


def retain_node_states(states: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """(expired rows, for deletion or export, remaining rows)."""
    expired = expired_node_states(states, cutoff)
    return expired, states.join(expired.select("id"), "id", "left_anti")


def retain_samples(samples: DataFrame, cutoff: int, used: DataFrame) -> DataFrame:
    """Without series whose last sample is before the cutoff, but for hosts in
    use (``used``: cluster, hosts)."""
    keys = ["cluster", "hostname", "scope", "scope_id", "metric"]
    stale = samples.groupBy(*keys).agg(F.max("ts").alias("last")).where(F.col("last") < cutoff)
    busy = used.select("cluster", F.explode("hosts").alias("hostname"))
    return samples.join(stale.join(busy, ["cluster", "hostname"], "left_anti").select(*keys), keys, "left_anti")


def archive_clean(jobs: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Without jobs that start before ``before`` or after ``after`` (0: open)."""
    out = jobs.where(F.col("start_time") >= before)
    return out.where(F.col("start_time") <= after) if after else out


def apply_metadata_updates(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates``: id, key, value, seq; of equal keys the last wins."""
    last = updates.groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"))
    maps = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    out = jobs.join(maps, "id", "left")
    empty = F.create_map().cast("map<string,string>")
    old = F.coalesce(F.col("meta_data"), empty)
    new = F.coalesce("_new", empty)
    return out.withColumn("meta_data", F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)).drop("_new")


def import_jobs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Jobs of the source that the target has not, by (job_id, cluster, start_time)."""
    return source.join(target, ["job_id", "cluster", "start_time"], "left_anti").select(source.columns)


def stop_exceeded(jobs: DataFrame, now: int, slack: int) -> DataFrame:
    """Running jobs past their wall time by more than the slack become failed."""
    over = (F.col("job_state") == "running") & (F.col("walltime") > 0) & (F.col("start_time") < now - slack - F.col("walltime"))
    return jobs.withColumn("_over", over).withColumn("job_state", F.when(F.col("_over"), "failed").otherwise(F.col("job_state"))).withColumn(
        "duration", F.when(F.col("_over"), 0).otherwise(F.col("duration")).cast("long")
    ).withColumn("monitoring_status", F.when(F.col("_over"), "failed").otherwise(F.col("monitoring_status"))).drop("_over")


def sync_jobs(staged: DataFrame, jobs: DataFrame) -> DataFrame:
    """Staged jobs that are new by (job_id, cluster, start_time)."""
    keys = ["job_id", "cluster", "start_time"]
    return staged.dropDuplicates(keys).join(jobs, keys, "left_anti").select(staged.columns)


def refresh_footprints(jobs: DataFrame, node_stats: DataFrame, config: DataFrame, now: int, min_duration: int) -> DataFrame:
    """(id, footprint) of running jobs longer than a minimum, by the configuration of
    their cluster and subcluster where it is kept by them."""
    from halyard.operators.config import config_keys
    from halyard.operators.energy import footprint
    from halyard.operators.timeseries import job_stats

    live = jobs.where((F.col("job_state") == "running") & (F.lit(now) - F.col("start_time") > min_duration))
    metrics = [r.metric for r in config.where("footprint <> ''").select("metric").distinct().collect()]  # configuration
    stats = job_stats(node_stats.join(live.select("id"), "id", "left_semi"), live, metrics)
    return footprint(stats.join(live.select("id", *config_keys(live, config)), "id"), config)


def finalize_jobs(stopped: DataFrame, series: DataFrame, config: DataFrame) -> DataFrame:
    """Archive rows of stopped jobs: footprint, energy, and success, or failed
    for jobs without series. ``series``: id, metric, avg, min, max at node scope."""
    from halyard.operators.config import config_keys
    from halyard.operators.energy import energy, footprint
    from halyard.operators.timeseries import archive_job_stats

    stats = archive_job_stats(series.join(stopped.select("id"), "id", "left_semi"), stopped)
    stats = stats.join(stopped.select("id", *config_keys(stopped, config)), "id")
    out = stopped.join(footprint(stats, config), "id", "left").join(energy(stopped, stats, config), "id", "left")
    return out.withColumn("monitoring_status", F.when(F.col("footprint").isNull(), "failed").otherwise("success"))
