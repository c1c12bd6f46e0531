"""Job statistics, counts, histograms, footprints and rooflines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.scalars import effective_duration

#: Histogram presets: bins and seconds a bin (fixed values).
DURATION_PRESETS = {"1m": (60, 60), "10m": (72, 600), "1h": (48, 3600), "6h": (12, 21600), "12h": (14, 43200)}
DEFAULT_PRESET = (24, 3600)
MEASURES = (
    "total_jobs", "total_users", "total_walltime", "total_nodes", "total_node_hours", "total_cores", "total_core_hours",
    "total_accs", "total_acc_hours", "running_jobs", "short_jobs",
)


def _measures(now: int, short: int) -> dict[str, Column]:
    took = effective_duration(now)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    hours = lambda c: F.floor(total(c) / 3600).cast("long")
    return {
        "total_jobs": F.count(F.lit(1)),
        "total_users": F.countDistinct("hpc_user"),
        "total_walltime": hours(took),
        "total_nodes": total(F.col("num_nodes")),
        "total_node_hours": hours(took * F.col("num_nodes")),
        "total_cores": total(F.col("num_hwthreads")),
        "total_core_hours": hours(took * F.col("num_hwthreads")),
        "total_accs": total(F.col("num_acc")),
        "total_acc_hours": hours(took * F.col("num_acc")),
        "running_jobs": F.count_if(F.col("job_state") == "running"),
        "short_jobs": F.count_if(F.col("duration") < short),
    }


def _chosen(measures, now: int, short: int) -> list[Column]:
    known = _measures(now, short)
    return [known[m].cast("long").alias(m) for m in (measures or MEASURES)]


def jobs_stats(jobs: DataFrame, now: int, short: int = 300, measures: tuple[str, ...] | None = None) -> DataFrame:
    """One row; only the asked measures are computed. Hours are truncated."""
    return jobs.agg(*_chosen(measures, now, short))


def jobs_stats_grouped(
    jobs: DataFrame, by: str, now: int, short: int = 300, sort_by: str | None = None, measures: tuple[str, ...] | None = None
) -> DataFrame:
    """The same by user, project, cluster or subcluster; no group without a value."""
    out = jobs.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("name")).agg(*_chosen(measures, now, short))
    return out.orderBy(F.col(sort_by).desc(), "name") if sort_by else out


def with_user_names(stats: DataFrame, users: DataFrame, column: str = "name") -> DataFrame:
    """Adds the display name of user groups, empty where unknown."""
    known = users.select(F.col("username").alias("_u"), F.col("name").alias("display_name"))
    out = stats.join(known, stats[column] == F.col("_u"), "left").drop("_u")
    return out.withColumn("display_name", F.coalesce("display_name", F.lit("")))


def count_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.countDistinct("id").alias("jobs"))


def job_count(jobs: DataFrame, by: str | None = None, kind: str = "all", short: int = 300) -> DataFrame:
    test = {"all": F.lit(True), "running": F.col("job_state") == "running", "short": F.col("duration") < short}[kind]
    kept = jobs.where(test)
    return kept.groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("jobs")) if by else kept.agg(F.count(F.lit(1)).alias("jobs"))


def hist_value(jobs: DataFrame, column: str) -> DataFrame:
    return jobs.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("jobs"))


def _dense(df: DataFrame, bins: int) -> DataFrame:
    """Bins 1..n, with the counts that there are."""
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(df), "bin", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)).cast("long"))


def hist_duration(jobs: DataFrame, preset: str, now: int) -> DataFrame:
    """Dense bins of effective duration, given by their upper end; longer jobs are left out."""
    bins, size = DURATION_PRESETS.get(preset, DEFAULT_PRESET)
    at = (F.floor(effective_duration(now) / size) + 1).cast("long")
    counted = jobs.select(at.alias("bin")).where(F.col("bin").between(1, bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("jobs"))
    return _dense(counted, bins).select((F.col("bin") * size).alias("value"), "jobs")


def hist_metric(jobs: DataFrame, key: str, bins: int, peak: float) -> DataFrame:
    """Finished jobs by a footprint value up to the peak, in dense bins."""
    value = F.col("footprint")[key]
    at = F.floor(F.when(value == peak, value * 0.999999999).otherwise(value) / peak * bins).cast("long") + 1
    kept = jobs.where((F.col("job_state") != "running") & value.isNotNull() & (value <= peak))
    counted = kept.select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("jobs"))
    width = int(peak) // bins
    return _dense(counted, bins).select("bin", ((F.col("bin") - 1) * width).alias("low"), (F.col("bin") * width).alias("high"), "jobs")


def hist_metric_running(averages: DataFrame, value: str, bins: int, peak: float) -> DataFrame:
    """Running jobs' averages, cut to whole numbers, in bins of whole width."""
    width = max(1, int(peak) // bins)
    at = F.floor(F.floor(F.col(value)) / width).cast("long") + 1
    counted = averages.where(F.col(value).isNotNull()).select(at.alias("bin")).where(F.col("bin").between(1, bins))
    counted = counted.groupBy("bin").agg(F.count(F.lit(1)).alias("jobs"))
    return _dense(counted, bins).select("bin", ((F.col("bin") - 1) * width).alias("low"), (F.col("bin") * width).alias("high"), "jobs")


def job_averages(jobs: DataFrame, node_averages: DataFrame, metrics: list[str]) -> DataFrame:
    """id and one column a metric: archived average, or for running jobs the sum
    of their nodes' averages (``node_averages``: id, metric, avg); else null."""
    sums = node_averages.where(F.col("metric").isin(*metrics)).groupBy("id", "metric").agg(F.sum("avg").alias("v"))
    live = sums.groupBy("id").pivot("metric", metrics).agg(F.first("v"))
    live = live.select("id", *[F.col(m).alias(f"_{m}") for m in metrics])
    running = F.col("job_state") == "running"
    stored = {m: F.col("footprint")[f"{m}_avg"] for m in metrics}
    return jobs.join(live, "id", "left").select("id", "job_state", *[F.when(running, F.col(f"_{m}")).otherwise(stored[m]).alias(m) for m in metrics])


def jobs_footprints(jobs: DataFrame, metrics: list[str]) -> DataFrame:
    """Averages and weights in hours' place: duration / 60 times the count, 1 for none."""
    per = F.col("duration") / 60
    weight = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(per * F.col(c))
    return jobs.select(
        "id", *[F.col("footprint")[f"{m}_avg"].alias(m) for m in metrics], (per * F.col("num_nodes")).alias("node_weight"),
        weight("num_hwthreads").alias("core_weight"), weight("num_acc").alias("acc_weight"),
    )


def weighted_histogram(values: DataFrame, value: str, weight: str, bins: int) -> DataFrame:
    """Sums of weights over at least three equal bins between min(0, least) and
    the greatest value plus one; labels are the bins' floored upper ends."""
    bins = max(3, bins)
    bound = values.agg(F.least(F.lit(0.0), F.min(value)).alias("lo"), (F.greatest(F.lit(0.0), F.max(value)) + 1).alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("long")
    summed = (
        values.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bound)).groupBy(at.alias("bin")).agg(F.sum(weight).alias("weight"))
    )  # the bounds are one row
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(bound))
    label = F.floor(F.col("lo") + (F.col("bin") + 1) / F.lit(bins) * (F.col("hi") - F.col("lo"))).cast("long")
    return every.join(F.broadcast(summed), "bin", "left").select("bin", label.alias("label"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def roofline_heatmap(
    cells: DataFrame, rows: int, cols: int, min_x: float, max_x: float, min_y: float, max_y: float,
    keys: tuple[str, ...] = ("hostname", "cell"), flops: str = "flops_any", bandwidth: str = "mem_bw",
) -> DataFrame:
    """Dense (row, col, count) of log10 intensity by log10 performance. ``cells``
    holds one value a (keys, metric)."""
    both = (
        cells.where(F.col("metric").isin(flops, bandwidth)).groupBy(*keys)
        .agg(F.max(F.when(F.col("metric") == flops, F.col("value"))).alias("f"), F.max(F.when(F.col("metric") == bandwidth, F.col("value"))).alias("b"))
    )
    both = both.where((F.col("f") > 0) & (F.col("b") > 0)).select(F.log10(F.col("f") / F.col("b")).alias("x"), F.log10("f").alias("y"))
    kept = both.where((F.col("x") >= min_x) & (F.col("x") < max_x) & (F.col("y") >= min_y) & (F.col("y") <= max_y))
    tile = lambda v, lo, hi, n: F.least(F.floor((F.col(v) - lo) / (hi - lo) * n), F.lit(n - 1)).cast("long")
    counted = kept.groupBy(tile("y", min_y, max_y, rows).alias("row"), tile("x", min_x, max_x, cols).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    return grid.join(F.broadcast(counted), ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


def tag_counts(tags: DataFrame, job_tags: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Jobs for each (type, name), zero counts too. ``jobs`` limits which count."""
    links = job_tags if jobs is None else job_tags.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    counted = links.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    out = tags.join(counted, "tag_id", "left")
    return out.groupBy("tag_type", "tag_name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("jobs"))


def archive_info(jobs: DataFrame) -> DataFrame:
    """Per cluster, and null for all: jobs, first and last start, bytes."""
    return jobs.rollup("cluster").agg(
        F.count(F.lit(1)).alias("jobs"), F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"), F.sum("bytes").alias("bytes")
    )


def cluster_usage_summary(jobs: DataFrame, hosts: DataFrame, sizes: DataFrame, now: int) -> DataFrame:
    """Per subcluster: allocated and idle nodes, cores and accelerators, users,
    running jobs. ``sizes``: subcluster, nodes, cores, accs."""
    running = jobs.where(F.col("job_state") == "running")
    used = running.join(hosts, "id").groupBy("subcluster").agg(F.countDistinct("hostname").alias("allocated_nodes"))
    sums = running.groupBy("subcluster").agg(
        F.count(F.lit(1)).alias("running_jobs"), F.countDistinct("hpc_user").alias("active_users"),
        F.sum("num_hwthreads").alias("allocated_cores"), F.sum("num_acc").alias("allocated_accs"),
        F.floor(F.sum("flops_any_avg")).alias("flops"), F.floor(F.sum("mem_bw_avg")).alias("mem_bw"),
    )
    out = sizes.join(used, "subcluster", "left").join(sums, "subcluster", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    idle = lambda total, taken: F.greatest(F.lit(0), F.col(total) - zero(taken)).cast("long")
    taken = ("allocated_nodes", "allocated_cores", "allocated_accs", "running_jobs", "active_users", "flops", "mem_bw")
    return out.select(
        "subcluster", *[zero(c).alias(c) for c in taken], idle("nodes", "allocated_nodes").alias("idle_nodes"),
        idle("cores", "allocated_cores").alias("idle_cores"), idle("accs", "allocated_accs").alias("idle_accs"),
    )
