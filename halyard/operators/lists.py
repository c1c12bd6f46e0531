"""Ordering, paging and lists."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.operators.scan import Step, along, column

#: Scopes from finest to coarsest, and the order in which a table prefers them.
SCOPES = ("accelerator", "hwthread", "core", "memoryDomain", "socket", "node")
TABLE_PREFERENCE = ("accelerator", "core", "socket", "node")


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1], name).lower()


def order_jobs(jobs: DataFrame, field: str, kind: str = "col", direction: str = "ASC") -> DataFrame:
    """By a column, or by a footprint entry (jobs without a footprint are left
    out); nulls first on ASC; the id settles ties."""
    column = F.col(snake_case(field)) if kind == "col" else F.col("footprint")[field]
    rows = jobs if kind == "col" else jobs.where(F.col("footprint").isNotNull())
    return rows.orderBy(column.asc_nulls_first() if direction == "ASC" else column.desc_nulls_last(), "id")


def page(df: DataFrame, number: int, per_page: int) -> DataFrame:
    """Page 1 is the first; per_page -1 gives all."""
    if per_page == -1:
        return df
    if per_page < 1:
        raise ValueError("a page holds one row or more")
    return df.offset((max(1, number) - 1) * per_page).limit(per_page)


def jobs_list(ordered: DataFrame, number: int, per_page: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with total and has_next)."""
    rows = page(ordered, number, per_page)
    total = ordered.agg(F.count(F.lit(1)).alias("total"))
    last = max(1, number) * per_page if per_page > 0 else 0
    return rows, total.withColumn("has_next", (F.col("total") > last) if per_page > 0 else F.lit(False))


def top_list(stats: DataFrame, measure: str, k: int = 10) -> DataFrame:
    """The k largest groups; names settle ties."""
    return stats.orderBy(F.col(measure).desc(), "name").limit(k)


def jobs_metric_stats(jobs: DataFrame, stats: DataFrame) -> DataFrame:
    """Jobs with their metric statistics, jobs without any left out, by start."""
    per = stats.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("metric", "avg", "min", "max"))).alias("stats"))
    return jobs.join(per, "id").orderBy("start_time", "id")


def scoped_stats_table(stats: DataFrame, keys: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """Rows of each metric's best scope: accelerator, core, socket, node."""
    rank = F.array_position(F.array(*map(F.lit, TABLE_PREFERENCE)), F.col("scope"))
    kept = stats.withColumn("_rank", rank).where("_rank > 0")
    best = F.min("_rank").over(Window.partitionBy("metric"))
    return kept.withColumn("_best", best).where("_rank = _best").drop("_rank", "_best").orderBy("metric", *keys, "scope_id")


def job_ids(jobs: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Ids of jobs that do not run, in order; 0 sets no limit."""
    out = jobs.where("job_state <> 'running'").select("id").orderBy("id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def find_job(jobs: DataFrame, job_id: int, cluster: str | None = None, start_time: int | None = None) -> DataFrame:
    """The newest match."""
    return find_jobs(jobs, job_id, cluster, start_time).orderBy(F.col("id").desc()).limit(1)


def find_jobs(jobs: DataFrame, job_id: int, cluster: str | None = None, start_time: int | None = None) -> DataFrame:
    out = jobs.where(F.col("job_id") == job_id)
    out = out.where(F.col("cluster") == cluster) if cluster else out
    return out.where(F.col("start_time") == start_time) if start_time else out


def newest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest row of every (job_id, cluster)."""
    order = Window.partitionBy("job_id", "cluster").orderBy(F.col("id").desc())
    return jobs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def duplicate_start_guard(starts: DataFrame, window: int = 86400) -> DataFrame:
    """Adds ``accepted``: a start within ``window`` seconds of the last accepted one of
    its (job_id, cluster) is a duplicate; duplicates do not shadow later starts. Starts
    without a time are accepted and shadow nothing. One pass over sorted starts, which
    jumps from one accepted start to the next and holds no key's rows."""

    def guard() -> Step:
        last = None

        def accept(rows: pa.RecordBatch) -> pa.Array:
            nonlocal last
            times = column(rows, "start_time")
            at = times.null_count  # nulls come first
            known = times.slice(at).to_numpy()
            out = np.arange(len(times)) < at
            k = 0 if last is None else int(np.searchsorted(known, last + window))
            while k < len(known):
                out[at + k], last = True, int(known[k])
                k = max(k + 1, int(np.searchsorted(known, last + window)))
            return pa.array(out)

        return accept

    return along(starts, ("job_id", "cluster"), ("start_time", "id"), guard, "accepted", "boolean")


def node_list_page(latest: DataFrame, number: int, per_page: int, part: str = "", configured: DataFrame | None = None) -> DataFrame:
    """Nodes by host name, a page at a time, with the total and a next-page mark.

    While no node has a row, the hosts of the cluster configuration (``configured``:
    hostname) stand in, without states; the part of a name holds for them too."""
    named = lambda df: df.where(F.col("hostname").contains(part)) if part else df
    rows = named(latest)
    if configured is not None:
        known = rows.agg(F.count(F.lit(1)).alias("_n"))
        spare = named(configured.select("hostname").distinct()).crossJoin(F.broadcast(known)).where("_n = 0").drop("_n")
        rows = rows.unionByName(spare, allowMissingColumns=True)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = page(rows.orderBy("hostname"), number, per_page)
    more = (F.col("total") > max(1, number) * per_page) if per_page > 0 else F.lit(False)
    return cut.crossJoin(F.broadcast(total)).withColumn("has_next", more)


def job_detail(jobs: DataFrame, tag_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Jobs with their sorted tags; statistics only where archiving succeeded."""
    tags = tag_rows.groupBy("id").agg(F.array_sort(F.collect_list("tag_name")).alias("tags"))
    out = jobs.join(tags, "id", "left").join(stats, "id", "left")
    done = F.col("monitoring_status") == "success"
    named = [c for c in stats.columns if c != "id"]
    out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.withColumns({c: F.when(done, F.col(c)) for c in named})
