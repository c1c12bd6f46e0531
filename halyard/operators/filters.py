"""Job and node predicates, row-level access, lookups.

Filters are ANDed, and so are the fields of one filter. Predicates are plain
columns, so they reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400
#: Named ranges in seconds before now.
NAMED_RANGES = {"last6h": 6 * HOUR, "last24h": DAY, "last7d": 7 * DAY, "last30d": 30 * DAY}
METRIC_NAME = re.compile(r"[a-zA-Z0-9_]+\Z")


@dataclass(frozen=True)
class StringFilter:
    """The first field given, in this order, decides."""

    eq: str | None = None
    neq: str | None = None
    starts_with: str | None = None
    ends_with: str | None = None
    contains: str | None = None
    is_in: tuple[str, ...] | None = None

    def on(self, column: Column, allow_in: bool = True) -> Column | None:
        if self.eq is not None:
            return column == self.eq
        if self.neq is not None:
            return column != self.neq
        if self.starts_with is not None:
            return like(column, f"{self.starts_with}%")
        if self.ends_with is not None:
            return like(column, f"%{self.ends_with}")
        if self.contains is not None:
            return like(column, f"%{self.contains}%")
        if allow_in and self.is_in:
            return column.isin(*self.is_in)
        return None


def like(column: Column, pattern: str) -> Column:
    """LIKE that takes A-Z as a-z and keeps other letters apart; ``%`` and ``_`` in
    the value stay wildcards."""
    folded = pattern.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return F.translate(column, ascii_uppercase, ascii_lowercase).like(folded.replace("\\", "\\\\"))


@dataclass(frozen=True)
class Range:
    """Inclusive; 0 leaves an end open, two zeros filter nothing."""

    start: float = 0
    end: float = 0

    def on(self, column: Column) -> Column | None:
        if self.start > 0 and self.end > 0:
            return column.between(self.start, self.end)
        if self.start > 0:
            return column >= self.start
        if self.end > 0:
            return column <= self.end
        return None


@dataclass(frozen=True)
class TimeRange:
    start: int | None = None
    end: int | None = None
    named: str | None = None

    def on(self, column: Column, now: int) -> Column | None:
        if self.start is not None and self.end is not None:
            return column.between(self.start, self.end)
        if self.start is not None:
            return column >= self.start
        if self.end is not None:
            return column <= self.end
        if self.named in NAMED_RANGES:
            return column >= now - NAMED_RANGES[self.named]
        return None


@dataclass(frozen=True)
class JobFilter:
    tags: tuple[str, ...] = ()
    db_id: tuple[int, ...] = ()
    job_id: StringFilter | None = None
    array_job_id: int | None = None
    user: StringFilter | None = None
    project: StringFilter | None = None
    job_name: StringFilter | None = None
    cluster: StringFilter | None = None
    subcluster: StringFilter | None = None
    partition: StringFilter | None = None
    duration: Range | None = None
    energy: Range | None = None
    num_nodes: Range | None = None
    num_acc: Range | None = None
    num_hwthreads: Range | None = None
    start_time: TimeRange | None = None
    state: tuple[str, ...] = ()
    metric_stats: dict[str, Range] = field(default_factory=dict)
    shared: str | None = None
    schedule: str | None = None
    node: StringFilter | None = None


def footprint_range(key: str, wanted: Range) -> Column | None:
    """Range on a footprint entry; a name with odd characters matches nothing."""
    if not METRIC_NAME.match(key):
        return F.lit(False)
    return wanted.on(F.col("footprint")[key])


def host_predicate(wanted: StringFilter) -> Column | None:
    """Some resource's host name fulfils the predicate (``in`` is not offered)."""
    if wanted.on(F.lit(""), allow_in=False) is None:
        return None
    return F.exists("resources", lambda r: wanted.on(r["hostname"], allow_in=False))


def schedule_predicate(schedule: str) -> Column | None:
    name = F.col("meta_data")["jobName"]
    return {"interactive": name == "interactive", "batch": name != "interactive"}.get(schedule)


def job_predicates(wanted: JobFilter, now: int = 0) -> list[Column]:
    text = {
        "job_id": F.col("job_id").cast("string"), "user": F.col("hpc_user"), "project": F.col("project"), "cluster": F.col("cluster"),
        "subcluster": F.col("subcluster"), "partition": F.col("cluster_partition"),
    }
    found: list[Column | None] = [getattr(wanted, k).on(c) for k, c in text.items() if getattr(wanted, k)]
    if wanted.db_id:
        found.append(F.col("id").isin(*wanted.db_id))
    if wanted.array_job_id is not None:
        found.append(F.col("array_job_id") == wanted.array_job_id)
    if wanted.job_name:
        found.append(wanted.job_name.on(F.col("meta_data")["jobName"], allow_in=False))
    found += [getattr(wanted, k).on(F.col(k)) for k in ("duration", "energy", "num_nodes", "num_acc", "num_hwthreads") if getattr(wanted, k)]
    if wanted.start_time:
        found.append(wanted.start_time.on(F.col("start_time"), now))
    if wanted.state:
        found.append(F.col("job_state").isin(*wanted.state))
    found += [footprint_range(k, r) for k, r in wanted.metric_stats.items()]
    if wanted.shared:
        found.append(F.col("shared") == wanted.shared)
    if wanted.schedule:
        found.append(schedule_predicate(wanted.schedule))
    if wanted.node:
        found.append(host_predicate(wanted.node))
    return [c for c in found if c is not None]


def filter_jobs(jobs: DataFrame, wanted: JobFilter, job_tags: DataFrame | None = None, now: int = 0) -> DataFrame:
    out = reduce(lambda df, c: df.where(c), job_predicates(wanted, now), jobs)
    if wanted.tags:
        if job_tags is None:
            raise ValueError("a tag filter needs job_tags")
        out = with_any_tag(out, job_tags, wanted.tags)
    return out


def with_any_tag(jobs: DataFrame, job_tags: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Jobs with at least one of the tags, each once."""
    wanted = job_tags.where(F.col("tag_id").isin(*tags)).select(F.col("job_id").alias("_job"))
    return jobs.join(wanted, jobs["id"] == F.col("_job"), "left_semi")


@dataclass(frozen=True)
class User:
    username: str
    roles: frozenset[str] = frozenset()
    projects: tuple[str, ...] = ()


def secure_jobs(jobs: DataFrame, user: User) -> DataFrame:
    """Row-level access: staff see all, managers their projects, users their own."""
    if not user.roles:
        raise PermissionError("user has no role")
    if user.roles & {"admin", "support", "api"}:
        return jobs
    own = F.col("hpc_user") == user.username
    if "manager" in user.roles:
        return jobs.where(F.col("project").isin(*user.projects) | own) if user.projects else jobs.where(own)
    if "user" in user.roles:
        return jobs.where(own)
    raise PermissionError(f"no access for roles {sorted(user.roles)}")


def readable_tags(tags: DataFrame, user: User) -> DataFrame:
    """Global tags, own tags, and the administrators' for staff."""
    scopes = ["global", user.username] + (["admin"] if user.roles & {"admin", "support"} else [])
    return tags.where(F.col("tag_scope").isin(*scopes))


def filter_nodes(
    states: DataFrame, cluster: StringFilter | None = None, subcluster: StringFilter | None = None, hostname: StringFilter | None = None,
    node_state: str | None = None, health_state: str | None = None, time_start: int | None = None,
) -> DataFrame:
    """``time_start`` is exclusive and meant for timelines."""
    named = {"cluster": cluster, "subcluster": subcluster, "hostname": hostname}
    found = [f.on(F.col(k)) for k, f in named.items() if f]
    found += [F.col(k) == v for k, v in (("node_state", node_state), ("health_state", health_state)) if v]
    if time_start is not None:
        found.append(F.col("time_stamp") > time_start)
    return reduce(lambda df, c: df.where(c), [c for c in found if c is not None], states)


def search_term(jobs: DataFrame, users: DataFrame, term: str) -> DataFrame:
    """(kind, value) of the first that fits: job number, user, real name,
    project, else a job name. One row."""
    one = jobs.sparkSession.range(1)
    if term.lstrip("-").isdigit():
        return one.select(F.lit("job_id").alias("kind"), F.lit(term).alias("value"))
    hits = [
        jobs.where(F.col("hpc_user") == term).select(F.lit(1).alias("rank"), F.lit("user").alias("kind"), F.col("hpc_user").alias("value")),
        users.where(like(F.col("name"), f"%{term}%")).select(F.lit(2), F.lit("name"), F.col("username")),
        jobs.where(F.col("project") == term).select(F.lit(3), F.lit("project"), F.col("project")),
        one.select(F.lit(4), F.lit("job_name"), F.lit(term)),
    ]
    every = reduce(DataFrame.union, hits)
    return every.agg(F.min(F.struct("rank", "value", "kind")).alias("m")).select("m.kind", "m.value")


def find_values(df: DataFrame, column: str, part: str = "") -> DataFrame:
    """Distinct values that contain ``part``."""
    out = df.where(like(F.col(column), f"%{part}%")) if part else df
    return out.select(F.col(column).alias("value")).distinct()


def project_metrics(series: DataFrame, metrics: list[str], scopes: list[str], keys: tuple[str, ...] = ("job",)) -> DataFrame:
    """Rows of the wanted metrics; where a metric comes in several scopes, the
    wanted scopes, or all if none of them is there."""
    from pyspark.sql.window import Window

    per = Window.partitionBy(*keys, "metric")
    hit = F.col("scope").isin(*scopes)
    out = series.where(F.col("metric").isin(*metrics)).withColumn("_hit", hit).withColumn("_any", F.max(hit).over(per))
    return out.where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")
