"""Structured Streaming: sample ingest, job life cycle, node states."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from halyard import schemas
from halyard.functions.scalars import scheduler_state
from halyard.operators.joins import assign_subcluster
from halyard.operators.nodes import join_health
from halyard.operators.scan import Step, along, column
from halyard.sources.line_protocol import parse_line_protocol

#: Cells of the buffer that still takes late samples.
BUFFER_CELLS = 512


def ingest_samples(lines: DataFrame, default_cluster: str, config: DataFrame, step: int) -> DataFrame:
    """Line protocol to the last value of each series and cell. Samples later than
    512 cells are dropped by the watermark; ``lines``: line, seq (arrival). A stream
    does not know a series' first sample for good, so cells begin at multiples of
    the step."""
    rows = parse_line_protocol(lines, default_cluster, config, keep=("seq",))
    stamped = rows.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", f"{BUFFER_CELLS * step} seconds")
    cell = F.window("time", f"{step} seconds")
    out = stamped.groupBy("cluster", "hostname", "scope", "scope_id", "metric", cell.alias("w")).agg(F.max_by("value", "seq").alias("value"))
    return out.select("cluster", "hostname", "scope", "scope_id", "metric", F.unix_timestamp("w.start").alias("t"), "value")


SERIES_OUT = "cluster string, hostname string, scope string, scope_id string, metric string, cell long, t long, value double, seq long, late boolean"
SERIES_KEY = ("cluster", "hostname", "scope", "scope_id", "metric")


def write_along(begin: int | None, times: list[int], step: int) -> tuple[list[int | None], int | None]:
    """Cells of a series' samples in order of arrival, and the begin of its buffer. A
    sample before the begin is late (None); one 512 cells or more behind it begins
    a buffer of its own."""
    cells: list[int | None] = []
    for ts in times:
        if begin is None or ts - begin >= BUFFER_CELLS * step:
            begin = ts - step // 2
        cells.append(None if ts < begin else begin // step + (ts - begin) // step)
    return cells, begin


class SeriesBuffer(StatefulProcessor):
    """State of one series: where its buffer begins. A sample is late by its own series
    alone, however far others have run ahead. Rows of a batch that meet in a cell leave
    as one, the last; ``seq`` tells a sink which of two batches' values is newer."""

    def __init__(self, step: int, idle_ms: int):
        self.step, self.idle_ms = step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begin = handle.getValueState("begin", "begin long", self.idle_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        begin = self.begin.get()[0] if self.begin.exists() else None
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")  # one series' rows of one trigger
        cells, begin = write_along(begin, batch["ts"].tolist(), self.step)
        self.begin.update((begin,))
        batch["late"] = [c is None for c in cells]
        batch["cell"] = [ts // self.step if c is None else c for c, ts in zip(cells, batch["ts"].tolist())]
        kept = pd.concat([batch[batch["late"]], batch[~batch["late"]].drop_duplicates("cell", keep="last")])
        for name, value in zip(SERIES_KEY, key):
            kept[name] = value
        kept["t"] = kept["cell"] * self.step
        yield kept[[f.split()[0] for f in SERIES_OUT.split(", ")]]

    def close(self) -> None:
        pass


def _ms(days: int | None) -> int:
    return (days or 0) * 86_400_000


def _clock(days: int | None) -> str:
    """State that ends by age needs Spark's clock; its triggers then never rest."""
    return "ProcessingTime" if days else "None"


def ingest_series(lines: DataFrame, default_cluster: str, config: DataFrame, step: int, idle_days: int | None = None) -> DataFrame:
    """Line protocol (line, seq) to cells of each series' own buffer, as they change.
    Late samples leave marked ``late``. State is one number a series; with
    ``idle_days``, a series that is silent for so long is forgotten and begins anew."""
    rows = parse_line_protocol(lines, default_cluster, config, keep=("seq",))
    return rows.groupBy(*SERIES_KEY).transformWithStateInPandas(SeriesBuffer(step, _ms(idle_days)), SERIES_OUT, "Update", _clock(idle_days))


def ingest_series_batch(lines: DataFrame, default_cluster: str, config: DataFrame, step: int) -> DataFrame:
    """The cells that a stream of the same lines ends with: the last value of each."""
    rows = parse_line_protocol(lines, default_cluster, config, keep=("seq",))

    def buffer() -> Step:
        begin = None

        def write(batch: pa.RecordBatch) -> pa.Array:
            nonlocal begin
            cells, begin = write_along(begin, column(batch, "ts").to_pylist(), step)
            return pa.array(cells, pa.int64())

        return write

    placed = along(rows, SERIES_KEY, ("seq",), buffer, "cell", "bigint").where("cell IS NOT NULL")
    return placed.groupBy(*SERIES_KEY, "cell").agg(F.max_by("value", "seq").alias("value"))


JOBS_OUT = (
    "cluster string, job_id long, start_time long, action string, reason string, hpc_user string, job_state string, duration long, num_nodes long, subcluster string"
)


def parse_job_events(events: DataFrame) -> DataFrame:
    """``function``, ``seq`` (arrival) and JSON text to typed columns."""
    parsed = events.select("function", "seq", F.from_json("event", schemas.JOB_EVENT).alias("e")).where(F.col("e").isNotNull() & F.col("e.jobId").isNotNull())
    return parsed.select(
        "function", "seq", F.coalesce("e.cluster", F.lit("")).alias("cluster"), F.col("e.jobId").alias("job_id"), F.col("e.startTime").alias("start_time"), F.col("e.stopTime").alias("stop_time"),
        F.col("e.user").alias("hpc_user"), F.col("e.jobState").alias("job_state"), F.col("e.numNodes").alias("num_nodes"), F.size(F.coalesce("e.resources", F.array())).alias("hosts"), F.col("e.subCluster").alias("subcluster"),
    )


class JobLifecycle(StatefulProcessor):
    """State of one (cluster, job_id): its running starts and its last accepted one.

    Starts within a day of the last accepted one are duplicates; a stop ends the
    newest running start that it fits. Rejects leave as rows with a reason. Stopped
    starts are forgotten when a later one is accepted, all of a key when nothing is
    heard of it for ``idle_ms``: the state is one row and one for each running job.
    """

    WINDOW = 86400
    STATES = frozenset({"completed", "failed", "cancelled", "timeout", "out_of_memory", "node_fail", "preempted", "deadline", "boot_fail", "suspended"})

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = "start_time long, running boolean, hpc_user string, num_nodes long, subcluster string"
        self.jobs = handle.getListState("jobs", fields, self.idle_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        jobs = [list(j) for j in self.jobs.get()]
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")  # one job id's events of one trigger
        out = [(*key, *self.apply(jobs, r)) for r in batch.itertuples()]
        if jobs:  # an empty list cannot be stored
            self.jobs.put([tuple(j) for j in jobs])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in JOBS_OUT.split(", ")])

    @classmethod
    def apply(cls, jobs: list, row) -> tuple:
        """One event; ``jobs`` stays in order of acceptance and short."""
        out = cls.start(jobs, row) if row.function == "start_job" else cls.stop(jobs, row)
        jobs[:] = [j for k, j in enumerate(jobs) if j[1] or k == len(jobs) - 1]
        return out

    @classmethod
    def start(cls, jobs: list, row) -> tuple:
        begin = None if pd.isna(row.start_time) else int(row.start_time)
        nodes = 0 if pd.isna(row.num_nodes) else int(row.num_nodes)
        user = row.hpc_user if isinstance(row.hpc_user, str) else ""
        sub = row.subcluster if isinstance(row.subcluster, str) else ""
        reason = "no start time" if begin is None else "no user" if not user else "no nodes" if nodes < 1 else "resources differ from nodes" if row.hosts != nodes else ""
        if not reason and jobs and begin - jobs[-1][0] < cls.WINDOW:
            reason = "duplicate start"
        if reason:
            return begin or 0, "reject", reason, user, "running", 0, nodes, sub
        jobs.append([begin, True, user, nodes, sub])
        return begin, "start", "", user, "running", 0, nodes, sub

    @classmethod
    def stop(cls, jobs: list, row) -> tuple:
        wanted = None if pd.isna(row.start_time) else int(row.start_time)
        end = None if pd.isna(row.stop_time) else int(row.stop_time)
        state = row.job_state if isinstance(row.job_state, str) and row.job_state else "completed"
        fits = [j for j in jobs if wanted is None or j[0] == wanted]
        running = [j for j in fits if j[1]]
        reason = "no stop time" if end is None else "unknown job" if not fits else "not running" if not running else "stop before start" if running[-1][0] > end else "" if state in cls.STATES else "invalid state"
        if reason:
            return wanted or 0, "reject", reason, "", state, 0, 0, ""
        job = running[-1]
        job[1] = False
        return job[0], "stop", "", job[2], state, end - job[0], job[3], job[4]

    def close(self) -> None:
        pass


def job_lifecycle(events: DataFrame, idle_days: int | None = None) -> DataFrame:
    """Start and stop events (function, event, seq) to accepted changes and rejects.
    With ``idle_days``, ids that nothing is heard of for so long are forgotten."""
    return parse_job_events(events).groupBy("cluster", "job_id").transformWithStateInPandas(JobLifecycle(_ms(idle_days)), JOBS_OUT, "Append", _clock(idle_days))


def job_lifecycle_batch(events: DataFrame) -> DataFrame:
    """The same over a bounded table of events: one pass along each (cluster, job_id)."""
    names = [c.split()[0] for c in JOBS_OUT.split(", ")][2:]
    kinds = {"long": pa.int64(), "string": pa.string()}
    shape = pa.struct([(n, kinds[t]) for n, t in (c.split() for c in JOBS_OUT.split(", ")[2:])])

    def life() -> Step:
        jobs: list = []

        def follow(batch: pa.RecordBatch) -> pa.Array:
            rows = (SimpleNamespace(**r) for r in batch.to_pylist())
            return pa.array([dict(zip(names, JobLifecycle.apply(jobs, r))) for r in rows], shape)

        return follow

    kind = ",".join(f"{n}:{t}" for n, t in (c.split() for c in JOBS_OUT.split(", ")[2:]))
    told = along(parse_job_events(events), ("cluster", "job_id"), ("seq",), life, "change", f"struct<{kind}>")
    return told.select("cluster", "job_id", "change.*")


def node_state_rows(events: DataFrame, health: DataFrame, node_lists: DataFrame | None = None) -> DataFrame:
    """Node updates (hostname, states, time_stamp, ...) with one scheduler state
    and joined health; works on a stream with a static health table. With the
    ``node_lists`` of the configuration (cluster, subcluster, nodes) updates, which
    then hold cluster, get the subcluster of their host, null if none lists it."""
    out = join_health(events.withColumn("node_state", scheduler_state(F.col("states"))).drop("states"), health)
    if node_lists is None:
        return out
    hosted = out.withColumn("first_host", F.col("hostname")).withColumn("subcluster", F.lit(None).cast("string"))
    return assign_subcluster(hosted, node_lists).drop("first_host", "subcluster").withColumnRenamed("assigned", "subcluster")


def sync_sink(
    read_jobs: Callable[[], DataFrame], write: Callable[[DataFrame], None], staging: str, hooks: tuple[Callable[[DataFrame], None], ...] = ()
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: appends staged jobs that are new and hands
    them to the start hooks. The new rows are first written under ``staging`` by
    batch id, so that hooks see them though the main table has changed, and a
    batch that is repeated replaces its own."""
    from halyard.operators.retention import sync_jobs

    def run(batch: DataFrame, batch_id: int) -> None:
        path = f"{staging}/batch-{batch_id}"
        fresh = sync_jobs(batch, read_jobs())
        fresh.write.mode("overwrite").parquet(path)
        fresh = batch.sparkSession.read.schema(fresh.schema).parquet(path)
        write(fresh)
        for hook in hooks:
            hook(fresh)

    return run
