"""Fixed-frequency series: grids, roll-up over hardware scopes, statistics,
down-sampling and health.

A sample row has cluster, hostname, scope, scope_id, metric, ts, seq, value. A
missing value is null. A series' grid begins half a step before its first sample,
and anew half a step before a sample that is ``GRID_CELLS`` cells or more behind its
begin; ``cell`` numbers its cells from ``begin div step`` on, so that cells of
different series meet that begin less than a step apart.

Configuration and topology may be kept by cluster and subcluster (see ``config``);
cells then carry their subcluster.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import sanitize_stats
from halyard.operators.config import config_keys, host_keys, place_of, with_config
from halyard.operators.lists import node_list_page
from halyard.operators.packed import dealt
from halyard.operators.rollup import AVG, LONE, SUM, cell_stats, cells_at
from halyard.operators.scan import Step, along, column

#: Scopes from fine to coarse (fixed values).
SCOPE_ORDER = ("accelerator", "hwthread", "core", "memory_domain", "socket", "node")
#: Legal (native, target) pairs; accelerators to other scopes below node give nothing.
LEGAL = {
    "hwthread": {"hwthread", "core", "socket", "node"}, "core": {"core", "socket", "node"}, "memory_domain": {"memory_domain", "socket", "node"},
    "socket": {"socket", "node"}, "accelerator": {"accelerator", "node"}, "node": {"node"},
}
SERIES = ("cluster", "hostname", "scope", "scope_id", "metric")
JOB_SERIES = ("id", *SERIES)


#: Cells of one grid; a later sample begins a new one (fixed value).
GRID_CELLS = 512


def _series_keys(rows: DataFrame, keys: tuple[str, ...]) -> tuple[str, ...]:
    """The keys, and the subcluster if the rows have one: it follows from the host."""
    return (*keys, "subcluster") if "subcluster" in rows.columns and "subcluster" not in keys else keys


def _place(times: np.ndarray, begin: int | None, step: int) -> tuple[np.ndarray, int]:
    """Cells of a series' sorted times, and the begin of the grid of the last."""
    cells, at = np.empty(len(times), np.int64), 0
    while at < len(times):
        if begin is None or times[at] >= begin + GRID_CELLS * step:
            begin = int(times[at]) - step // 2
        end = int(np.searchsorted(times, begin + GRID_CELLS * step))
        cells[at:end] = begin // step + (times[at:end] - begin) // step
        at = end
    return cells, begin


def with_cells(samples: DataFrame, step: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds ``cell``, on the grid of the sample's series. Rows without a time have
    none; a null in a key is a key of its own.

    One shuffle by series, sorted by time; each task goes along its rows and jumps
    from grid to grid (a binary search each), and holds one batch and one begin. A
    series has a sample a step, so no series is a large part of a table."""

    def number() -> Step:
        begin = None

        def cells(rows: pa.RecordBatch) -> pa.Array:
            nonlocal begin
            times = column(rows, "ts")
            empty = times.null_count  # nulls come first
            out = np.zeros(len(times), np.int64)
            if empty < len(times):
                out[empty:], begin = _place(times.slice(empty).to_numpy(), begin, step)
            return pa.array(out, mask=np.arange(len(times)) < empty)

        return cells

    return along(samples.withColumn("ts", F.col("ts").cast("long")), keys, ("ts",), number, "cell", "bigint")


def dedup_samples(samples: DataFrame, step: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """The last written value of each series and cell. Samples that carry a cell
    already (``with_cells``, or another grid) keep it."""
    placed = samples if "cell" in samples.columns else with_cells(samples, step, keys)
    return placed.groupBy(*_series_keys(placed, keys), "cell").agg(F.max_by("value", "seq").alias("value"))


def grid_fill(cells: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """All cells between a series' first and last, missing ones null."""
    keys = _series_keys(cells, keys)
    # A cell has one value at most; of more rows the last in this order stays.
    after = F.lead("cell").over(Window.partitionBy(*keys).orderBy("cell", "value"))
    rows = cells.where("cell IS NOT NULL").select(*keys, "cell", "value", after.alias("_after")).where("_after IS NULL OR _after > cell")
    # Each cell fills the gap behind it, in the task that holds it: a whole series from
    # its ends alone would be many rows of a few bytes, all in one task.
    filled = rows.select(*keys, F.col("cell").alias("_at"), "value", F.explode(F.sequence("cell", F.coalesce(F.col("_after") - 1, "cell"))).alias("cell"))
    return filled.select(*keys, "cell", F.when(F.col("cell") == F.col("_at"), F.col("value")).alias("value"))


def align(samples: DataFrame, step: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Samples on their grid: one value a cell, gaps null."""
    return grid_fill(dedup_samples(samples, step, keys), keys)


def read_range(cells: DataFrame, start: int, end: int, step: int, keys: tuple[str, ...] = SERIES, pad: bool = False) -> DataFrame:
    """Cells in [start, end). Cells before a series' first write are cut, or with
    ``pad`` given as null from the start."""
    first, last = start // step, -(-end // step) - 1
    inside = cells.where(F.col("cell").between(first, last))
    if not pad:
        return inside
    known = inside.groupBy(*keys).agg(F.min("cell").alias("lo"))
    front = known.where(F.col("lo") > first).withColumn("cell", F.explode(F.sequence(F.lit(first).cast("long"), F.col("lo") - 1))).drop("lo")
    return inside.unionByName(front.withColumn("value", F.lit(None).cast("double")))


def select_series(samples: DataFrame, selector: dict[str, str | list[str] | None]) -> DataFrame:
    """By level: an exact value, a group of values, or None for any."""
    for level, wanted in selector.items():
        if isinstance(wanted, list):
            samples = samples.where(F.col(level).isin(*wanted))
        elif wanted is not None:
            samples = samples.where(F.col(level) == wanted)
    return samples


def nearest_series(samples: DataFrame) -> DataFrame:
    """What a selector that ends at the host means: the host's own series of a metric
    where it has one, else all series below. Rows without a scope are below; null keys
    are keys of their own. Only names of hosts with own series are matched, so no
    sample moves unless that list is large."""
    keys = ("cluster", "hostname", "metric")
    own = F.col("scope").eqNullSafe("node")
    owners = samples.where(own).select(*(F.col(k).alias(f"{k}_") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return samples.where(own).unionByName(samples.where(~own).join(owners, same, "left_anti"))


def result_scope(native: str, target: str) -> str | None:
    """The coarser of both; None where nothing comes out; an error if not offered."""
    scope = max(native, target, key=SCOPE_ORDER.index)
    if native == "accelerator" and scope != "node":
        return "accelerator" if target == "accelerator" else None
    if scope not in LEGAL[native]:
        raise ValueError(f"{native} cannot be rolled up to {scope}")
    return scope


def _series_of(keys: list[str] | tuple[str, ...], names: tuple[str, ...]) -> Column:
    """Number of distinct ``names`` without nulls over rows of equal keys: windows, so
    rows that lie together by some of the keys do not move again."""
    name = F.when(reduce(Column.__and__, [F.col(n).isNotNull() for n in names]), F.struct(*names))
    whole = Window.partitionBy(*keys)
    rank = F.dense_rank().over(whole.orderBy(name))
    return F.max(rank).over(whole) - F.max(F.when(name.isNull(), 1).otherwise(0)).over(whole)


def scope_rollup(cells: DataFrame, topology: DataFrame, config: DataFrame, native: str, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Native cells to a target scope: sum or average over the series of each
    target, by the metric's aggregation. A cell that any series misses is null.
    Metrics without aggregation may hold one series a target only. ``by``: further
    keys of the cells, as a job's id; series are then counted along windows, which move
    no row of a job and host that lie together."""
    scope = result_scope(native, target)
    if scope is None:
        return cells.where(F.lit(False))
    if scope == native:
        return cells
    if scope == "node":
        placed = cells.withColumn("target", F.lit(0).cast("long"))
    else:
        at = config_keys(cells, topology)
        ids = topology.select(*at, F.col(native).cast("long").alias("scope_id"), F.col(scope).cast("long").alias("target")).distinct()
        placed = cells.join(ids, [*at, "scope_id"])
    placed = with_config(placed, config, "aggregation")
    sub = [c for c in ("subcluster",) if c in cells.columns]
    base = (*by, "cluster", *sub, "hostname", "metric", "target")
    totals = (F.sum("value").alias("total"), F.count("value").alias("there"), F.first("aggregation").alias("agg"))
    if by:
        out = placed.withColumn("series", _series_of(base, ("scope_id",))).groupBy(*base, "cell").agg(*totals, F.first("series").alias("series"))
    else:
        size = placed.groupBy(*base).agg(F.countDistinct("scope_id").alias("series"))
        combined = placed.groupBy(*base, "cell").agg(*totals)
        same = reduce(Column.__and__, [combined[c].eqNullSafe(size[c]) for c in base])
        out = combined.join(size, same).select(*[combined[c] for c in (*base, "cell", "total", "there", "agg")], "series")
    lone = (F.col("agg") != "sum") & (F.col("agg") != "avg") & (F.col("series") > 1)
    value = F.when(lone, F.raise_error(F.lit("no aggregation for more than one series"))).when(
        F.col("there") == F.col("series"), F.when(F.col("agg") == "avg", F.col("total") / F.col("series")).otherwise(F.col("total"))
    )
    return out.select(*by, "cluster", *sub, "hostname", F.lit(scope).alias("scope"), F.col("target").alias("scope_id"), "metric", "cell", value.alias("value"))


def add_node_scope(cells: DataFrame, topology: DataFrame, config: DataFrame, native: str, metrics: tuple[str, ...] = ("flops_any", "mem_bw")) -> DataFrame:
    """The cells, and node series of the given metrics."""
    return cells.unionByName(scope_rollup(cells.where(F.col("metric").isin(*metrics)), topology, config, native, "node"))


def series_stats(cells: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Average, least and greatest value that is there; null if none is."""
    return cells.groupBy(*keys).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("samples"))


def selector_stats(cells: DataFrame, config: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Per metric over its series: average (or sum) of averages, least, greatest,
    samples; by cluster where the configuration is, as clusters may aggregate unlike."""
    per = series_stats(cells, _series_keys(cells, keys))
    joined = with_config(per, config, "aggregation")
    return joined.groupBy(*[c for c in ("cluster",) if c in config.columns], "metric").agg(
        F.when(F.first("aggregation") == "avg", F.avg("avg")).otherwise(F.sum("avg")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("samples").alias("samples")
    )


def _round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def job_stats(node_stats: DataFrame, jobs: DataFrame, metrics: list[str]) -> DataFrame:
    """Live statistics of jobs: average over all nodes; least and greatest take 0
    in; metrics that are missing are zeros. ``node_stats``: id, metric, avg, min, max."""
    sums = node_stats.where(F.col("metric").isin(*metrics)).groupBy("id", "metric").agg(F.sum("avg").alias("a"), F.min("min").alias("lo"), F.max("max").alias("hi"))
    every = jobs.select("id", "num_nodes").withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    out = every.join(sums, ["id", "metric"], "left")
    zero = F.lit(0.0)
    return out.select(
        "id", "metric", _round2(F.coalesce(F.try_divide("a", "num_nodes"), zero)).alias("avg"),
        _round2(F.least(zero, F.coalesce("lo", zero))).alias("min"), _round2(F.greatest(zero, F.coalesce("hi", zero))).alias("max"),
    )


def archive_job_stats(series: DataFrame, jobs: DataFrame) -> DataFrame:
    """At a job's end, node scope: average over all nodes to two digits, true extremes."""
    sums = series.groupBy("id", "metric").agg(F.sum("avg").alias("a"), F.min("min").alias("min"), F.max("max").alias("max"))
    return sums.join(jobs.select("id", "num_nodes"), "id").select("id", "metric", _round2(F.try_divide("a", "num_nodes")).alias("avg"), "min", "max")


def stats_series(cells: DataFrame, keys: tuple[str, ...], least: int = 8) -> DataFrame:
    """Per cell over the series of a key: min, mean, median, max; only for keys
    of ``least`` series or more."""
    enough = cells.groupBy(*keys).agg(F.countDistinct("hostname", "scope_id").alias("series")).where(F.col("series") >= least).drop("series")
    return cells.join(enough, list(keys)).groupBy(*keys, "cell").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.max("value").alias("max")
    )


def cluster_metrics(cells: DataFrame, factor: float = 1e-3, by: tuple[str, ...] = ()) -> DataFrame:
    """(metric, cell): sum over all nodes, scaled, to two digits; and the node count.
    ``by``: further keys, as the cluster, or the cluster and subcluster."""
    nodes = cells.groupBy(*by, "metric").agg(F.countDistinct("cluster", "hostname").alias("nodes"))
    return cells.groupBy(*by, "metric", "cell").agg(_round2(F.sum("value") * factor).alias("value")).join(nodes, [*by, "metric"])


def lttb(points: Column, size: int) -> Column:
    """Largest-triangle-three-buckets over an array of (x, y) structs.

    First and last point stay; of each bucket between stays the point of the
    largest triangle with the point before and the next bucket's mean. A fold
    over the buckets; no Python.
    """
    n = F.size(points)
    every = (n - 2) / F.lit(float(size - 2))
    edge = lambda k: (F.floor(k * every) + 1).cast("int")

    def pick(acc, k):
        last = acc[F.size(acc) - 1]
        begin, end = edge(k), edge(k + 1)
        after_end = F.least(edge(k + 2), n)
        after = F.slice(points, end + 1, F.greatest(after_end - end, F.lit(1)))
        count = F.size(after)
        mean_x = F.aggregate(after, F.lit(0.0), lambda s, p: s + p["x"]) / count
        mean_y = F.aggregate(after, F.lit(0.0), lambda s, p: s + p["y"]) / count
        area = lambda p: F.abs((last["x"] - mean_x) * (p["y"] - last["y"]) - (last["x"] - p["x"]) * (mean_y - last["y"]))
        bucket = F.slice(points, begin + 1, end - begin)
        # Of equal areas the first point.
        ranked = F.array_max(F.transform(bucket, lambda p: F.struct(area(p).alias("a"), (-p["x"]).alias("o"), p["y"].alias("y"))))
        return F.concat(acc, F.array(F.struct((-ranked["o"]).alias("x"), ranked["y"].alias("y"))))

    first = F.slice(points, 1, 1)
    kept = F.aggregate(F.sequence(F.lit(0), F.lit(size - 3)), first, pick) if size > 2 else first
    return F.when((n <= size) | F.lit(size <= 2), points).otherwise(F.concat(kept, F.slice(points, -1, 1)))


def downsample_lttb(cells: DataFrame, size: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """At most ``size`` points a series; 0 leaves all. Missing cells are left out."""
    rows = cells.where(F.col("value").isNotNull())
    if size == 0:
        return rows.select(*keys, "cell", "value")
    point = F.struct(F.col("cell").cast("double").alias("x"), F.col("value").alias("y"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return lists.select(*keys, F.explode(lttb(F.col("p"), size)).alias("q")).select(*keys, F.col("q.x").cast("long").alias("cell"), F.col("q.y").alias("value"))


def _job_cells(job_samples: DataFrame, step: int) -> DataFrame:
    """Cells of jobs' samples, dealt by job and host: the one shuffle of all that follows
    by series of a job."""
    placed = job_samples if "cell" in job_samples.columns else with_cells(job_samples, step, JOB_SERIES)
    columns = [*_series_keys(placed, JOB_SERIES), "cell", "seq", "value"]
    return dedup_samples(placed.select(*columns).repartition("id", "hostname"), step, JOB_SERIES)


def job_node_stats(job_samples: DataFrame, topology: DataFrame, config: DataFrame, step: int, native: str = "hwthread") -> DataFrame:
    """(id, hostname, metric): node-scope statistics of jobs' samples; hosts
    without a whole cell are left out. ``job_samples`` carries id."""
    cells = _job_cells(job_samples, step)
    node = scope_rollup(cells, topology, config, native, "node", ("id",))
    return series_stats(node, ("id", "hostname", "metric")).where("avg IS NOT NULL")


def _at_scopes(cells: DataFrame, topology: DataFrame, config: DataFrame, native: str, scopes: list[str] | tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Cells at every wanted scope; scopes that give the same are taken once, and
    those that give nothing are absent."""
    wanted = dict.fromkeys(result_scope(native, s) for s in scopes)
    parts = [scope_rollup(cells, topology, config, native, s, by) for s in wanted if s]
    columns = [*by, *_series_keys(cells, SERIES), "cell", "value"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]) if parts else cells.select(*columns).where(F.lit(False))


def _sanitized(stats: DataFrame) -> DataFrame:
    names = ("avg", "min", "max")
    return stats.withColumns(dict(zip(names, sanitize_stats(*[F.col(c) for c in names]))))


def scoped_job_stats(cells: DataFrame, topology: DataFrame, config: DataFrame, native: str, scopes: list[str]) -> DataFrame:
    """Statistics at every wanted scope, missing ones as zeros."""
    return _sanitized(series_stats(_at_scopes(cells, topology, config, native, scopes)))


def archived_job_stats(series: DataFrame, metrics: list[str] | None = None, scopes: list[str] | None = None) -> DataFrame:
    """The same of finished jobs: the stored statistics of their series, as they
    are (``series``: id, hostname, scope, scope_id, metric, avg, min, max)."""
    rows = series.where(F.col("metric").isin(*metrics)) if metrics is not None else series
    rows = rows.where(F.col("scope").isin(*scopes)) if scopes is not None else rows
    return rows.select("id", "hostname", "scope", "scope_id", "metric", "avg", "min", "max")


def job_cells(job_samples: DataFrame, topology: DataFrame, config: DataFrame, step: int, metrics: list[str], scopes: tuple[str, ...] = ("node",), native: str = "hwthread") -> DataFrame:
    """Cells of jobs' samples at every wanted scope; metrics without a
    configuration are left out."""
    keys = config_keys(job_samples, config, "metric")
    rows = job_samples.where(F.col("metric").isin(*metrics)).join(config.select(*keys), keys, "left_semi")
    return _at_scopes(_job_cells(rows, step), topology, config, native, scopes, ("id",))


def job_metrics(cells: DataFrame, resolution: int | None = None, resolutions: tuple[int, ...] = ()) -> DataFrame:
    """Series of ``job_cells``, each down-sampled to ``resolution`` points (None: the
    greatest of the configured ``resolutions``; 0: all) with its statistics over all
    cells, missing ones as zeros. Scopes and metrics without values are absent."""
    size = max(resolutions, default=0) if resolution is None else resolution
    if size:
        return downsample_lttb(cells, size, JOB_SERIES).join(_sanitized(series_stats(cells, JOB_SERIES)), list(JOB_SERIES))
    series, value = Window.partitionBy(*JOB_SERIES), F.col("value")
    stats = {"avg": F.avg(value).over(series), "min": F.min(value).over(series), "max": F.max(value).over(series), "samples": F.count(value).over(series)}
    return _sanitized(cells.select(*JOB_SERIES, "cell", "value").withColumns(stats)).where(value.isNotNull())


def job_stats_series(job_samples: DataFrame, topology: DataFrame, config: DataFrame, metrics: list[str], scopes: tuple[str, ...], least: int = 8, native: str = "hwthread") -> DataFrame:
    """Least, mean, median and greatest value a cell of jobs with many series at a scope.
    ``job_samples`` carries id and cell; metrics without a configuration are left out.

    Samples of a job and metric move once; both passes (``rollup.py``) go along them
    where they then lie, sorted anew between, and no cell of a coarser scope moves."""
    wanted = tuple(s for s in dict.fromkeys(result_scope(native, s) for s in scopes) if s)
    place = [c for c in ("cluster", "subcluster") if c in job_samples.columns]
    keys, at = config_keys(job_samples, config, "metric"), config_keys(job_samples, topology)
    how = F.when(F.col("aggregation") == "avg", AVG).when(F.col("aggregation") != "sum", LONE).otherwise(SUM).cast("byte")
    rows = job_samples.where(F.col("metric").isin(*metrics)).join(config.select(*keys, how.alias("how")), keys)
    for scope in wanted:
        if scope not in (native, "node"):
            targets = topology.where(F.col(scope).isNotNull()).groupBy(*at, F.col(native).cast("long").alias("scope_id")).agg(F.collect_set(F.col(scope).cast("long")).alias(f"at_{scope}"))
            rows = rows.join(targets, [*at, "scope_id"], "left")
    order = ("id", "metric", "hostname", *place, "scope_id", "cell", "seq")
    rows = rows.select(*order, F.col("value").cast("double").alias("value"), "how", *[c for c in rows.columns if c.startswith("at_")])
    named = lambda c: f"{c} {rows.schema[c].dataType.simpleString()}"
    cells = dealt(rows, "id", "metric").sortWithinPartitions(*order).mapInArrow(
        lambda batches: cells_at(batches, tuple(place), native, wanted, least), f"{named('id')}, metric string, scope int, {named('cell')}, value double, series int, mean double, median double, max double"
    )
    return cells.sortWithinPartitions("id", "metric", "scope", "cell", "value").mapInArrow(
        lambda batches: cell_stats(batches, wanted, least), f"{named('id')}, metric string, scope string, {named('cell')}, min double, mean double, median double, max double"
    )


def node_metrics(cells: DataFrame, topology: DataFrame, config: DataFrame, states: DataFrame, metrics: list[str], start: int, end: int, step: int, hosts: list[str] | None = None, native: str = "hwthread") -> DataFrame:
    """Node-scope series of hosts in a time range with statistics, scheduler
    state and health; unknown metrics are dropped."""
    rows = cells.where(F.col("metric").isin(*metrics))
    rows = rows.where(F.col("hostname").isin(*hosts)) if hosts else rows
    node = read_range(scope_rollup(rows, topology, config, native, "node"), start, end, step)
    stats = series_stats(node, ("cluster", "hostname", "metric"))
    at = host_keys(node, states)
    info = states.select(*at, "node_state", "health_state")
    told = node.join(stats, ["cluster", "hostname", "metric"]).join(info, at, "left")
    return told.select(*place_of(config), "hostname", "metric", "cell", "value", "avg", "min", "max", "node_state", "health_state")


def node_metrics_list(
    cells: DataFrame, topology: DataFrame, config: DataFrame, latest: DataFrame, metrics: list[str], start: int, end: int, step: int,
    number: int, per_page: int, part: str = "", scopes: tuple[str, ...] = ("node",), resolution: int = 0, native: str = "hwthread", configured: DataFrame | None = None,
) -> DataFrame:
    """A page of nodes by host name with their series in a time range at every
    wanted scope, down-sampled, with statistics, states, the total and a next-page
    mark. Hosts without series are absent; ``configured`` as in ``node_list_page``."""
    at = host_keys(cells, latest)
    shown = node_list_page(latest, number, per_page, part, configured).select(*at, "node_state", "health_state", "total", "has_next")
    rows = cells.where(F.col("metric").isin(*metrics)).join(shown.select(*at), at, "left_semi")
    inside = read_range(_at_scopes(rows, topology, config, native, scopes), start, end, step)
    series = downsample_lttb(inside, resolution).join(_sanitized(series_stats(inside)), list(SERIES))
    return series.join(shown, at)


def metric_health(samples: DataFrame, expected: DataFrame, hosts: DataFrame, now: int) -> DataFrame:
    """Health of each host by its expected metrics (``expected``: metric, step).

    A metric is degraded if any of its series ends more than five steps before
    now, healthy if it has series and none is stale, else missing. A host without
    data fails; all healthy is full; none healthy fails; else partial. A series
    ends with the cell of its last sample, on the grid of its first: one combined
    aggregate, so grids begun anew are not looked at. ``hosts`` and ``expected`` may
    name clusters and subclusters; a host then owes the metrics of its place.
    """
    at = host_keys(samples, hosts)
    asked = config_keys(hosts, expected)
    spans = samples.groupBy(*at, "scope_id", "metric").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    end = F.expr("last - (last - first + step div 2) % step + step")
    known = hosts.select(*dict.fromkeys([*at, *asked])).distinct()
    grid = known.join(expected.select(*asked, "metric", "step"), asked) if asked else known.crossJoin(expected.select("metric", "step"))
    judged = spans.join(grid, [*at, "metric"]).groupBy(*at, "metric").agg(F.bool_or(end < F.lit(now) - 5 * F.col("step")).alias("stale"))
    state = grid.drop("step").join(judged, [*at, "metric"], "left")
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("metric"))))
    out = state.groupBy(*at).agg(
        names(F.col("stale").isNull()).alias("missing"), names(F.col("stale")).alias("degraded"), F.count_if(~F.col("stale")).alias("healthy")
    )
    health = F.when(F.col("healthy") == 0, "failed").when((F.size("missing") == 0) & (F.size("degraded") == 0), "full").otherwise("partial")
    return out.withColumn("health_state", health).withColumn("health_metrics", F.to_json(F.struct("missing", "degraded")))
