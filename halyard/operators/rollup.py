"""Cells of jobs' samples at several scopes, and statistics over the series of each cell:
two passes along sorted rows of jobs and metrics that lie together.

``cells_at`` folds a job and metric of up to ``HELD`` samples at once. Of larger ones it
holds the samples of a host and gives the cells, which ``cell_stats`` folds, sorted anew; it
holds the values of one cell and the statistics of one job, metric and scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from halyard.operators.scan import column

#: How a metric's series combine (``how``): sum, average, or one series alone.
SUM, AVG, LONE = 0, 1, 2
#: Samples of a job and metric that are folded at once (fixed value).
HELD = 1 << 18
NO_AGGREGATION = "no aggregation for more than one series"


def _edges(rows: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns; nulls are equal."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in names:
        codes = column(rows, name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _closed(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that no key is parted by, if they are sorted by the keys. A batch
    without rows is given on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        first = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 0)
        starts = np.flatnonzero(_edges(pa.Table.from_batches([first, batch]).combine_chunks().to_batches()[0], keys)) - first.num_rows
        if (starts > 0).any() or (held and (starts >= 0).any()):
            last = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _codes(*parts: np.ndarray) -> np.ndarray:
    """One number for each combination of the parts, in their order."""
    out = np.zeros(len(parts[0]), np.int64)
    for part in parts:
        known, code = np.unique(part, return_inverse=True)
        _, out = np.unique(out * len(known) + code, return_inverse=True)
    return out


def _jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Samples of whole jobs and metrics; or in parts, of whole hosts, where they are many."""
    held, parted = None, False
    for rows in _closed((b for b in batches if b.num_rows), ("id", "metric", "hostname")):
        rows = pa.Table.from_batches([held, rows] if held else [rows]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(_edges(rows, ("id", "metric")))
        first, last = int(starts[1:2].sum()) if parted else 0, int(starts[-1])
        if first:
            yield rows.slice(0, first), False
        if last > first:
            yield rows.slice(first, last - first), True
        rows, parted, held = rows.slice(last), parted and not last, None
        if parted or rows.num_rows > HELD:
            yield rows, False
            parted = True
        else:
            held = rows
    if held:
        yield held, True


def cells_at(batches: Iterator[pa.RecordBatch], place: tuple[str, ...], native: str, scopes: tuple[str, ...], least: int) -> Iterator[pa.RecordBatch]:
    """(id, metric, scope, cell, value, series, mean, median, max) of samples sorted by id,
    metric, hostname, ``place``, scope_id, cell and seq; ``scope``: its number in ``scopes``.
    Of jobs and metrics that are folded the rows of ``cell_stats``, ``value`` the least one and
    ``series`` null; else cells: ``series`` is 1 on one row of each series of a job, else 0."""
    for rows, whole in _jobs(batches):
        parts = list(_cells_at(rows, place, native, scopes))
        if not parts:
            continue
        cells = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        if whole:
            code = _codes(*(_numbers(column(cells, k)) for k in ("id", "metric", "scope", "cell")))
            value = column(cells, "value")
            order = np.lexsort((value.fill_null(0.0).to_numpy(), value.is_valid().to_numpy(zero_copy_only=False), code))
            folded = _enough(_fold(cells.take(pa.array(order))), least)
            none = pa.nulls(folded.num_rows, pa.int32())
            columns = [*folded.columns[:5], none, *folded.columns[5:8]]
        else:
            columns = [*cells.columns, *[pa.nulls(cells.num_rows, pa.float64())] * 3]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "metric", "scope", "cell", "value", "series", "mean", "median", "max"])


def _numbers(names: pa.Array) -> np.ndarray:
    return names.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _cells_at(rows: pa.RecordBatch, place: tuple[str, ...], native: str, scopes: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(id, metric, scope, cell, value, series) of samples of whole hosts. ``at_<scope>`` lists the
    targets of a sample's thread. A cell that any series of its target misses is null."""
    host = np.cumsum(_edges(rows, ("id", "metric", "hostname")))
    new = _edges(rows, ("id", "metric", "hostname", *place))
    last = np.append(_edges(rows, ("scope_id", "cell"))[1:] | new[1:], True)  # of a cell the last written
    rows, host, group = rows.filter(pa.array(last)), host[last], np.cumsum(new)[last]
    ids, told = column(rows, "scope_id"), column(rows, "scope_id").is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    cell, how = column(rows, "cell"), column(rows, "how").to_numpy()
    cell_code = cell.dictionary_encode(null_encoding="encode").indices.to_numpy()
    value = column(rows, "value")
    there = pc.and_(value.is_valid(), column(rows, "seq").is_valid()).to_numpy(zero_copy_only=False)
    value = value.fill_null(0.0).to_numpy()
    for number, scope in enumerate(scopes):
        if scope == native:
            at, out, known = np.arange(rows.num_rows), value, there
            series = np.zeros(len(at), np.int32)
            named = np.flatnonzero(told)
            series[named[np.unique(_codes(host[named], ids[named]), return_index=True)[1]]] = 1
        else:
            if scope == "node":
                row, target = np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            else:
                lists = column(rows, f"at_{scope}")
                row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy())
                target = lists.flatten().to_numpy()
            if not len(row):
                continue
            base = _codes(group[row], target)
            threads = np.flatnonzero(told[row])
            one = np.unique(_codes(base[threads], ids[row][threads]), return_index=True)[1]
            size = np.bincount(base[threads][one], minlength=base.max() + 1)
            if ((how[row] == LONE) & (size[base] > 1)).any():
                raise ValueError(NO_AGGREGATION)
            _, first, cells = np.unique(_codes(base, cell_code[row]), return_index=True, return_inverse=True)
            at, size = row[first], size[base[first]]
            out = np.bincount(cells, np.where(there, value, 0.0)[row], len(first))
            count = np.bincount(cells, there[row], len(first))
            known = (count == size) & (count > 0)
            out = np.where(how[at] == AVG, out / np.maximum(size, 1), out)
            series = np.zeros(len(at), np.int32)
            series[np.unique(_codes(host[at], target[first]), return_index=True)[1]] = 1
        where = pa.array(at)
        columns = [column(rows, "id").take(where), column(rows, "metric").take(where), pa.array(np.full(len(at), number, np.int32)), cell.take(where), pa.array(out, mask=~known), pa.array(series)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "metric", "scope", "cell", "value", "series"])


def cell_stats(batches: Iterator[pa.RecordBatch], scopes: tuple[str, ...], least: int) -> Iterator[pa.RecordBatch]:
    """(id, metric, scope, cell, min, mean, median, max) of the rows of ``cells_at`` sorted by
    id, metric, scope, cell and value; of jobs with ``least`` series of a metric and scope."""
    ready: list[pa.RecordBatch] = []

    def cells() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = column(batch, "series").is_null()
            ready.append(batch.filter(folded).drop_columns(["series"]))
            yield batch.filter(pc.invert(folded))

    def named(rows: pa.RecordBatch) -> pa.RecordBatch:
        scope = pa.array(scopes).take(column(rows, "scope"))
        return pa.RecordBatch.from_arrays([*rows.columns[:2], scope, *rows.columns[3:8]], names=["id", "metric", "scope", "cell", "min", "mean", "median", "max"])

    def stats() -> Iterator[pa.RecordBatch]:
        for rows in _closed(cells(), ("id", "metric", "scope", "cell")):
            yield _fold(rows) if rows.num_rows else rows

    for rows in _closed(stats(), ("id", "metric", "scope")):
        while ready:
            yield named(ready.pop())
        if rows.num_rows:
            yield named(_enough(rows, least))
    for rows in ready:
        yield named(rows)


def _enough(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    group = np.cumsum(_edges(rows, ("id", "metric", "scope"))) - 1
    return rows.filter(pa.array(np.bincount(group, column(rows, "series").to_numpy())[group] >= least))


def _fold(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Statistics of whole cells, sorted by value; nulls come first, and NaN last."""
    first = np.flatnonzero(_edges(rows, ("id", "metric", "scope", "cell")))
    end = np.append(first[1:], rows.num_rows)
    value = column(rows, "value")
    there = value.is_valid().to_numpy(zero_copy_only=False)
    value = value.fill_null(0.0).to_numpy()
    count = np.add.reduceat(there, first, dtype=np.int64)
    none = count == 0
    low = np.where(none, first, end - count)
    mean = np.add.reduceat(value, first) / np.maximum(count, 1)
    median = 0.5 * value[low + np.maximum(count - 1, 0) // 2] + 0.5 * value[np.where(none, first, low + count // 2)]
    stats = [pa.array(x, mask=none) for x in (value[low], mean, median, value[end - 1])]
    head = [column(rows, k).take(pa.array(first)) for k in ("id", "metric", "scope", "cell")]
    series = pa.array(np.add.reduceat(column(rows, "series").to_numpy(), first, dtype=np.int64))
    return pa.RecordBatch.from_arrays([*head, *stats, series], names=["id", "metric", "scope", "cell", "min", "mean", "median", "max", "series"])
