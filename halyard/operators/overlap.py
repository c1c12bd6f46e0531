"""Pairs of jobs that overlap in time on a host, and samples inside jobs: one pass along
rows sorted by host and time, one batch and the jobs that still last in memory.

Of a sorted table the partners of a row are ranges: finished jobs that start inside it,
rows that start inside a finished job, running jobs that start before its end. So only
pairs are formed, however many jobs a host had.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from halyard.operators.scan import column

#: What a job is in a pair (bits of ``role``): it asks, it is told to others, it runs, it
#: has many hosts.
ASKS, TOLD, RUNS, MANY = 1, 2, 4, 8
#: Pairs formed at once; a row has as many partners as there are rows in memory.
PAIRS = 1 << 18


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) for the positions from low to high of each row, some rows at a time."""
    counts = np.maximum(high - low, 0)
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = counts[at:to]
        if ends[to - 1] > before:
            row = np.repeat(np.arange(at, to), n)
            yield row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _hosts(rows: pa.RecordBatch, at: tuple[str, ...]) -> np.ndarray:
    """Numbers of the hosts of rows sorted by them."""
    new = np.zeros(rows.num_rows, bool)
    for name in at:
        names = column(rows, name)
        new[1:] |= pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _with(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    if held is None or not held.num_rows:
        return batch
    return pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]


class _Rows:
    """Rows sorted by host and start, as arrays; ``group`` numbers the hosts."""

    def __init__(self, rows: pa.RecordBatch, buffer: int):
        there = lambda name: column(rows, name)
        self.group, self.ids = _hosts(rows, ("cluster", "hostname")), there("id")
        self.same = self.ids.dictionary_encode().indices.to_numpy()
        self.start, self.role = there("s").to_numpy(), there("role").to_numpy()
        self.until = there("e").to_numpy() - buffer  # partners start before
        times = np.unique(np.concatenate([self.start, self.until]))
        self.first = self.group * (len(times) + 1)
        self.begins, self.ends = (self.first + np.searchsorted(times, t) for t in (self.start, self.until))
        self._index(there("before"))

    def _index(self, before: pa.ListArray) -> None:
        """The hosts before that several rows of a group name: only these tell of a
        pair that met before."""
        size = pc.list_value_length(before).fill_null(0).to_numpy()
        row, name = np.repeat(np.arange(len(size)), size), before.flatten().dictionary_encode().indices.to_numpy()
        _, code, times = np.unique(self.group[row] * (len(name) + 1) + name, return_inverse=True, return_counts=True)
        kept = times[code] > 1
        self.code, self.codes = code[kept], len(times) + 1
        self.size = np.bincount(row[kept], minlength=len(size))
        self.at = np.cumsum(self.size) - self.size
        self.named = np.sort(row[kept] * self.codes + self.code)

    def met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        met = np.zeros(len(i), bool)
        asked = np.flatnonzero((self.size[i] > 0) & (self.size[j] > 0))
        low = self.at[i[asked]]
        for row, position in _ranges(low, low + self.size[i[asked]]):
            wanted = j[asked[row]] * self.codes + self.code[position]
            found = np.minimum(np.searchsorted(self.named, wanted), len(self.named) - 1)
            met[asked[row[self.named[found] == wanted]]] = True
        return met

    def meet(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of asking rows and told ones (ascending row numbers)."""
        past, live = b[self.role[b] & RUNS == 0], b[self.role[b] & RUNS > 0]
        find = np.searchsorted
        for row, at in _ranges(find(self.begins[past], self.begins[a]), find(self.begins[past], self.ends[a])):
            i, j = a[row], past[at]
            yield from self._pairs(i, j, self.until[j] > self.start[i])
        for row, at in _ranges(find(self.begins[a], self.begins[past], "right"), find(self.begins[a], self.ends[past])):
            i, j = a[at], past[row]
            yield from self._pairs(i, j, self.start[j] < self.until[i])
        for row, at in _ranges(find(self.begins[live], self.first[a]), find(self.begins[live], self.ends[a], "right")):
            yield from self._pairs(a[row], live[at], True)

    def _pairs(self, i: np.ndarray, j: np.ndarray, told: np.ndarray | bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kept = told & (self.same[i] != self.same[j])
        yield i[kept], j[kept]

    def lasting(self) -> np.ndarray:
        """Rows of the last host that rows after these may still meet."""
        last = self.start[-1]
        asks, runs = self.role & ASKS > 0, self.role & RUNS > 0
        return (self.group == self.group[-1]) & ((asks & (self.until >= last)) | (self.role & TOLD > 0) & (runs | (self.until > last)))


def overlapping(batches: Iterator[pa.RecordBatch], buffer: int, many: bool) -> Iterator[pa.RecordBatch]:
    """(id, other) of rows (cluster, hostname, id, s, e, role, before) sorted by cluster,
    hostname and s. ``before``: the job's hosts before this one; a pair that met on one of
    them is left out. ``many``: instead the pairs of which a job has many hosts, at each host."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        old = held.num_rows if held is not None else 0
        rows = _with(held, batch)
        r = _Rows(rows, buffer)
        crowd = r.role & MANY > 0
        asks, told, fresh = r.role & ASKS > 0, r.role & TOLD > 0, np.arange(rows.num_rows) >= old
        sides = [(crowd, True), (~crowd, crowd)] if many else [(~crowd, ~crowd)]
        for mine, theirs in sides:
            for a, b in ((asks & mine, told & theirs & fresh), (asks & mine & fresh, told & theirs & ~fresh)):
                for i, j in r.meet(np.flatnonzero(a), np.flatnonzero(b)):
                    if not many:
                        fresh_pair = ~r.met_before(i, j)
                        i, j = i[fresh_pair], j[fresh_pair]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([r.ids.take(pa.array(i)), r.ids.take(pa.array(j))], names=["id", "other"])
        held = rows.filter(pa.array(r.lasting()))


def inside(batches: Iterator[pa.RecordBatch], at: tuple[str, ...], of_job: tuple[str, ...], of_sample: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Samples and the jobs that they lie in, of rows sorted by host (``at``), jobs first, and
    ``_time``: a job's start, a sample's time. ``_end``: a job's end, null for samples."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _with(held, batch)
        host, time, end = _hosts(rows, at), column(rows, "_time").to_numpy(), column(rows, "_end")
        job = end.is_valid().to_numpy(zero_copy_only=False)
        end = end.fill_null(0).to_numpy()
        jobs, samples = np.flatnonzero(job), np.flatnonzero(~job)
        times = np.unique(time[samples])
        place = host * (len(times) + 1)
        spot = place[samples] + np.searchsorted(times, time[samples])
        low, high = (np.searchsorted(spot, place[jobs] + np.searchsorted(times, t[jobs])) for t in (time, end))
        for row, position in _ranges(low, high):
            i, j = pa.array(jobs[row]), pa.array(samples[position])
            columns = [*(column(rows, c).take(j) for c in (*at, *of_sample)), *(column(rows, c).take(i) for c in of_job)]
            yield pa.RecordBatch.from_arrays(columns, names=[*at, *of_sample, *of_job])
        open_ = job & (host == host[-1])
        held = rows.filter(pa.array(open_ if job[-1] else open_ & (end > time[-1])))
