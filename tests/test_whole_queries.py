"""Queries over whole tables against brute force."""

import __spark_entry__ as entry
from halyard.fixtures import NOW, view


def test_concurrent_jobs_all(spark, sf):
    """Brute force over all jobs; most of them started before June 2000."""
    jobs = {r.id: r for r in view(spark, sf, "jobs").collect()}
    hosts = {}
    for r in view(spark, sf, "job_hosts").collect():
        hosts.setdefault(r.hostname, []).append(jobs[r.id])
    end = lambda j: NOW if j.job_state == "running" else j.start_time + j.duration
    want = set()
    for on in hosts.values():
        for a in on:
            if a.shared == "none" or end(a) - a.start_time <= 600:
                continue
            for b in on:
                if a.id == b.id or a.cluster != b.cluster:
                    continue
                late = b.start_time <= end(a) - 200 if b.job_state == "running" else b.start_time < end(a) - 200 and end(b) > a.start_time + 200
                if late:
                    want.add((a.id, b.id))
    got = [tuple(r) for r in entry.queries()["j5_concurrent_jobs_all"](spark, sf).select("id", "other").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(jobs[a].start_time <= 960000000 for a, _ in got)
    assert entry.queries()["j5_concurrent_jobs"](spark, sf).count() == len(got)


def test_scheduler_state_all(spark, sf):
    seen = {}
    for r in view(spark, sf, "node_states").collect():
        seen.setdefault(r.node_id, set()).add(r.node_state)

    def first(s):
        if s >= {"idle", "down"} and not s & {"allocated", "reserved"}:
            return "down"
        return next(x for x in ("allocated", "reserved", "idle", "down", "mixed") if x in s)

    got = {r.node_id: r.state for r in entry.queries()["c15_scheduler_state_all"](spark, sf).collect()}
    assert got == {node: first(s) for node, s in seen.items()}
    assert got == {r.node_id: r.state for r in entry.queries()["c15_scheduler_state"](spark, sf).collect()}


def test_order_jobs_all(spark, sf):
    """All jobs, and in order."""
    jobs = view(spark, sf, "jobs").collect()
    want = sorted(((r.id, r.start_time) for r in jobs), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in entry.queries()["x1_order_by_column_all"](spark, sf).collect()] == want
    foot = sorted(((r.id, r.flops_any_avg) for r in jobs if r.flops_any_avg is not None), key=lambda r: (r[1], r[0]))
    assert [tuple(r) for r in entry.queries()["x1_order_by_footprint_all"](spark, sf).collect()] == foot
    print("rows", len(want), len(foot))
    assert len(want) > 50 and len(foot) > 50
