"""Repair of conversations: the chart against all cuts and against a forward search."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import reduce

from pyspark.sql import functions as F

from halyard.llm.conversations import Chart, best, closed, combine, damage, parse_conversations, repair_digests, repaired_rows, row_cell

NAME = {"u": "user", "a": "assistant"}
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def every_cut(cells):
    """The chart of all spans and all cuts."""
    n, chart = len(cells), {(i, i + 1): c for i, c in enumerate(cells)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            options = [combine(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
            whole = reduce(lambda a, b: {z: min(c[z] for c in (a, b) if z in c) for z in {**a, **b}}, options)
            chart[i, i + size] = closed(whole)
    return chart[0, n]


def test_one_cut_is_enough():
    rng = random.Random(3)
    for _ in range(150):
        cells = [row_cell(rng.choice("suaxs"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 12))]
        chart = Chart()
        for c in cells:
            chart.add(c)
        assert chart.cell() == every_cut(cells)
    assert best(None) == (0, "")


def plain(rows):
    """Damaged rows by conversation, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    return out


def search(rows, faults):
    """Cheapest repair by a walk over (row, last initial)."""

    def insert(states):
        for _ in range(3):
            for last, (cost, audit, made) in list(states.items()):
                for c in "ua":
                    if c in NEXT[last]:
                        option = (cost + 2, audit + "I", made + (NAME[c] + ":",))
                        states[c] = min(states.get(c, option), option, key=lambda v: v[:2])
        return states

    states = insert({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def put(last, *option):
            after[last] = min(after.get(last, option), option, key=lambda v: v[:2])  # noqa: B023

        for last, (cost, audit, made) in states.items():
            put(last, cost + 3, audit + "D", made)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[0] in NEXT[last]:
                    put(role[0], cost + more, audit + "K", made + (f"{role}:{text}",))
                for c in "ua":
                    if c in NEXT[last]:
                        put(c, cost + 2 + more, audit + "R", made + (f"{NAME[c]}:{text}",))
        states = insert(after)
    return min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])


def brute(rows):
    out = {}
    for conv, own in plain(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = search(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def run(frame):
    rows = damage(frame)
    found = repair_digests(repaired_rows(rows, parse_conversations(rows), frame)).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(out) == len(found)
    return out


def test_repairs(spark):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "u", "ü"], [None, "", "a.", "b", "c! ", "d?\n", "e .x", "\x0b", "z" * 5000]
    rows = [(rng.choice([1, 2, 3, None, 2**60 + 1, 2**60 + 2]), rng.choice([None, 2**60, 2**60 + 1, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(77, k, "user" if k % 2 else "assistant", "same.") for k in range(200)] + [(78, 5, "user", "again.")] * 40
    rows += [(80 + k // 9, k % 9, rng.choice(["user", "assistant", "assistant"]), f"t{k}{rng.choice('. ')}") for k in range(900)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert run(frame) == brute(rows)
    extra = frame.withColumn("part", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("Audit", F.lit(2))
    assert run(extra) == brute(rows)


def test_rows_come_whole(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello."), (1, 1, "user", "again."), (1, 2, "tool", "x.")], "conv_id long, turn long, role string, text string")
    report = parse_conversations(rows)
    got = [(r.place, r.role, r.text, r.edit) for r in repaired_rows(rows, report).collect()]
    assert got == [(-1, None, "KIKR", None), (0, "user", "hello.", "K"), (1, "assistant", "", "I"), (2, "user", "again.", "K"), (3, "assistant", "x.", "R")]
    assert report.collect()[0]["cost"] == 4


def test_empty(spark):
    assert run(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}
