"""Unit tables of operators, by meaning; SQL equivalence is in test_oracle.py."""

import math
import json
import random

import pytest
from pyspark.sql import functions as F

from halyard.functions import scalars as S
from halyard.operators import filters as P
from halyard.operators import joins as J
from halyard.operators import lists as X
from halyard.operators import retention as E
from halyard.operators import rules as R
from halyard.operators import stats as A
from halyard.operators import timeseries as T


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "text,hosts",
    [("w11[27-29,49],host1", ["w1127", "w1128", "w1129", "w1149", "host1"]), ("a[008-011]", ["a008", "a009", "a010", "a011"]), ("x", ["x"]), ("n[9-11]", ["n9", "n10", "n11"]), ("p[1]-ib,q", ["p1", "q"])],
)
def test_node_list(spark, text, hosts):
    assert one(spark, S.expand_node_list(F.lit(text))) == hosts


@pytest.mark.parametrize("avg,prefix,factor,name", [(2.9e9, "", 1e-9, "G"), (391.0, "G", 1.0, "G"), (3.9e11, "", 1e-9, "G"), (0.5, "G", 1e3, "M"), (0.0, "M", 1.0, "M"), (-5.0, "K", 1.0, "K"), (1000.0, "M", 1.0, "M")])
def test_normalize_unit(spark, avg, prefix, factor, name):
    f, p = S.normalize_unit(F.col("v"), F.lit(prefix))
    assert one(spark, f, v=avg) == pytest.approx(factor) and one(spark, p, v=avg) == name


def test_scheduler_state(spark):
    state = lambda *s: one(spark, S.scheduler_state(F.array(*map(F.lit, s))))
    assert [state("IDLE", "Down"), state("mixed", "allocated"), state("x"), state("Reserved", "idle"), state("mixed")] == ["down", "allocated", "unknown", "reserved", "mixed"]


def test_component(spark):
    df = spark.createDataFrame([("socket0",), ("memoryDomain12",), ("cpu7",), ("core",), ("corex",), ("accelerator0:1",)], "c string")
    scope, number = S.split_component(F.col("c"))
    assert [tuple(r) for r in df.select(scope, number).collect()] == [("socket", "0"), ("memoryDomain", "12"), ("hwthread", "7"), ("core", ""), ("corex", ""), ("accelerator", "0:1")]


def test_filters_guard(spark):
    df = spark.createDataFrame([("u1",), ("U2",), ("v%",)], "hpc_user string")
    hit = lambda f: [r.hpc_user for r in df.where(f.on(F.col("hpc_user"))).collect()]
    assert hit(P.StringFilter(starts_with="u")) == ["u1", "U2"]
    assert hit(P.StringFilter(contains="%")) == ["u1", "U2", "v%"]
    assert P.Range(0, 0).on(F.col("x")) is None and P.TimeRange(named="never").on(F.col("x"), 5) is None
    with pytest.raises(PermissionError):
        P.secure_jobs(df, P.User("x"))
    with pytest.raises(ValueError):
        X.page(df, 1, 0)
    assert X.snake_case("numHWThreads") == "num_hwthreads" or X.snake_case("startTime") == "start_time"


def test_scope_rules():
    assert T.result_scope("hwthread", "core") == "core" and T.result_scope("socket", "hwthread") == "socket"
    assert T.result_scope("accelerator", "accelerator") == "accelerator" and T.result_scope("accelerator", "core") is None and T.result_scope("accelerator", "node") == "node"
    with pytest.raises(ValueError):
        T.result_scope("core", "memory_domain")


TOPOLOGY = [(0, 0, 0, 0), (1, 0, 0, 0), (2, 1, 1, 1), (3, 1, 1, 1)]


def cells(spark, values):
    rows = [("c", "h", "hwthread", k, m, c, v) for (m, k, c), v in values.items()]
    return spark.createDataFrame(rows, "cluster string, hostname string, scope string, scope_id long, metric string, cell long, value double")


def test_rollup_of_rollup(spark):
    topology = spark.createDataFrame(TOPOLOGY, "hwthread int, core int, memory_domain int, socket int")
    config = spark.createDataFrame([("a", "sum"), ("b", "avg")], "metric string, aggregation string")
    rng = random.Random(1)
    base = cells(spark, {(m, k, c): float(rng.randrange(100)) for m in "ab" for k in range(4) for c in range(3)} | {("a", 1, 2): None})
    direct = T.scope_rollup(base, topology, config, "hwthread", "node")
    twice = T.scope_rollup(T.scope_rollup(base, topology, config, "hwthread", "socket"), topology, config, "socket", "node")
    table = lambda df: {(r.metric, r.cell): r.value for r in df.collect()}
    assert table(direct) == table(twice) and table(direct)["a", 2] is None
    none = spark.createDataFrame([("a", ""), ("b", "")], "metric string, aggregation string")
    with pytest.raises(Exception, match="aggregation"):
        T.scope_rollup(base, topology, none, "hwthread", "node").collect()


def test_align(spark):
    rows = [("c", "h", "node", 0, "m", ts, seq, v) for ts, seq, v in ((5, 1, 1.0), (9, 2, 2.0), (33, 3, 3.0), (31, 4, 4.0))]
    samples = spark.createDataFrame(rows, "cluster string, hostname string, scope string, scope_id long, metric string, ts long, seq long, value double")
    got = [(r.cell, r.value) for r in T.align(samples, 10).orderBy("cell").collect()]
    assert got == [(0, 2.0), (1, None), (2, None), (3, 4.0)]
    # The grid begins at 8 - 5 = 3: 12 is in the first cell, 13 in the next.
    late = samples.limit(0).union(spark.createDataFrame([("c", "h", "node", None, "m", ts, ts, float(ts)) for ts in (8, 12, 13, 32, 33)], samples.schema))
    assert [(r.cell, r.value) for r in T.align(late, 10).orderBy("cell").collect()] == [(0, 12.0), (1, 13.0), (2, 32.0), (3, 33.0)]
    padded = T.read_range(T.align(samples, 10), -20, 40, 10, pad=True).orderBy("cell").collect()
    assert [(r.cell, r.value) for r in padded][:3] == [(-2, None), (-1, None), (0, 2.0)]


def lttb_loop(points, size):
    n = len(points)
    if n <= size or size <= 2:
        return points
    every, kept = (n - 2) / (size - 2), [points[0]]
    for k in range(size - 2):
        begin, end, after = math.floor(k * every) + 1, math.floor((k + 1) * every) + 1, min(math.floor((k + 2) * every) + 1, n)
        chunk = points[end : max(after, end + 1)]
        mx, my = sum(p[0] for p in chunk) / len(chunk), sum(p[1] for p in chunk) / len(chunk)
        x0, y0 = kept[-1]
        kept.append(max(points[begin:end], key=lambda p: (abs((x0 - mx) * (p[1] - y0) - (x0 - p[0]) * (my - y0)), -p[0])))
    return [*kept, points[-1]]


@pytest.mark.parametrize("n,size", [(50, 10), (9, 10), (10, 10), (11, 10), (200, 3), (77, 20), (5, 2)])
def test_lttb(spark, n, size):
    rng = random.Random(n)
    points = [(float(x), float(rng.randrange(1000))) for x in range(n)]
    df = spark.createDataFrame([("h", int(x), y) for x, y in points], "hostname string, cell long, value double")
    got = sorted((float(r.cell), r.value) for r in T.downsample_lttb(df, size, ("hostname",)).collect())
    assert got == lttb_loop(points, size)


def test_start_guard(spark):
    starts = spark.createDataFrame([(1, 7, "c", 0), (2, 7, "c", 50_000), (3, 7, "c", 90_000), (4, 7, "d", 10)], "id long, job_id long, cluster string, start_time long")
    assert {r.id: r.accepted for r in X.duplicate_start_guard(starts).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_histogram_sums(spark):
    jobs = spark.createDataFrame([(k, "completed" if k % 2 else "running", 10 * k, 40 * k) for k in range(100)], "id long, job_state string, start_time long, duration long")
    assert A.hist_duration(jobs, "1m", 1000).agg(F.sum("jobs")).first()[0] <= 100
    assert A.hist_duration(jobs, "12h", 1000).agg(F.sum("jobs")).first()[0] == 100


def test_rule_language():
    rule = R.Rule("n", "t", ("m",), "m.avg < x && !(job.duration >= 5)", variables=(("x", "m.limits.peak * p"),))
    made = R.RuleColumns(rule, {"p": 0.5})
    assert made.sql(rule.rule) == "stats['m'].avg < (limits['m'].peak * 0.5D)  AND   NOT (`duration` >= 5)"
    for bad in ("other.avg > 1", "m.avg; drop", "os.system"):
        with pytest.raises(ValueError):
            made.sql(bad)


def test_retention_guards(spark):
    jobs = spark.createDataFrame([(1, 5)], "id long, start_time long")
    with pytest.raises(ValueError):
        E.jobs_between(jobs, 9, 9, jobs, jobs)
    meta = spark.createDataFrame([(7, 1)], "exclusive int, start_time long")
    with pytest.raises(Exception, match="invalid exclusive"):
        R.migrate_job_meta(meta).collect()


def test_concurrent_running(spark):
    jobs = spark.createDataFrame(
        [(1, "c", "completed", "multi_user", 1000, 1000), (2, "c", "running", "multi_user", 1500, 0), (3, "c", "completed", "none", 1300, 500), (4, "c", "completed", "multi_user", 1900, 500)],
        "id long, cluster string, job_state string, shared string, start_time long, duration long",
    )
    hosts = spark.createDataFrame([(k, "h") for k in (1, 2, 3, 4)], "id long, hostname string")
    got = sorted(tuple(r) for r in J.concurrent_jobs(jobs, hosts, now=9000).collect())
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (2, 4)]


def test_metric_health_ends_with_the_last_cell(spark):
    # Cells of 60 from 0 - 30: the sample at 100 lies in [90, 150), so the series ends at 150.
    samples = spark.createDataFrame([("a", 0, "m", 0), ("a", 0, "m", 100), ("b", 0, "m", 30)], "hostname string, scope_id long, metric string, ts long")
    expected = spark.createDataFrame([("m", 60)], "metric string, step long")
    health = lambda now: {r.hostname: r.health_state for r in T.metric_health(samples, expected, samples, now).collect()}
    assert health(450) == {"a": "full", "b": "failed"}
    assert health(451) == {"a": "failed", "b": "failed"}
    assert health(360) == {"a": "full", "b": "full"}


def test_like_folds_latin_capitals_alone(spark):
    df = spark.createDataFrame([("ABC",), ("abc",), ("ÄBC",), ("äbc",), (None,)], "s string")
    hits = lambda p: sorted(r.s for r in df.where(P.like(F.col("s"), p)).collect())
    assert hits("a_C") == ["ABC", "abc"]
    assert hits("Äb%") == ["ÄBC"]


def test_rule_and_pattern_files(spark, tmp_path):
    from halyard.operators import rules as R

    (tmp_path / "solver.txt").write_text("  solve[-_]run\\S\n\nmpirun +solver\n")
    (tmp_path / "blank.txt").write_text("\n")
    assert R.read_patterns(spark, str(tmp_path)) == {"solver": ["solve[-_]run\\S", "mpirun +solver"]}
    doc = {"name": "Idle", "tag": "idle", "parameters": ["least"], "metrics": ["load"], "requirements": ["job.id % 2 == 0"], "variables": [{"name": "share", "expr": "load.avg / job.cores"}], "rule": "share < least", "hint": "share {{.share}}"}
    (tmp_path / "idle.json").write_text(json.dumps(doc))
    (tmp_path / "parameters.json").write_text(json.dumps({"least": 0.5, "note": "text"}))
    rules, params = R.read_rules(spark, str(tmp_path))
    assert params == {"least": 0.5} and [r.tag for r in rules] == ["idle"]
    stats = "map<string,struct<avg:double,min:double,max:double>>"
    jobs = spark.createDataFrame([(k, 4, {"load": (avg, 0.0, 4.0)}, {}) for k, avg in ((1, 1.0), (2, 1.0), (4, 3.0))], f"id long, cores int, stats {stats}, limits {stats}")
    assert [(r.id, list(r.tags), r.message) for r in R.classify_jobs(jobs, rules, params).collect()] == [(2, ["idle"], "share 0.25")]
    (tmp_path / "parameters.json").write_text("{}")
    with pytest.raises(ValueError, match="unknown parameters least"):
        R.read_rules(spark, str(tmp_path))


def test_nearest_series(spark):
    from halyard.operators.timeseries import nearest_series

    rows = [(None, "a", "node", "m", 1), (None, "a", "core", "m", 2), ("c", "a", "core", "m", 3), ("c", "a", None, "m", 4), ("c", "b", "core", "m", 5), ("c", "b", "node", "n", 6)]
    samples = spark.createDataFrame(rows, "cluster string, hostname string, scope string, metric string, v int")
    assert sorted(r.v for r in nearest_series(samples).collect()) == [1, 3, 4, 5, 6]
    assert nearest_series(samples.limit(0)).count() == 0
