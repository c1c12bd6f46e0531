"""Application detection, classification rules, validation, tag changes."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.scalars import normalize_unit, round_half_up

#: Job states.
STATES = ("boot_fail", "cancelled", "completed", "deadline", "failed", "node_fail", "out_of_memory", "pending", "preempted", "running", "suspended", "timeout")


def _documents(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """(name without suffix, text) of configuration files, by name. Such folders
    hold a few small files, which plans are built from on the driver."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return sorted((r.name, r.value) for r in spark.read.text(pattern, wholetext=True).select(name.alias("name"), "value").collect())


def read_patterns(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Application patterns: a text file an application, a pattern a line, as it
    is (scripts are lower-cased before they are searched); blank lines are left out,
    as are files without a pattern."""
    found = {app: [line.strip() for line in text.splitlines() if line.strip()] for app, text in _documents(spark, f"{folder}/*.txt")}
    return {app: lines for app, lines in found.items() if lines}


def read_rules(spark: SparkSession, folder: str) -> tuple[list[Rule], dict[str, float]]:
    """Rules, a JSON document each, and the parameters in ``parameters.json``. A
    rule that asks for an unknown parameter is an error."""
    documents = {name: json.loads(text) for name, text in _documents(spark, f"{folder}/*.json")}
    params = {k: float(v) for k, v in documents.pop("parameters", {}).items() if isinstance(v, (int, float))}
    rules = []
    for name, doc in documents.items():
        unknown = [p for p in doc.get("parameters") or () if p not in params]
        if unknown:
            raise ValueError(f"rule {name}: unknown parameters {', '.join(unknown)}")
        variables = tuple((v["name"], v["expr"]) for v in doc.get("variables") or ())
        lists = {k: tuple(doc.get(k) or ()) for k in ("metrics", "requirements", "parameters")}
        rules.append(Rule(name=doc.get("name", name), tag=doc["tag"], rule=doc["rule"], hint=doc.get("hint", ""), variables=variables, **lists))
    return rules, params


def detect_app(jobs: DataFrame, patterns: dict[str, list[str]], script: str = "job_script") -> DataFrame:
    """(id, app): every application with a pattern in a line's part before ``#``."""
    low = F.lower(F.col(script))
    hits = [F.when(reduce(lambda a, b: a | b, [low.rlike(f"(?m)^[^#\\n]*{p}") for p in lines]), F.lit(app)) for app, lines in patterns.items()]
    found = F.filter(F.array(*hits), lambda a: a.isNotNull())
    return jobs.select("id", F.explode(found).alias("app"))


@dataclass(frozen=True)
class Rule:
    """A classification rule in its document form. Names in expressions: ``job.<column>``,
    ``<metric>.<stat>``, ``<metric>.limits.<threshold>``, parameters, variables."""

    name: str
    tag: str
    metrics: tuple[str, ...]
    rule: str
    requirements: tuple[str, ...] = ()
    variables: tuple[tuple[str, str], ...] = ()
    hint: str = ""
    parameters: tuple[str, ...] = field(default=())


class RuleColumns:
    """Turns rule expressions into columns over a job row that holds ``stats``
    (metric -> avg, min, max) and ``limits`` (metric -> thresholds) maps."""

    TOKEN = re.compile(r'"[^"]*"|[A-Za-z_][\w.]*|&&|\|\||==|!=|<=|>=|[!<>()+\-*/%]|[\d.]+|\s+')

    def __init__(self, rule: Rule, params: dict[str, float]):
        self.rule, self.params = rule, params
        self.variables: dict[str, str] = {}
        for name, text in rule.variables:
            self.variables[name] = f"({self.sql(text)})"

    def name(self, token: str) -> str:
        if token in ("true", "false"):
            return token
        if token in self.variables:
            return self.variables[token]
        if token in self.params:
            return f"{float(self.params[token])!r}D"
        head, _, rest = token.partition(".")
        if head == "job" and re.fullmatch(r"\w+", rest):
            return f"`{rest}`"
        if head in self.rule.metrics and re.fullmatch(r"avg|min|max", rest):
            return f"stats['{head}'].{rest}"
        if head in self.rule.metrics and re.fullmatch(r"limits\.\w+", rest):
            return f"limits['{head}'].{rest.removeprefix('limits.')}"
        raise ValueError(f"rule {self.rule.tag}: unknown name {token}")

    def sql(self, text: str) -> str:
        known = {"&&": " AND ", "||": " OR ", "!": " NOT ", "==": "=", "!=": "<>"}
        out, at = [], 0
        for m in self.TOKEN.finditer(text):
            if m.start() != at:
                break
            token, at = m.group(), m.end()
            if token.startswith('"'):
                out.append("'" + token[1:-1].replace("'", "\\'") + "'")
            elif re.match(r"[A-Za-z_]", token):
                out.append(self.name(token))
            else:
                out.append(known.get(token, token))
        if at != len(text):
            raise ValueError(f"rule {self.rule.tag}: cannot read {text[at:]!r}")
        return "".join(out)

    def matches(self) -> Column:
        there = [F.col("stats")[m].isNotNull() for m in self.rule.metrics]
        tests = [F.expr(self.sql(t)) for t in (*self.rule.requirements, self.rule.rule)]
        return F.coalesce(reduce(lambda a, b: a & b, [*there, *tests], F.lit(True)), F.lit(False))

    def hint(self) -> Column:
        parts = re.split(r"\{\{\s*\.([\w.]+)\s*\}\}", self.rule.hint)
        shown = [F.lit(p) if k % 2 == 0 else round_half_up(F.expr(self.name(p)).cast("double"), 2).cast("string") for k, p in enumerate(parts)]
        return F.concat(*shown)


def classify_jobs(jobs: DataFrame, rules: list[Rule], params: dict[str, float]) -> DataFrame:
    """(id, tags, message): tags of all rules that hold, in order, and their hints
    by line. ``jobs`` holds stats and limits maps."""
    made = [RuleColumns(r, params) for r in rules]
    hit = F.array(*[F.when(c.matches(), F.struct(F.lit(c.rule.tag).alias("tag"), c.hint().alias("hint"))) for c in made])
    out = jobs.select("id", F.filter(hit, lambda h: h.isNotNull()).alias("h")).where(F.size("h") > 0)
    return out.select("id", F.col("h.tag").alias("tags"), F.concat_ws("\n", "h.hint").alias("message"))


def apply_tag_changes(tags: DataFrame, job_tags: DataFrame, adds: DataFrame, removes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (tags, links). ``adds``: id, tag_type, tag_name, tag_scope (null for
    global); ``removes``: id (null: the whole tag), tag_type, tag_name."""
    names = ["tag_type", "tag_name"]
    fresh = adds.select(*names, F.coalesce("tag_scope", F.lit("global")).alias("tag_scope")).dropDuplicates(names)
    fresh = fresh.join(tags, names, "left_anti").withColumn("tag_id", F.concat_ws(":", *names))
    every = tags.select("tag_id", *names, "tag_scope").unionByName(fresh.select("tag_id", *names, "tag_scope"))
    new = adds.join(every, names).select(F.col("id").alias("job_id"), "tag_id").distinct()
    links = job_tags.select("job_id", "tag_id").unionByName(new.join(job_tags, ["job_id", "tag_id"], "left_anti"))
    gone = removes.where("id IS NULL").select(*names).distinct()
    one = removes.where("id IS NOT NULL").join(every, names).select(F.col("id").alias("job_id"), "tag_id")
    kept = every.join(gone, names, "left_anti")
    return kept, links.join(one, ["job_id", "tag_id"], "left_anti").join(kept.select("tag_id"), "tag_id", "left_semi").select("job_id", "tag_id")


def rerun_taggers(jobs: DataFrame, patterns: dict[str, list[str]], rules: list[Rule], params: dict[str, float]) -> DataFrame:
    """(id, tag_type, tag_name) of all jobs that do not run."""
    done = jobs.where("job_state <> 'running'")
    apps = detect_app(done, patterns).select("id", F.lit("app").alias("tag_type"), F.col("app").alias("tag_name"))
    classes = classify_jobs(done, rules, params).select("id", F.lit("jobClass").alias("tag_type"), F.explode("tags").alias("tag_name"))
    return apps.unionByName(classes)


def sanity_check(jobs: DataFrame, clusters: list[str]) -> DataFrame:
    """Adds ``reasons``: why a job is rejected; empty for good ones. ``jobs``
    holds assigned (its subcluster, or null) and resources."""
    size = F.size(F.coalesce("resources", F.array().cast(dict(jobs.dtypes)["resources"])))
    tests = {
        "unknown cluster": ~F.col("cluster").isin(*clusters),
        "no subcluster": F.col("assigned").isNull(),
        "invalid state": ~F.col("job_state").isin(*STATES),
        "no user": F.coalesce("hpc_user", F.lit("")) == "",
        "no resources": size == 0,
        "negative accelerators": F.col("num_acc") < 0,
        "negative hwthreads": F.col("num_hwthreads") < 0,
        "no nodes": F.col("num_nodes") < 1,
        "resources differ from nodes": size != F.col("num_nodes"),
    }
    named = F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in tests.items()])
    return jobs.withColumn("reasons", F.filter(named, lambda r: r.isNotNull()))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def normalize_job_data(series: DataFrame, keys: tuple[str, ...] = ("id", "metric", "scope")) -> DataFrame:
    """Scales values of byte and flop units by their group's mean; new prefix."""
    mean = F.avg("value").over(Window.partitionBy(*keys))
    factor, prefix = normalize_unit(mean, F.col("prefix"))
    scaled = F.col("unit").rlike(r"B/s|F/s|B")
    return series.withColumn("_f", F.when(scaled, factor).otherwise(1.0)).withColumn("_p", F.when(scaled, prefix).otherwise(F.col("prefix"))).withColumn(
        "value", F.col("value") * F.col("_f")
    ).withColumn("prefix", F.col("_p")).drop("_f", "_p")


def migrate_job_meta(meta: DataFrame) -> DataFrame:
    """Old job documents to the present form."""
    kind = F.col("exclusive")
    shared = F.when(kind == 0, "multi_user").when(kind == 1, "none").when(kind == 2, "single_user")
    shared = F.when(kind.isNull(), F.coalesce(F.col("shared"), F.lit("none")) if "shared" in meta.columns else F.lit("none")).otherwise(
        F.coalesce(shared, F.raise_error(F.concat(F.lit("invalid exclusive value "), kind.cast("string"))).cast("string"))
    )
    old = lambda name, other: F.coalesce(F.col(name), other) if name in meta.columns else other
    out = meta.withColumn("shared", shared).withColumn("submit_time", old("submit_time", F.col("start_time")))
    out = out.withColumn("energy", old("energy", F.lit(0.0))).withColumn("requested_memory", old("requested_memory", F.lit(0).cast("long")))
    #: Columns of the old form.
    deprecated = ("exclusive", "mem_used_max", "flops_any_avg", "mem_bw_avg", "load_avg", "net_bw_avg", "net_data_vol_total", "file_bw_avg", "file_data_vol_total")
    return out.drop(*deprecated)
