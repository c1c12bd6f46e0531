"""Metric samples: checkpoints, Parquet, cluster configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard import schemas
from halyard.functions.scalars import split_component
from halyard.sources.job_tree import read_packed


def write_samples_parquet(samples: DataFrame, path: str) -> None:
    """Long rows by cluster, missing values left out, hosts together and sorted."""
    rows = samples.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value").cast("float"))
    rows.repartition("cluster", "hostname").sortWithinPartitions("cluster", "hostname", "metric", "ts").write.partitionBy("cluster").option("compression", "zstd").parquet(path)


def read_samples_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("value", F.col("value").cast("double"))


def _packed_checkpoints(spark: SparkSession, path: str, from_ts: int) -> DataFrame:
    """(value, file) of the packed checkpoints to be read; names decide."""
    begin = F.regexp_extract("name", r"^([0-9]+)\.json$", 1)
    docs = read_packed(spark, path).where(begin != "").withColumn("begin", begin.cast("long"))
    last = docs.groupBy("folder").agg(F.max(F.when(F.col("begin") <= from_ts, F.col("begin"))).alias("last"))
    kept = docs.join(last, "folder").where((F.col("begin") >= from_ts) | (F.col("begin") == F.col("last")))
    return kept.select(F.col("body").alias("value"), F.concat(F.lit("/"), F.concat_ws("/", "folder", "name")).alias("file"))


def read_samples_checkpoint(spark: SparkSession, path: str, from_ts: int = 0, packed: bool = False) -> DataFrame:
    """``<cluster>/<host>/<begin>.json`` trees, or their ``packed`` rows, to samples,
    components at any depth.

    Of each host, files that a later one followed at or before ``from_ts`` hold no row of
    it: they are skipped by name, before they are opened. Of a component's path the
    first name is its scope and number, the others are joined to the number by dots. A
    file that is no checkpoint is left out."""
    named = F.regexp_extract("_metadata.file_name", r"^([0-9]+)\.json$", 1)
    tree = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    begin = F.when(named != "", named.cast("long"))
    newer = None if packed else tree.text(path, wholetext=True).where(begin >= from_ts)  # only names decide: the scan lists and skips
    if packed:
        files = _packed_checkpoints(spark, path, from_ts)
    elif from_ts > 0:
        # The last file before, one a host.
        listed = tree.format("binaryFile").load(path).select("path")
        number = F.regexp_extract("path", r"/([0-9]+)\.json$", 1)
        old = listed.where(number != "").select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), number.cast("long").alias("begin"))
        before = F.when(F.col("begin") < from_ts, F.struct("begin", "path"))
        last = old.groupBy("folder").agg(F.max(before).alias("last"), F.min("begin").alias("first"), F.max(F.col("begin") == from_ts).alias("exact"))
        kept = [r[0] for r in last.where("last IS NOT NULL AND NOT exact").select("last.path").collect()]
        files = newer.select("value", F.col("_metadata.file_path").alias("file"))
        if kept:
            files = files.unionByName(spark.read.text(kept, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")))
    else:
        files = newer.select("value", F.col("_metadata.file_path").alias("file"))
    doc = files.select(F.from_json("value", schemas.CHECKPOINT).alias("d"), F.regexp_extract("file", r"([^/]+)/[^/]+/[^/]+$", 1).alias("cluster"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("hostname"))
    level = doc.where(F.col("d").isNotNull()).select("cluster", "hostname", F.array().cast("array<string>").alias("names"), "d")
    levels = []
    while True:
        levels.append(level.select("cluster", "hostname", "names", F.explode("d.metrics").alias("metric", "b")))
        inner = level.select("cluster", "hostname", "names", F.explode("d.children").alias("name", "text"))
        level = inner.select("cluster", "hostname", F.array_append("names", F.col("name")).alias("names"), F.from_json("text", schemas.CHECKPOINT).alias("d")).where(F.col("d").isNotNull())
        if level.isEmpty():
            break
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    points = rows.select("cluster", "hostname", "names", "metric", F.col("b.start").alias("s"), F.col("b.frequency").alias("f"), F.posexplode("b.data").alias("k", "value"))
    scope, number = split_component(F.try_element_at("names", F.lit(1)))
    deeper = F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0)))
    none = F.size("names") == 0
    out = points.select(
        "cluster", "hostname", F.when(none, "node").otherwise(scope).alias("scope"), F.when(none, "").when(F.size("names") == 1, number).otherwise(F.concat_ws(".", number, deeper)).alias("scope_id"), "metric",
        (F.col("s") + F.col("k") * F.col("f")).alias("ts"), "value",
    )
    return out.where(F.col("value").isNotNull() & (F.col("ts") >= from_ts))


def read_cluster_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metric_config, topology, subclusters) of cluster documents. A subcluster's
    entry replaces all thresholds; ``remove`` drops the metric there."""
    docs = spark.read.schema(schemas.CLUSTER).option("multiLine", "true").json(path)
    subs = docs.select(F.col("name").alias("cluster"), F.explode("subClusters").alias("s"))
    subclusters = subs.select("cluster", F.col("s.name").alias("subcluster"), F.col("s.nodes").alias("nodes"), F.size("s.topology.node").alias("node_threads"))
    pick = lambda k: F.filter("m.subClusters", lambda o: o["name"] == F.col("subcluster"))[0][k]
    metrics = docs.select(F.col("name").alias("cluster"), F.explode("metricConfig").alias("m")).join(subclusters.select("cluster", "subcluster"), "cluster")
    has = F.exists(F.coalesce("m.subClusters", F.array()), lambda o: o["name"] == F.col("subcluster"))
    fields = {"peak": "peak", "normal": "normal", "caution": "caution", "alert": "alert", "footprint": "footprint", "energy": "energy"}
    empty = {"footprint": F.lit(""), "energy": F.lit("")}
    chosen = [F.coalesce(F.when(has, pick(k)).otherwise(F.col(f"m.{k}")), empty.get(k, F.lit(None))).alias(v) for k, v in fields.items()]
    config = metrics.where(~F.coalesce(F.when(has, pick("remove")), F.lit(False))).select(
        "cluster", "subcluster", F.col("m.name").alias("metric"), F.col("m.scope").alias("native_scope"), F.coalesce("m.aggregation", F.lit("")).alias("aggregation"),
        F.col("m.timestep").alias("timestep"), *chosen, F.coalesce(F.when(has, pick("lowerIsBetter")), "m.lowerIsBetter", F.lit(False)).alias("lower_is_better"),
        F.concat(F.coalesce("m.unit.prefix", F.lit("")), F.coalesce("m.unit.base", F.lit(""))).alias("unit"), F.coalesce("m.restrict", F.lit(False)).alias("restricted"),
    )

    def level(name: str, column: str) -> DataFrame:
        groups = subs.select("cluster", F.col("s.name").alias("subcluster"), F.posexplode(f"s.topology.{name}").alias(column, "threads"))
        return groups.select("cluster", "subcluster", column, F.explode("threads").alias("hwthread"))

    keys = ["cluster", "subcluster", "hwthread"]
    threads = subs.select("cluster", F.col("s.name").alias("subcluster"), F.explode("s.topology.node").alias("hwthread"))
    topology = threads
    for name, column in (("core", "core"), ("socket", "socket"), ("memoryDomain", "memory_domain")):
        topology = topology.join(level(name, column), keys, "left")
    return config, topology, subclusters


def metric_availability(config: DataFrame, staff: bool) -> DataFrame:
    """Metrics a cluster offers to a role; restricted ones are for staff."""
    rows = config if staff else config.where(~F.col("restricted"))
    return rows.groupBy("cluster").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))


def merged_config(config: DataFrame) -> DataFrame:
    """One row a metric over all subclusters: greatest thresholds and time step."""
    return config.groupBy("metric").agg(*[F.max(c).alias(c) for c in ("peak", "normal", "caution", "alert", "timestep")])
