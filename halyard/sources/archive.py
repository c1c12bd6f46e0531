"""Job archive: JSON tree and Parquet, both ways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard import schemas
from halyard.sources.job_tree import read_packed, write_documents

#: Document field -> column (fixed values).
NAMES = {
    "jobId": "job_id", "cluster": "cluster", "subCluster": "subcluster", "user": "hpc_user", "project": "project", "partition": "cluster_partition",
    "shared": "shared", "jobState": "job_state", "arrayJobId": "array_job_id", "smt": "smt", "startTime": "start_time", "duration": "duration",
    "walltime": "walltime", "numNodes": "num_nodes", "numHwthreads": "num_hwthreads", "numAcc": "num_acc", "energy": "energy", "resources": "resources",
    "statistics": "statistics", "tags": "tags", "metaData": "meta_data", "footprint": "footprint", "energyFootprint": "energy_footprint",
}
SORT = ("subcluster", "project", "start_time")


def _tree(spark: SparkSession, path: str, name: str, packed: bool = False) -> DataFrame:
    """(value, file) of the documents of a name; a ``*`` at its end stands for any rest."""
    if packed:
        named = F.col("name").startswith(name[:-1]) if name.endswith("*") else F.col("name") == name
        return read_packed(spark, path).where(named).select(F.col("body").alias("value"), F.concat_ws("/", "folder", "name").alias("file"))
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
    return rows.select("value", F.col("_metadata.file_path").alias("file"))


def read_job_archive(spark: SparkSession, path: str, with_data: bool = False, packed: bool = False) -> DataFrame:
    """Jobs of a ``<cluster>/<id/1000>/<id%1000>/<start>/meta.json`` tree, or of its
    ``packed`` rows; unreadable documents are left out. ``with_data`` adds the parsed
    series document."""
    parsed = _tree(spark, path, "meta.json", packed).select(F.from_json("value", f"struct<{_struct(schemas.JOB_META)}>").alias("j"), "file")
    jobs = parsed.where(F.col("j.jobId").isNotNull() & F.col("j.cluster").isNotNull() & F.col("j.startTime").isNotNull())
    out = jobs.select(*[F.col(f"j.{k}").alias(v) for k, v in NAMES.items()], F.regexp_replace("file", r"/meta\.json$", "").alias("_folder"))
    out = out.withColumn("duration", F.coalesce("duration", F.lit(0).cast("long")))
    if with_data:
        data = _tree(spark, path, "data.json*", packed).select(F.from_json("value", schemas.JOB_DATA).alias("data"), F.regexp_replace("file", r"/data\.json(\.gz)?$", "").alias("_folder"))
        out = out.join(data, "_folder", "left")
    return out.drop("_folder")


def _struct(ddl: str) -> str:
    """``a int, b string`` as the inside of a struct type."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            out.append(f"{name}:{kind}")
        else:
            out[-1] += ", " + part
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def rejected_documents(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Files of the tree that are no job document."""
    parsed = _tree(spark, path, "meta.json", packed).select(F.from_json("value", f"struct<{_struct(schemas.JOB_META)}>").alias("j"), "file")
    return parsed.where(F.col("j.jobId").isNull() | F.col("j.cluster").isNull() | F.col("j.startTime").isNull()).select("file")


def job_data_rows(jobs: DataFrame) -> DataFrame:
    """The series document as rows: job_id, metric, scope, hostname, scope_id, ts, value."""
    metric = jobs.select("job_id", "start_time", F.explode("data").alias("metric", "scopes"))
    scope = metric.select("job_id", "start_time", "metric", F.explode("scopes").alias("scope", "m"))
    series = scope.select("job_id", "start_time", "metric", "scope", F.col("m.timestep").alias("step"), F.explode("m.series").alias("s"))
    rows = series.select("job_id", "metric", "scope", F.col("s.hostname").alias("hostname"), F.col("s.id").alias("scope_id"), "start_time", "step", F.posexplode("s.data").alias("k", "value"))
    return rows.select("job_id", "metric", "scope", "hostname", "scope_id", (F.col("start_time") + F.col("k") * F.col("step")).alias("ts"), "value")


def row_bytes(df: DataFrame) -> Column:
    """Plain bytes of a row: texts as long as they are, nested values as JSON, eight bytes
    for the rest and one a column. Encoded and compressed it is hardly ever more."""
    size = F.lit(len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            column, kind = F.to_json(column), "string"
        size += F.coalesce(F.octet_length(column), F.lit(0)) if kind in ("string", "binary") else F.lit(8)
    return size


def write_rolled(df: DataFrame, path: str, order: Sequence[str], time: str, span: int, max_bytes: int) -> None:
    """By cluster, a new file wherever the running bytes of a cluster in order of ``time``
    pass a multiple of ``max_bytes``; a file has one row more than that at most.

    Only the bytes of each (cluster, ``span`` seconds) are summed beforehand, in a table
    as small as the time is long; the running sum of rows is one window a span, so no
    cluster is one task. ``df`` is read twice. Rows without a time come first, those
    without a cluster are a cluster of their own; no rows give no files of rows.
    """
    placed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce("cluster", F.lit("")).alias("home"),
        F.coalesce(F.floor(F.col(time) / span), F.lit(-(1 << 40))).alias("slice"), F.col(time).alias("at"), row_bytes(df).alias("bytes"),
    )
    slices = placed.groupBy("home", "slice").agg(F.sum("bytes").alias("total"))
    running = F.sum("total").over(Window.partitionBy("home").orderBy("slice"))
    slices = slices.withColumn("before", running - F.col("total"))
    homes = slices.groupBy("home").agg((F.floor((F.sum("total") - 1) / max_bytes) + 1).alias("files"))
    # One row a cluster: numbered in one task.
    homes = homes.withColumn("first", F.sum("files").over(Window.orderBy("home")) - F.col("files"))
    files = homes.agg(F.sum("files")).first()[0] or 1
    # Equal times in an order that a repeated task finds again; maps cannot be hashed.
    whole = [F.to_json(f"row.`{c}`") if kind.startswith(("array", "map", "struct")) else F.col(f"row.`{c}`") for c, kind in df.dtypes]
    order_in = Window.partitionBy("home", "slice").orderBy("at", F.xxhash64(*whole)).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("bytes").over(order_in)
    number = F.col("first") + F.floor((upto - 1) / max_bytes)
    dealt = placed.join(slices.select("home", "slice", "before"), ["home", "slice"]).join(homes.select("home", "first"), "home")
    dealt = dealt.select("row", number.cast("int").alias("file")).repartitionById(int(files), F.col("file"))
    dealt.select("row.*").sortWithinPartitions("cluster", *order).write.partitionBy("cluster").option("compression", "zstd").parquet(path)


def write_job_parquet(jobs: DataFrame, path: str, max_mb: float = 512) -> None:
    """By cluster, sorted, Zstd, files of at most ``max_mb`` of plain bytes, each of
    successive start times; nested columns as JSON."""
    known = dict(jobs.dtypes)
    coded = jobs.withColumns({c: F.to_json(c) for c in schemas.JSON_COLUMNS if c in known and known[c] != "string"})
    write_rolled(coded, path, SORT, "start_time", 86400, int(max_mb * (1 << 20)))


def read_job_parquet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumns({c: F.from_json(F.col(c).cast("string"), kind) for c, kind in schemas.JSON_COLUMNS.items() if c in rows.columns})


def write_job_json(jobs: DataFrame, path: str) -> None:
    """One document a row, in lines, by cluster."""
    back = {v: k for k, v in NAMES.items() if v in jobs.columns}
    jobs.select(*[F.col(v).alias(k) for v, k in back.items()], F.col("cluster").alias("_cluster")).write.partitionBy("_cluster").json(path)


def read_job_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.JOB_META).json(path)
    return rows.select(*[F.col(k).alias(v) for k, v in NAMES.items()])


def job_documents(jobs: DataFrame) -> DataFrame:
    """(folder, name, body) of jobs' documents; a job without a place has no folder."""
    back = {v: k for k, v in NAMES.items() if v in jobs.columns}
    number = F.col("job_id")
    folder = F.concat_ws("/", "cluster", F.floor(number / 1000).cast("string"), F.lpad((number % 1000).cast("string"), 3, "0"), F.col("start_time").cast("string"))
    placed = F.col("cluster").isNotNull() & number.isNotNull() & F.col("start_time").isNotNull()
    meta = F.struct(F.lit("meta.json").alias("name"), F.to_json(F.struct(*[F.col(v).alias(k) for v, k in back.items()])).alias("body"))
    parts = [meta, F.struct(F.lit("data.json").alias("name"), F.to_json("data").alias("body"))] if "data" in jobs.columns else [meta]
    rows = jobs.select(F.when(placed, folder).alias("folder"), F.explode(F.array(*parts)).alias("d")).select("folder", "d.*")
    return rows.where("name = 'meta.json' OR body IS NOT NULL")


def write_job_tree(jobs: DataFrame, path: str) -> dict[str, int]:
    """Jobs to a ``<cluster>/<id/1000>/<id%1000>/<start>/meta.json`` tree, and their
    parsed series (column ``data``, if there) to ``data.json`` beside it. Jobs without
    cluster, id or start have no place: they count as failed."""
    return write_documents(job_documents(jobs), path)


def convert_archive(spark: SparkSession, source: str, target: str, fmt: str) -> DataFrame:
    """A JSON tree to Parquet (``parquet``), or Parquet to JSON lines (``json``) or to a
    tree (``tree``): one row with the counts."""
    count = F.count(F.lit(1)).alias("converted")
    if fmt == "parquet":
        jobs = read_job_archive(spark, source)
        write_job_parquet(jobs, target)
        return jobs.agg(count).crossJoin(rejected_documents(spark, source).agg(F.count(F.lit(1)).alias("failed")))
    jobs = read_job_parquet(spark, source)
    if fmt == "json":
        placed = F.col("job_id").isNotNull() & F.col("cluster").isNotNull() & F.col("start_time").isNotNull()
        write_job_json(jobs.where(placed), target)
        return jobs.agg(F.count_if(placed).alias("converted"), F.count_if(~placed).alias("failed"))
    if fmt == "tree":
        counts = write_job_tree(jobs, target)
        return spark.createDataFrame([(counts["converted"], counts["failed"])], "converted long, failed long")
    raise ValueError(f"unknown format {fmt}")


def import_archive(spark: SparkSession, source: str, target: str, batch: str = "import") -> DataFrame:
    """Appends a JSON tree's jobs that the Parquet target has not: the counts. The new
    rows are written once and moved in as a batch, so a run that died can be repeated
    under its name; under the name of a whole batch nothing is left to import, and the
    next free number is taken."""
    from halyard.operators.retention import import_jobs
    from halyard.scratch import scratch_path
    from halyard.sources.commits import append_batch, clear_batch, committed

    whole = {m["batch"] for m in committed(spark, target)}
    name = next(n for n in (batch, *(f"{batch}.{k}" for k in range(1, len(whole) + 2))) if n not in whole)
    clear_batch(spark, target, name)
    jobs = read_job_archive(spark, source)
    fresh = import_jobs(jobs, read_job_parquet(spark, target))
    known = dict(fresh.dtypes)
    coded = fresh.withColumns({c: F.to_json(c) for c in schemas.JSON_COLUMNS if c in known})
    held = scratch_path(spark, "import")  # the target is read here, before anything is added to it
    coded.write.parquet(held)
    coded = spark.read.schema(coded.schema).parquet(held)
    imported, total = coded.count(), jobs.count()
    failed = rejected_documents(spark, source).count()
    if imported:
        append_batch(coded.repartition("cluster").sortWithinPartitions("cluster", *SORT), target, name, ("cluster",), {"rows": imported})
    return spark.createDataFrame([(imported, total - imported, failed)], "imported long, skipped long, failed long")


def copy_jobs(jobs: DataFrame, job_tags: DataFrame, tags: DataFrame, target: str, cutoff: int, omit: str = "none") -> int:
    """Copies jobs that started since the last copy, up to ``cutoff``, to a Parquet
    archive; the rows copied. The marker is the archive's own: the greatest cutoff of
    its whole batches. A run that died before its mark is repeated with the same rows."""
    from halyard.operators.retention import retain_copy
    from halyard.sources.commits import append_batch, clear_batch, committed

    spark = jobs.sparkSession
    marker = max((m["cutoff"] for m in committed(spark, target) if "cutoff" in m), default=0)
    if cutoff <= marker:
        return 0
    clear_batch(spark, target, f"copy-{marker}")
    rows, upto = retain_copy(jobs, marker, cutoff, job_tags, tags, omit)
    known = dict(rows.dtypes)
    coded = rows.withColumns({c: F.to_json(c) for c in schemas.JSON_COLUMNS if c in known and known[c] != "string"})
    counted = rows.count()
    append_batch(coded, target, f"copy-{marker}", ("cluster",), {"cutoff": upto, "rows": counted})
    return counted


def load_archive(spark: SparkSession, path: str, config: DataFrame, clusters: list[str], node_lists: DataFrame, packed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs, tags, links, rejects) rebuilt from a JSON tree, or its packed rows: footprints and energy
    from the statistics, subclusters assigned, rows checked, tags once a (type, name)."""
    from halyard.operators.energy import energy, footprint
    from halyard.operators.joins import assign_subcluster
    from halyard.operators.rules import sanity_check, split_checked

    jobs = read_job_archive(spark, path, packed=packed).withColumn("id", F.xxhash64("job_id", "cluster", "start_time"))
    jobs = assign_subcluster(jobs.withColumn("first_host", F.try_element_at("resources", F.lit(1))["hostname"]), node_lists)
    stats = jobs.select("id", "cluster", F.col("assigned").alias("subcluster"), F.explode("statistics").alias("metric", "s")).select("id", "cluster", "subcluster", "metric", "s.avg", "s.min", "s.max")
    hosted = jobs.drop("footprint", "energy_footprint", "energy", "statistics").join(footprint(stats, config), "id", "left").join(energy(jobs, stats, config), "id", "left")
    for c in ("num_acc", "num_hwthreads"):
        hosted = hosted.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    good, rejects = split_checked(sanity_check(hosted, clusters))
    rows = good.select("id", F.explode("tags").alias("t")).select("id", F.col("t.type").alias("tag_type"), F.col("t.name").alias("tag_name"), F.coalesce("t.scope", F.lit("global")).alias("tag_scope"))
    key = F.concat_ws(":", "tag_type", "tag_name").alias("tag_id")
    tags = rows.select(key, "tag_type", "tag_name", "tag_scope").dropDuplicates(["tag_type", "tag_name"])
    links = rows.select(F.col("id").alias("job_id"), key).distinct()
    return good.drop("tags"), tags, links, rejects


def write_node_state_parquet(states: DataFrame, path: str, max_mb: float = 128) -> None:
    """By cluster, sorted by host and time in files of at most ``max_mb`` of plain bytes."""
    write_rolled(states, path, ("hostname", "time_stamp"), "time_stamp", 3600, int(max_mb * (1 << 20)))


def export_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, with a header."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
