"""Appends that can be repeated: a batch is staged, moved in by rename, then marked.

A batch has an id of the caller's choice. Its files carry the id in their names, and
``_batches/<id>`` under the table says that it is whole. A run that died before its
mark leaves files that the next run of the batch removes first, so rows never double.
Folders that begin with an underscore are no data to Spark's readers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _listed(fs, at) -> Iterator[object]:
    if fs.exists(at):
        found = fs.listFiles(at, True)
        while found.hasNext():
            yield found.next().getPath()


def _text(mark: dict) -> str:
    return json.dumps(mark)


def committed(spark: SparkSession, target: str) -> list[dict]:
    """The marks of the table's batches: a small document each."""
    _, fs, at = _files(spark, f"{target}/_batches")
    if not fs.exists(at):
        return []
    return [json.loads(r.value) for r in spark.read.text(f"{target}/_batches", wholetext=True).collect()]


def clear_batch(spark: SparkSession, target: str, batch: str) -> bool:
    """Removes what a dead run of the batch left; False if the batch is whole."""
    jvm, fs, at = _files(spark, target)
    Path = jvm.org.apache.hadoop.fs.Path  # noqa: N806
    if fs.exists(Path(f"{target}/_batches/{batch}")):
        return False
    fs.delete(Path(f"{target}/_staging/{batch}"), True)
    for path in _listed(fs, at):
        if path.getName().startswith(f"batch-{batch}-"):
            fs.delete(path, False)
    return True


def append_batch(df: DataFrame, target: str, batch: str, partition_by: tuple[str, ...] = (), mark: dict | None = None) -> bool:
    """Appends ``df`` as Parquet unless the batch is whole already. ``df`` must not read
    files of this batch: ``clear_batch`` first, then plan."""
    spark = df.sparkSession
    if not clear_batch(spark, target, batch):
        return False
    jvm, fs, _ = _files(spark, target)
    Path = jvm.org.apache.hadoop.fs.Path  # noqa: N806
    staging = f"{target}/_staging/{batch}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(staging)
    root = fs.makeQualified(Path(staging)).toString()
    for path in list(_listed(fs, Path(staging))):
        inner = path.toString().removeprefix(root).strip("/")
        folder, _, name = inner.rpartition("/")
        if name.startswith("part-"):
            to = Path(f"{target}/{folder}" if folder else target)
            fs.mkdirs(to)
            if not fs.rename(path, Path(to, f"batch-{batch}-{name}")):
                raise OSError(f"cannot move {inner} of batch {batch}")
    fs.delete(Path(staging), True)
    out = fs.create(Path(f"{target}/_batches/{batch}.tmp"), True)
    out.write(bytearray(_text({"batch": batch, **(mark or {})}).encode()))
    out.close()
    if not fs.rename(Path(f"{target}/_batches/{batch}.tmp"), Path(f"{target}/_batches/{batch}")):
        raise OSError(f"cannot mark batch {batch}")
    return True
