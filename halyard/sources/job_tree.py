"""A sink for the JSON tree of a job archive: one document a path.

``df.write.format("job_tree").mode("append").save(path)`` takes rows of (folder, name,
body). Each task writes a document under another name in its folder and renames it, so
a document is whole or absent, and a repeated task replaces its own. ``body`` null
counts as failed. The counts of all tasks are left in ``_counts.json`` by the commit.

A tree takes a file and its folders a document, some blocks of disk each, however small.
``pack_documents`` keeps the same documents as Parquet rows of (folder, name, body), as
the reference does in a database; readers take either.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

COUNTS = "_counts.json"


@dataclass
class Written(WriterCommitMessage):
    written: int
    failed: int


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path; a bare one is a shared folder of this machine."""
    return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)


class JobTreeWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        import uuid

        store, root = _open(self.path)
        written = failed = 0
        for row in rows:
            if row.body is None or row.folder is None:
                failed += 1
                continue
            folder = f"{root}/{row.folder}"
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/.{row.name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(row.body.encode())
            store.move(draft, f"{folder}/{row.name}")
            written += 1
        return Written(written, failed)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        told = [m for m in messages if m]
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{COUNTS}", compression=None) as out:
            out.write(json.dumps({"converted": sum(m.written for m in told), "failed": sum(m.failed for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole documents stay; writing the tree again replaces them."""


class JobTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_tree"

    def schema(self) -> str:
        return "folder string, name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> JobTreeWriter:
        return JobTreeWriter(self.options["path"])


def write_documents(documents, path: str) -> dict[str, int]:
    """Writes (folder, name, body) rows; the counts."""
    spark: SparkSession = documents.sparkSession
    spark.dataSource.register(JobTree)
    documents.select("folder", "name", "body").write.format("job_tree").mode("append").save(path)
    store, root = _open(path)
    with store.open_input_stream(f"{root}/{COUNTS}") as f:
        return json.loads(f.read())


def pack_documents(documents: DataFrame, path: str) -> None:
    """Writes (folder, name, body) rows; those without folder or body are left out."""
    rows = documents.select("folder", "name", "body").where("folder IS NOT NULL AND body IS NOT NULL")
    rows.write.option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("folder string, name string, body string").parquet(path)
