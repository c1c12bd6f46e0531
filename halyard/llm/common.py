"""Helpers shared by the corpus operators: scratch tables, bit filters, text columns."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.scratch import scratch_path

__all__ = ["SPACE_RE", "WORD_RE", "Workspace", "bit_filter", "materialise", "maybe_in", "read_documents", "row_hash", "scratch_path", "text_or_empty", "whole_rows"]

#: White space of the corpus contracts: space and U+0009 to U+000D (fixed value).
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Bits of a filter, at every size: 16 MB is the most that one broadcasts.
FILTER_BITS = 1 << 27
#: Part of its limit that the driver's heap may take before garbage is collected between tables.
HEAP_PART = 0.4


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage: a lost executor costs the tasks it ran, not the stages before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """The intermediate tables of one call, deleted when their successors are written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch_path(spark, name)
        self.tables: dict[int, tuple[DataFrame, str]] = {}
        self.labels: dict[int, str] = {}
        self.made = 0

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and read it back, as ``materialise`` does."""
        path = f"{self.path}/{self.made:03d}-{name}"
        self.made += 1
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(back)] = back, path
        self._ease()
        return back

    def bucketed(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """One row for each value of a column that never is null, as a table dealt
        into buckets of it: joins on the column do not move the table again."""
        path = f"{self.path}/{self.made:03d}-{name}"
        label = f"halyard_{name}_{uuid.uuid4().hex}"
        self.made += 1
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.repartition(parts, column).dropDuplicates([column]).write.option("path", path)
        writer.bucketBy(parts, column).sortBy(column).saveAsTable(label)
        back = self.spark.table(label)
        self.tables[id(back)] = back, path
        self.labels[id(back)] = label
        self._ease()
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if id(table) in self.tables:
                if label := self.labels.pop(id(table), None):
                    self.spark.sql(f"DROP TABLE IF EXISTS {label}")
                self._delete(self.tables.pop(id(table))[1])

    def close(self, *kept: DataFrame) -> None:
        """Delete every table but the ``kept`` ones."""
        held = {id(t) for t in kept}
        self.drop(*[t for t, _ in self.tables.values() if id(t) not in held])
        self.release()

    def release(self) -> None:
        """Let Spark's cleaner find the shuffle files and broadcasts of queries that are over."""
        gc.collect()  # Python's handles keep plans alive
        self.spark.sparkContext._jvm.System.gc()

    def _ease(self) -> None:
        """Plans of many small queries fill the driver's heap at any size of the input, and
        only a full collection gives what they took back to the system."""
        heap = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        if heap.totalMemory() > HEAP_PART * heap.maxMemory():
            self.release()

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(71), key), F.lit(FILTER_BITS)) + 1


def bit_filter(keys: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): one bit set for each key, nulls too. Of one size at most,
    whatever the number of keys: when it fills up it only lets more rows pass."""
    slots = keys.select(_slot(F.col(column)).alias("slot")).distinct()
    bucket = F.bitmap_bucket_number("slot").alias("bucket")
    placed = slots.select("slot", bucket).repartition("bucket")  # single bits move, bitmaps do not
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def maybe_in(rows: DataFrame, column: str, bits: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose key may be in the filter, or those whose key is surely not."""
    slot = _slot(rows[column])
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits["bits"], (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod((byte / F.pow(F.lit(2), position % 8)).cast("int"), F.lit(2)) == 1
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(slot) == bits["bucket"]) & is_set, "left_semi" if inside else "left_anti")


def whole_rows(documents: DataFrame, *more: Column) -> DataFrame:
    """``row``, a struct of all columns, beside working columns of any names: no name of
    the documents can meet one of them, whatever its case."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *more)


def row_hash(documents: DataFrame) -> Column:
    """Hash of ``row`` over all columns, as of the columns side by side."""
    return F.xxhash64(*[F.col(f"row.`{c}`") for c in documents.columns])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
