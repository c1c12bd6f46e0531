"""Rows dealt by keys, in columns on the way: a shuffle of compressed column blocks.

A shuffled row has eight bytes and more for each of its values. Here each task parts its
rows itself and sends a block of columns to each partition, which takes a half or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.scan import column

#: Bytes of rows that a task parts at once, and rows in a batch that is read again.
BLOCK, BATCH = 64 << 20, 10_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows; those of equal keys (null is a key) lie in one partition, in no order. There
    are as many partitions as ``spark.sql.shuffle.partitions`` says."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    return marked.mapInArrow(_pack, "_part int, size long, body binary").repartitionById(parts, "_part").mapInArrow(_unpack, rows.schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= BLOCK:
            yield _blocks(held)
            held, size = [], 0
    if held:
        yield _blocks(held)


def _blocks(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    part = rows.column("_part").to_numpy()
    order = np.argsort(part, kind="stable")
    rows, part = rows.drop_columns(["_part"]).take(pa.array(order)).combine_chunks(), part[order]
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    codec, sizes, bodies = pa.Codec("zstd"), [], []
    for low, high in zip(edges, edges[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows.slice(low, high - low))
        body = sink.getvalue()
        sizes.append(body.size)
        bodies.append(codec.compress(_planes(body), asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], names=["_part", "size", "body"])


def _planes(body: pa.Buffer) -> bytes:
    """The first bytes of all words, then the second and so on: like bytes of numbers lie together."""
    words = np.frombuffer(body, np.uint8)
    return np.pad(words, (0, -len(words) % 8)).reshape(-1, 8).T.tobytes()


def _whole(planes: pa.Buffer) -> pa.Buffer:
    return pa.py_buffer(np.frombuffer(planes, np.uint8).reshape(8, -1).T.tobytes())


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec, held, count = pa.Codec("zstd"), [], 0
    for batch in batches:
        for size, body in zip(column(batch, "size").to_pylist(), column(batch, "body")):
            for block in pa.ipc.open_stream(_whole(codec.decompress(body.as_buffer(), size + -size % 8))):
                held.append(block)
                count += block.num_rows
            if count >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH)
                held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH)
