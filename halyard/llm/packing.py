"""Packing along a space-filling curve.

Each document's token ids give a hashed count vector, projected to three
dimensions; the cell it falls in has a Hilbert key. Documents are range-sorted
by key and laid end to end along the curve, so a sequence holds neighbours.
Sequences are cut every 1024 ids; what is left at the very end becomes sequences
of powers of two, so nothing is padded.

A document's place in the stream is its part's base plus the ids before it in
the part; only one total a part meets in one place. Ids move once.

Defined results: a null text is empty and holds the end id alone; rows of equal
key are ordered by id, then by content; repeated rows are packed each; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm.common import Workspace, text_or_empty
from halyard.llm.tokenizing import CACHE_WORDS, encoder

END_ID = 0
SEQUENCE = 1024
BUCKETS = 256
DIMENSIONS = 3
BITS = 10
ROWS = 1024  # documents encoded at a time
REACH = 2.0  # projected values beyond this many units fall in the outer cells

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, applied to each integer."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    signs = _mix(np.arange(1, BUCKETS * DIMENSIONS + 1)) & np.uint64(1)
    return signs.astype(np.float64).reshape(BUCKETS, DIMENSIONS) * 2 - 1


@lru_cache(maxsize=1)
def _bucket_of(vocabulary: int) -> np.ndarray:
    return (_mix(np.arange(vocabulary) + 977) % np.uint64(BUCKETS)).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of cells (one a row) on the Hilbert curve over a cube of
    ``2**bits`` a side.

    Axes are turned into the transposed index by undoing the reflections and
    exchanges of each level, then Gray-coded and interleaved.
    """
    axes, n = cells.astype(np.int64).T.copy(), cells.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            high = (axes[i] & level) > 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(high, low, swap)
            axes[i] ^= swap
        level >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flips, level = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while level > 1:
        flips ^= np.where(axes[-1] & level, level - 1, 0)
        level >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | (((a ^ flips) >> b) & 1)
    return key


def document_keys(documents: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert key of each document's id array."""
    bucket = _bucket_of(vocabulary)
    owner = np.repeat(np.arange(len(documents)) * BUCKETS, [len(ids) for ids in documents])
    flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
    counts = np.sqrt(np.bincount(bucket[flat] + owner, minlength=len(documents) * BUCKETS).reshape(-1, BUCKETS))
    counts -= counts.mean(1, keepdims=True)
    length = np.linalg.norm(counts, axis=1, keepdims=True)
    points = (counts / np.where(length > 0, length, 1)) @ _projection()
    return hilbert_keys(np.clip((points + REACH) * ((1 << BITS) / (2 * REACH)), 0, (1 << BITS) - 1))


def _encode(path: str, cache_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cache_words)
        end = np.array([END_ID], dtype=enc.dtype).tobytes()
        size = max(len(enc.opens), END_ID + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                raws = [raw + end for raw in enc.encode_many(batch.column(1).slice(at, ROWS).to_pylist())]
                keys = document_keys([np.frombuffer(raw, dtype=enc.dtype) for raw in raws], size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, ROWS),
                        pa.array([len(raw) // enc.dtype.itemsize for raw in raws], pa.int64()),
                        pa.array(keys, pa.int64()),
                        pa.array(raws, pa.binary()),
                    ],
                    ["doc_id", "n", "key", "ids"],
                )

    return run


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place in its part; rows come sorted."""
    at = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        places = at + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0)
        at += int(n.sum())
        columns = [batch.column(c) for c in ("doc_id", "n", "ids", "part")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(places.astype(np.int64))], ["doc_id", "n", "ids", "part", "place"])


def boundary_after(place: int, total: int, sequence: int = SEQUENCE) -> tuple[int, int, int]:
    """(sequence id, its begin, its end) of the sequence that holds a place."""
    full = total // sequence
    if place < full * sequence:
        return place // sequence, place // sequence * sequence, (place // sequence + 1) * sequence
    number, begin, left = full, full * sequence, total % sequence
    while True:
        size = 1 << (left.bit_length() - 1)
        if place < begin + size:
            return number, begin, begin + size
        number, begin, left = number + 1, begin + size, left - size


def _cut(sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, raw, place, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at", "total"))):
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")  # no document is without its end id
                start = 0
                while start < n:
                    number, begin, end = boundary_after(place + start, total, sequence)
                    length = min(n - start, end - place - start)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((doc_id, start, length, crc, n, number, place + start - begin))
                    start += length
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row a piece. ``sequence`` is a power of two. ``cache_words`` bounds the words
    that a worker keeps encoded."""
    own = Workspace(documents.sparkSession, "packing")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Written first, because range partitioning looks at its input twice.
    encoded = own.table(base.mapInArrow(_encode(tokenizer_path, cache_words), "doc_id long, n long, key long, ids binary"), "encoded", compression="zstd")
    order = ["key", "doc_id", F.xxhash64("ids")]
    laid = (
        encoded.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "n", "ids", F.spark_partition_id().alias("part"))
        .mapInArrow(_lay_out, "doc_id long, n long, ids binary, part int, place long")
    )
    laid = own.table(laid, "laid", compression="zstd")
    own.close(laid)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = laid.groupBy("part").agg(F.sum("n").alias("tokens"))  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.sum("tokens").over(every).alias("total"))
    placed = laid.join(F.broadcast(parts), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("place")).alias("at"), "total")
    return placed.mapInArrow(_cut(sequence), PIECE_SCHEMA)
