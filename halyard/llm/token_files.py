"""Token-id files: one zstandard frame a document, one shared dictionary.

Layout under a folder of any file system that Spark writes:

* ``dictionary`` - one row: the dictionary's bytes and its SHA-256.
* ``blocks`` - rows in ascending document order, each holding up to
  ``BLOCK_DOCS`` documents: their ids, token counts and frame ends (the offset
  index), the dictionary's hash and the frames end to end. A single short
  document is read by its block's row and one slice of the payload.
* ``manifest`` - ids before each part, so that a document's global start is its
  part's base plus its place in the part.

The dictionary is trained on the serialized id arrays of a bounded sample:
``SAMPLE_DOCS`` documents, those of the least hashes; of one with more than
``SAMPLE_IDS`` ids, a run of so many at a place chosen by hash. Every document
is written whole. Where the sample is too small to train on, frames carry no
dictionary.

Defined results: a null text is empty and holds the end id alone; rows without
an id come first; equal ids are ordered by text hash; an empty table writes no
block and reads back empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm.common import scratch_path, text_or_empty
from halyard.llm.tokenizing import encoder

END_ID = 0
BLOCK_DOCS = 256
ROWS = 1024  # documents encoded at a time
BLOCK_BYTES = 1 << 18
LEVEL = 3
SAMPLE_DOCS = 1500
SAMPLE_IDS = 16_384
DICTIONARY_BYTES = 1 << 16

BLOCK_SCHEMA = (
    "part int, start_in_part long, dictionary_hash string, doc_ids array<bigint>, "
    "n_tokens array<bigint>, frame_ends array<bigint>, payload binary"
)


@lru_cache(maxsize=4)
def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _end(path: str) -> bytes:
    return np.array([END_ID], dtype=encoder(path).dtype).tobytes()


def _sample_encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = SAMPLE_IDS * encoder(path).dtype.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raws = [raw + _end(path) for raw in encoder(path).encode_many(part.column(0).to_pylist())]
                places = [h % (max(0, len(raw) - most) // SAMPLE_IDS + 1) * SAMPLE_IDS for h, raw in zip(part.column(1).to_pylist(), raws)]
                raws = [raw[p : p + most] for p, raw in zip(places, raws)]
                yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary())], ["ids"])

    return run


def train_dictionary(documents: DataFrame, tokenizer_path: str, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """Dictionary bytes from a bounded sample; empty if it cannot be trained."""
    import zstandard

    n = max(1, documents.count())
    share = min(1.0, 1.2 * sample_docs / n)
    # The threshold leaves few rows to order; the order makes the bound repeatable.
    picked = (
        documents.withColumn("h", F.xxhash64(F.lit(97), "doc_id"))
        .where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
        .orderBy("h", F.xxhash64("text"))
        .limit(sample_docs)
        .select("text", "h")
    )
    samples = [bytes(r.ids) for r in picked.mapInArrow(_sample_encoder(tokenizer_path), "ids binary").collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _block_writer(path: str, dictionary: bytes, level: int):
    mark = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary)).compress
        enc, end = encoder(path), _end(path)
        width = enc.dtype.itemsize
        start = begun = 0
        part, ids, counts, ends, payload = None, [], [], [], bytearray()

        def block() -> pa.RecordBatch:
            row = {
                "part": part, "start_in_part": begun, "dictionary_hash": mark, "doc_ids": ids, "n_tokens": counts,
                "frame_ends": ends, "payload": bytes(payload),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            docs, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(docs), ROWS):
                texts = batch.column(1).slice(at, ROWS).to_pylist()
                for doc_id, p, raw in zip(docs[at : at + ROWS], parts[at : at + ROWS], enc.encode_many(texts)):
                    part = p
                    raw += end
                    payload += pack(raw)
                    ids.append(doc_id)
                    counts.append(len(raw) // width)
                    ends.append(len(payload))
                    start += counts[-1]
                    if len(ids) >= BLOCK_DOCS or len(payload) >= BLOCK_BYTES:
                        yield block()
                        begun, ids, counts, ends, payload = start, [], [], [], bytearray()
        if ids:
            yield block()

    return run


_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("start_in_part", pa.int64()), ("dictionary_hash", pa.string()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
        ("frame_ends", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, level: int = LEVEL) -> None:
    """One shuffle: texts move to ranges of ids and are encoded where they land."""
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dictionary = train_dictionary(base, tokenizer_path)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, data binary").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")
    ordered = (
        base.repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .withColumn("part", F.spark_partition_id())
    )
    ordered.mapInArrow(_block_writer(tokenizer_path, dictionary, level), BLOCK_SCHEMA).write.option(
        "compression", "uncompressed"
    ).parquet(f"{path}/blocks")
    parts = (
        spark.read.parquet(f"{path}/blocks")
        .select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
        .groupBy("part")
        .agg(F.sum("n").alias("tokens"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/manifest")


def _block_reader(dictionary: bytes, wide: bool, with_ids: bool):
    mark = hashlib.sha256(dictionary).hexdigest()
    dtype = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != mark:
                    raise ValueError("block was written with another dictionary")
                out: list[tuple] = []
                start, at = row["start"], 0
                for doc_id, n, end in zip(row["doc_ids"], row["n_tokens"], row["frame_ends"]):
                    ids = np.frombuffer(unpack(row["payload"][at:end]), dtype=dtype).astype("<u4")
                    if len(ids) != n:
                        raise ValueError("frame length differs from the index")
                    out.append((doc_id, start, n, zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                    start, at = start + n, end
                columns = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(columns[4], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def read_token_files(spark: SparkSession, path: str, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""
    stored = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.parquet(f"{path}/blocks")
    manifest = spark.read.parquet(f"{path}/manifest")  # one row a written file
    located = blocks.join(F.broadcast(manifest), "part").select(
        (F.col("base") + F.col("start_in_part")).alias("start"), "dictionary_hash", "doc_ids", "n_tokens", "frame_ends", "payload"
    )
    wide = encoder(tokenizer_path).dtype.itemsize == 4
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return located.mapInArrow(_block_reader(bytes(stored["data"]), wide, with_ids), schema)


def read_document(spark: SparkSession, path: str, doc_id: int, tokenizer_path: str) -> list[int] | None:
    """Ids of one document: its block alone is fetched, its frame alone unpacked.
    None where no document has the id; of several, the first in the files' order."""
    import zstandard

    stored = spark.read.parquet(f"{path}/dictionary").first()
    at = F.array_position("doc_ids", doc_id).cast("int")
    begin = F.when(at > 1, F.element_at("frame_ends", F.greatest(at - 1, F.lit(1)))).otherwise(F.lit(0)).cast("int")
    frame = F.substring("payload", begin + 1, (F.element_at("frame_ends", at).cast("int") - begin))
    row = spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", doc_id))
    row = row.orderBy("part", "start_in_part").select(frame.alias("frame")).first()
    if row is None:
        return None
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(stored["data"]))).decompress
    return np.frombuffer(unpack(bytes(row["frame"])), dtype=encoder(tokenizer_path).dtype).tolist()


def round_trip(documents: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(documents, path, tokenizer_path)
    return read_token_files(spark, path, tokenizer_path)
