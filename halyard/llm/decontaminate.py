"""Benchmark decontamination: a prefix-filtered join of document and item windows.

An item is cut into windows of ``window`` consecutive words (a shorter item is one
window). A window is a set of word shingles, and it lies in a document only if all of
them do, so the necessary prefix is one shingle: the rarest, by counts over all
documents. Document shingles meet windows on that one alone. The shingle's place in
the window then says where the window would begin (positional bound) and end (length
bound), and the words there are compared one by one.

Documents are read once, by numpy over whole Arrow batches. A shingle of a document is
kept if it may be one of the benchmark's, by a bit filter of fixed size (16 MB), with the
words around it. All else are joins and aggregates; the benchmark may have any size. A
shingle that a third of all documents hold is dealt to ``SALTS`` keys.

Words are the runs of digits, letters a to z and characters from U+0080 on, after A-Z
are lower-cased. Null and empty texts have no words and are never hit. Rows are told
apart even where ids repeat or are null. Items are told apart by id; rows of one id are
one item, and a null id is the item named by the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import FILTER_BITS, Workspace, bit_filter, maybe_in

WINDOW, SHINGLE = 10, 5
SALTS = 64
CHUNK = 4 << 20
#: Bytes of one slot of a Spark bitmap.
BITMAP = 4096
_KEEP = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_POWERS = np.full(1024, 0x9E3779B97F4A7C15 | 1, np.uint64).cumprod()
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts: hashes, the text of each, and lower-case bytes with
    one space after every word, so that consecutive words are one slice."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        low = np.frombuffer((b"\0".join(parts) + b"\0").translate(_KEEP.tobytes()), np.uint8)
        inside = low != 0
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            turns = np.concatenate([[0], turns])
        self.starts, self.ends = turns[::2], turns[1::2]
        self.lengths = self.ends - self.starts
        self.row = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        self.first = np.searchsorted(self.row, np.arange(len(parts)))
        self.count = np.diff(np.append(self.first, len(self.row)))
        keep = inside.copy()
        keep[self.ends] = True  # a text ends with a zero byte
        self.flat = np.where(low[keep] == 0, np.uint8(32), low[keep]).tobytes()
        self.place = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.hashes = self._hash(low)

    def _hash(self, low: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        for at in range(0, len(out), 1 << 16):
            begin, size = self.starts[at : at + (1 << 16)], self.lengths[at : at + (1 << 16)]
            edge = np.cumsum(size) - size
            inner = np.arange(int(size.sum())) - np.repeat(edge, size)
            value = (low[np.repeat(begin, size) + inner].astype(np.uint64) + np.uint64(7)) * _POWERS[inner & 1023]
            out[at : at + (1 << 16)] = np.add.reduceat(value, edge)
        return _mixed(out)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``width`` words inside a text."""
        n = len(self.row) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        value = np.full(len(at), width, np.uint64)
        for j in range(width):
            value = value * _STEP + self.hashes[at + j]
        return at, _mixed(value).view(np.int64)

    def text(self, first: int, end: int) -> str:
        return self.flat[self.place[first] : self.place[end] - 1].decode()


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    """Slices of about ``CHUNK`` characters; a longer text is one of its own."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text or "") > CHUNK:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(text or "")
    if begin < len(texts):
        yield slice(begin, len(texts))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, n, shingles): the windows of items with their shingles' hashes and
    places. A window shorter than ``shingle`` words is one shingle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _chunks(texts):
                words = Words(texts[part])
                known = {}
                for width in range(1, shingle + 1):
                    at, value = words.shingles(width)
                    known[width] = dict(zip(at.tolist(), value.tolist()))
                found = []
                for name, first, count in zip(names[part], words.first.tolist(), words.count.tolist()):
                    n = min(window, count)
                    width = min(shingle, n)
                    for begin in range(first, first + count - n + 1) if n else ():
                        inner = [{"hash": known[width][begin + j], "at": j} for j in range(n - width + 1)]
                        found.append({"item": name, "words": words.text(begin, begin + n), "n": n, "shingles": inner})
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist(found[k : k + 10_000], schema=shape)

    shape = pa.schema([("item", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("shingles", pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))])
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, words string, n int, shingles array<struct<hash: bigint, at: int>>")


def _filter_bytes(hashes: DataFrame) -> np.ndarray:
    """One bit for each hash, by its low bits: at most 16 MB, whatever their number."""
    slot = F.col("hash").bitwiseAND(FILTER_BITS - 1) + 1
    placed = hashes.select(slot.alias("slot")).distinct().select("slot", F.bitmap_bucket_number("slot").alias("bucket")).repartition("bucket")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in placed.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot"))).collect():
        out[(bucket - 1) * BITMAP : bucket * BITMAP] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _seen(docs: DataFrame, bits: np.ndarray, widths: list[int], window: int, doc_id: str, text: str) -> DataFrame:
    """A row for each document: its words' number and the shingles that the filter
    passes, each with the words that a window around it can take."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in _chunks(texts):
                words = Words(texts[part])
                ats, values, sizes = [], [], []
                for width in widths:
                    at, value = words.shingles(width)
                    slot = value & (FILTER_BITS - 1)
                    hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    ats.append(at[hit])
                    values.append(value[hit])
                    sizes.append(np.full(len(hit), width))
                at, value, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ats, values, sizes))
                order = np.argsort(at, kind="stable")
                at, value, size = at[order], value[order], size[order]
                row = words.row[at]
                first, end = words.first[row], words.first[row] + words.count[row]
                spare = np.where(size == max(widths, default=0), window - size, 0)  # a window longer than a shingle has only widest ones
                low, high = np.maximum(at - spare, first), np.minimum(at + size + spare, end)
                around = [words.text(b, e) for b, e in zip(low.tolist(), high.tolist())]
                hits = pa.StructArray.from_arrays(
                    [pa.array((at - first).astype(np.int32)), pa.array(value), pa.array((at - low).astype(np.int32)), pa.array(around, pa.string())], names=["at", "hash", "before", "around"]
                )
                offsets = np.searchsorted(row, np.arange(len(words.first) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), hits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], batch.column(1)[part.start : part.stop], pa.array(words.count, pa.int64()), lists], names=["row", "doc_id", "n_words", "hits"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(look, f"row bigint, doc_id {kind}, n_words bigint, hits array<struct<at: int, hash: bigint, before: int, around: string>>")


def contaminated_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, windows (sorted structs of the first
    word and the number of words of each occurrence of an item's window, null without
    any) and items (ids as strings, sorted, null without any)."""
    if not 1 <= shingle <= window:
        raise ValueError("a shingle has one word at least, and no more than a window")
    own = Workspace(docs.sparkSession, "decontaminate")
    windows = own.table(item_windows(items, window, shingle, item_id, text).dropDuplicates(["item", "words"]), "windows")
    widths = [r[0] for r in windows.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect()]  # at most ``shingle`` values
    parts = windows.select("item", "words", "n", F.explode("shingles").alias("s")).select("item", "words", "n", "s.hash", "s.at")
    seen = own.table(_seen(docs, _filter_bytes(parts.select("hash")), sorted(widths), window, doc_id, text), "seen")

    # Order by rarity, over all documents; a window with a shingle that no document has is nowhere.
    counts = seen.select(F.explode("hits.hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    rarest = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "hash", "at")).alias("r")
    prefix = parts.join(counts, "hash", "left").groupBy("item", "words", "n").agg(rarest).where("r.often > 0")
    prefix = own.table(prefix.select("item", "words", "n", "r.hash", F.col("r.at").alias("place")), "prefix")

    hits = seen.select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.*")
    hits = maybe_in(hits, "hash", bit_filter(prefix.select("hash"), "hash"))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    spread = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    begin = F.col("at") - F.col("place")
    fits = (begin >= 0) & (begin + F.col("n") <= F.col("n_words")) & (F.col("before") >= F.col("place"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ") == F.col("words")
    found = salted.join(spread, ["hash", "salt"]).where(fits).where(same).select("row", "item", F.struct(begin.alias("start"), "n").alias("w"))
    grouped = found.groupBy("row").agg(F.array_sort(F.collect_set("w")).alias("windows"), F.array_sort(F.collect_set("item")).alias("items"))
    return seen.select("row", "doc_id", "n_words").join(grouped, "row", "left").drop("row")


def covered(windows: Column) -> Column:
    """Words inside any of the sorted windows."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def add(acc: Column, w: Column) -> Column:
        end = w["start"] + w["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["words"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], w["start"]))).alias("words"))

    return F.coalesce(F.aggregate(windows, zero, add, lambda acc: acc["words"]), F.lit(0).cast("long"))
