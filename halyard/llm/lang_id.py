"""Language identification by prediction by partial matching.

Every language has a context tree over the bytes of lower-cased text, up to
``ORDER`` bytes deep. Escapes follow method C with exclusion: a context seen T
times with q different followers gives a follower n/(T+q) and passes q/(T+q) on
to the next shorter context, shared among the bytes it has not seen itself. The
statistics are frozen after fitting, so the code length of every (context, byte)
is a table entry: contexts that any language has seen twice own a row, others
fall back to their longest seen suffix. A document's language is the one of the
shortest exact code length of its whole text.

Fitting reads a bounded sample: about ``SAMPLE_DOCS`` documents a language,
chosen by hash of the id. Scoring reads every text whole, in slices of bounded
memory; nothing is shuffled.

Defined results: null texts and texts without a letter are ``und`` with score 0;
with no labelled document everything is ``und``; ties go to the first language
by name; rows without an id are not held out and not learned from; repeated rows
are judged each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
SAMPLE_DOCS = 300
SAMPLE_CHARS = 1 << 18
#: Languages learned: the most frequent values of the label.
MAX_LANGUAGES = 128
#: Size of the table of code lengths. Contexts seen most own a row; one without a
#: row has the code lengths of its longest suffix with one.
MODEL_BYTES = 256 << 20
MIN_COUNT = 2
SLICE = 1 << 19
BATCH_BYTES = 1 << 19
BEGIN = 0

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def fold(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


@dataclass
class PpmModel:
    languages: list[str]
    symbol_of: np.ndarray  # 256 -> 0..A-1; 0 marks the begin of a text
    row_of: np.ndarray  # A**ORDER context keys -> row
    bits: np.ndarray  # rows x A x languages, flattened to (rows * A, languages)

    @property
    def alphabet(self) -> int:
        return int(self.symbol_of.max()) + 1

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], model_bytes: int = MODEL_BYTES) -> PpmModel:
        languages = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(b for l in languages for b in samples[l]), dtype=np.uint8))
        symbol_of = np.full(256, len(seen) + 1, dtype=np.int64)  # the last symbol: any other byte
        symbol_of[seen] = np.arange(1, len(seen) + 1)
        a = len(seen) + 2
        max_contexts = max(1, model_bytes // (4 * a * max(1, len(languages)) * ORDER))
        streams = {}
        for lang in languages:
            parts = [p for raw in samples[lang] for p in (np.zeros(ORDER, np.int64), symbol_of[np.frombuffer(raw, np.uint8)])]
            streams[lang] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # Per order: the union of contexts worth a row, by count over languages.
        grams: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
        for order in range(ORDER + 1):
            by_language = {}
            for lang, s in streams.items():
                key = np.zeros(max(0, len(s) - ORDER), dtype=np.int64)
                for k in range(ORDER - order, ORDER + 1):
                    key = key * a + s[k : k + len(key)]
                key = key[s[ORDER:] != BEGIN]
                by_language[lang] = np.unique(key, return_counts=True)
            grams.append(by_language)
        kept: list[np.ndarray] = [np.zeros(1, np.int64)]
        for order in range(1, ORDER + 1):
            keys = np.concatenate([g // a for g, _ in grams[order].values()])
            counts = np.concatenate([n for _, n in grams[order].values()])
            contexts, inverse = np.unique(keys, return_inverse=True)
            totals = np.bincount(inverse, weights=counts, minlength=len(contexts))
            contexts, totals = contexts[totals >= MIN_COUNT], totals[totals >= MIN_COUNT]
            if len(contexts) > max_contexts:
                contexts = np.sort(contexts[np.argsort(-totals, kind="stable")[:max_contexts]])
            kept.append(contexts)
        # Rows from the root down; a parent is the context without its oldest byte.
        flat = np.zeros((sum(map(len, kept)), a, len(languages)), np.float32)
        row_maps, first = [], 0
        for order, contexts in enumerate(kept):
            if order == 0:
                parent = np.full((1, a, len(languages)), 1.0 / a, np.float32)
            else:
                parent = flat[row_maps[order - 1][contexts % a ** (order - 1)]]
            table = flat[first : first + len(contexts)]
            for j, lang in enumerate(languages):
                keys, counts = grams[order][lang]
                at = np.searchsorted(contexts, keys // a)
                at = np.minimum(at, max(0, len(contexts) - 1))
                hit = contexts[at] == keys // a if len(contexts) else np.zeros(len(keys), bool)
                own_row, own_byte, own_count = at[hit], keys[hit] % a, counts[hit]
                # Some rows at a time: the float64 work stays small beside the table.
                for lo in range(0, len(contexts), 8192):
                    hi = min(lo + 8192, len(contexts))
                    mine = slice(*np.searchsorted(own_row, [lo, hi]))
                    n = np.zeros((hi - lo, a))
                    n[own_row[mine] - lo, own_byte[mine]] = own_count[mine]
                    total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
                    above = parent[lo:hi, :, j].astype(np.float64)
                    lower = np.where(n > 0, 0, above)
                    left = lower.sum(1, keepdims=True)
                    escape = np.where(left > 0, lower / np.where(left > 0, left, 1), 0) * kinds
                    table[lo:hi, :, j] = np.where(total > 0, (n + escape) / np.maximum(1, total + kinds), above)
            rows = np.zeros(a**order, dtype=np.int32)
            if order:
                rows[:] = np.tile(row_maps[order - 1], a)
            rows[contexts] = first + np.arange(len(contexts))
            first += len(contexts)
            row_maps.append(rows)
        np.maximum(flat, 1e-12, out=flat)
        np.log2(flat, out=flat)
        np.negative(flat, out=flat)
        return cls(languages, symbol_of, row_maps[-1], flat.reshape(-1, len(languages)))

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of ``codes[ORDER:]``, a row a byte."""
        a, n = self.alphabet, len(codes) - ORDER
        key = np.zeros(n, dtype=np.int64)
        for k in range(ORDER):
            key = key * a + codes[k : k + n]
        return self.bits[self.row_of[key].astype(np.int64) * a + codes[ORDER:]]

    def code_lengths(self, raws: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(raws), len(self.languages)))
        codes = [np.concatenate([np.full(ORDER, BEGIN), self.symbol_of[np.frombuffer(r, np.uint8)]]) for r in raws if len(r) <= SLICE]
        small = [k for k, r in enumerate(raws) if 0 < len(r) <= SLICE]
        codes = [c for c in codes if len(c) > ORDER]
        if codes:
            stream = np.concatenate(codes)
            begins = np.concatenate([[0], np.cumsum([len(c) for c in codes])[:-1]]).astype(np.int64)
            lengths = self.positions(stream)
            # The first bytes of the next text's padding are no part of a text.
            lengths[stream[ORDER:] == BEGIN] = 0
            out[small] = np.add.reduceat(lengths, begins, axis=0, dtype=np.float64)
        for k, raw in enumerate(raws):
            if len(raw) > SLICE:
                tail = np.full(ORDER, BEGIN)
                for at in range(0, len(raw), SLICE):
                    part = np.concatenate([tail, self.symbol_of[np.frombuffer(raw[at : at + SLICE], np.uint8)]])
                    out[k] += self.positions(part).sum(0, dtype=np.float64)
                    tail = part[-ORDER:]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        chosen = [k for k, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for group in _groups(chosen, texts):
            lengths = self.code_lengths([texts[k].lower().encode("utf-8", "replace") for k in group])
            best = lengths.argmin(1)
            gap = np.minimum(lengths - lengths.min(1, keepdims=True), 1000)
            share = 1 / np.exp2(-gap).sum(1)
            for k, b, s in zip(group, best, share):
                names[k], scores[k] = self.languages[b], float(s)
        return names, scores


def _groups(chosen: list[int], texts: list) -> Iterator[list[int]]:
    group, size = [], 0
    for k in chosen:
        group.append(k)
        size += len(texts[k])
        if size > BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def fit_languages(documents: DataFrame, folds: int = 3, held: int = 1, sample_docs: int = SAMPLE_DOCS) -> PpmModel:
    learn = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(folds=folds) != held))
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = [(r.lang, r.n) for r in counts.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()]
    if not sizes:
        return PpmModel([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, int(min(1.0, sample_docs / n) * (1 << 30)))])
    drawn = learn.withColumn("h", F.xxhash64(F.lit(5), "doc_id")).where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")])
    # The order makes the bound repeatable where it bites, with repeated ids.
    tie = F.xxhash64("text")
    picked = drawn.orderBy("h", tie, "lang").limit(3 * sample_docs * len(sizes))
    # Of a long document, the run of SAMPLE_CHARS characters at a place chosen by hash.
    place = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    picked = picked.select("lang", "h", tie.alias("tie"), F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    samples: dict[str, list[tuple]] = {}
    for r in picked.collect():
        samples.setdefault(r.lang, []).append((r.h, r.tie, r.text.lower().encode("utf-8", "replace")))
    return PpmModel.fit({lang: [raw for *_, raw in sorted(rows)] for lang, rows in samples.items()})


def identify_languages(documents: DataFrame, folds: int = 3, held: int = 1, model: PpmModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = model or fit_languages(documents, folds, held)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most, and the map of contexts
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold(folds=folds) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores = ppm.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
