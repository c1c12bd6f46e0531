"""Quality classifier: a factorisation machine.

Inputs of a document: hashed words (square roots of counts, scaled to length
one), structure statistics of the whole text, and the metadata column
``n_chars`` (the text's own length where it is null). Labels, language, source
and id are never inputs. The pairwise interactions have low rank and are scored
in linear time by the sum-of-squares identity
``1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]``.

Fitting uses a bounded sample of labelled rows (about ``SAMPLE_DOCS``, chosen by
hash of the id, outside the held-out fold) and Adagrad on the driver; the score
is the logistic probability of label 1. Scoring is one pass over the documents;
nothing is shuffled.

Defined results: null texts count as empty and get the score of their
statistics; with no labelled row every score is 0.5; labels of a repeated id all
count; rows without an id are not held out; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.lang_id import fold

WORD_BITS = 14
RANK = 6
SAMPLE_DOCS = 4000
EPOCHS = 12
RATE = 0.08
DECAY = 2e-5
THRESHOLD = 0.3
CACHE_WORDS = 400_000
#: Inputs of documents scored together, some MB of factors; a document adds its own at most.
BATCH_INPUTS = 100_000
#: Byte classes counted over the UTF-8 text.
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*+<=>@[\\]^_`{}~", dtype=np.uint8)

STATISTICS = (
    "log_bytes", "log_metadata", "metadata_gap", "word_length", "longest_word", "upper", "digits", "symbols", "bars",
    "shouts", "full_stops", "lines", "distinct_words", "echoes", "repeated_lines", "spaces",
)
WORDS = 1 << WORD_BITS
SIZE = WORDS + len(STATISTICS)


class FeatureMaker:
    def __init__(self) -> None:
        self.slots: dict[str, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word slots, their values, statistics) of one document."""
        text = text or ""
        words = text.split()
        if len(self.slots) > CACHE_WORDS:
            self.slots = {}
        slots = self.slots
        for w in set(words):
            if w not in slots:
                slots[w] = crc32(w.lower().encode("utf-8", "replace")) & (WORDS - 1)
        found, counts = np.unique(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), return_counts=True)
        values = np.sqrt(counts)
        norm = float(np.sqrt(counts.sum())) or 1.0
        return found, values / norm, self.statistics(text, words, n_chars)

    @staticmethod
    def statistics(text: str, words: list[str], n_chars: int | None) -> np.ndarray:
        seen = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        size, n = max(1, int(seen.sum())), max(1, len(words))
        letters = max(1, int(seen[_UPPER].sum() + seen[_LOWER].sum()))
        given = len(text) if n_chars is None or n_chars < 0 else n_chars
        lines = text.split("\n")
        return np.array(
            [
                math.log1p(size),
                math.log1p(given),
                math.log1p(given) - math.log1p(len(text)),
                size / n,
                math.log1p(max(map(len, words), default=0)),
                seen[_UPPER].sum() / letters,
                seen[_DIGIT].sum() / size,
                math.sqrt(seen[_SYMBOL].sum() / size),
                math.sqrt(seen[124] / size),
                math.sqrt(seen[33] / size),
                math.sqrt(seen[46] / size),
                math.sqrt(seen[10] / size),
                len(set(words)) / n,
                math.sqrt(sum(map(eq, words, words[1:])) / n),
                1 - len(set(lines)) / len(lines),
                seen[32] / size,
            ]
        )


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, slots: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        standard = np.clip((stats - self.mean) / self.scale, -4, 4) * 0.3
        return np.concatenate([slots, np.arange(WORDS, SIZE)]), np.concatenate([values, standard])

    def raw(self, index: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        v = self.factors[index] * x[:, None]
        total = v.sum(0)
        return float(self.bias + self.weights[index] @ x + 0.5 * ((total * total).sum() - (v * v).sum())), total

    def scores(self, rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities for (slots, values, statistics) of documents, computed together
        for as many as have ``BATCH_INPUTS`` inputs."""
        out, held, size = [], [], 0
        for row in rows:
            held.append(self.inputs(*row))
            size += len(held[-1][0])
            if size >= BATCH_INPUTS:
                out.append(self._together(held))
                held, size = [], 0
        return np.concatenate([*out, self._together(held)])

    def _together(self, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not held:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(index) for index, _ in held[:-1])])  # no row is without inputs
        index, x = (np.concatenate(part) for part in zip(*held))
        v = self.factors[index] * x[:, None]
        total = np.add.reduceat(v, starts)
        own = np.add.reduceat((v * v).sum(1), starts)
        z = self.bias + np.add.reduceat(self.weights[index] * x, starts) + 0.5 * ((total * total).sum(1) - own)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple], seed: int = 1) -> FactorisationMachine:
        """``rows``: (label, slots, values, statistics), in a fixed order."""
        stats = np.array([r[3] for r in rows]).reshape(-1, len(STATISTICS))
        mean = stats.mean(0) if len(rows) else np.zeros(len(STATISTICS))
        scale = np.maximum(stats.std(0), 1e-6) if len(rows) else np.ones(len(STATISTICS))
        rng = np.random.default_rng(seed)
        model = cls(0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, RANK)), mean, scale)
        if not rows:
            model.factors[:] = 0
            return model
        labels = np.array([float(r[0]) for r in rows])
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        model.bias = math.log(share / (1 - share))
        past_w, past_v, past_b = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2), 1e-2
        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                index, x = model.inputs(*rows[k][1:])  # made anew: kept, they would double the sample
                z, total = model.raw(index, x)
                slip = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - labels[k]
                grad_w = slip * x + DECAY * model.weights[index]
                own = model.factors[index]
                grad_v = slip * (x[:, None] * total - own * (x * x)[:, None]) + DECAY * own
                past_w[index] += grad_w * grad_w
                past_v[index] += grad_v * grad_v
                past_b += slip * slip
                model.weights[index] -= RATE * grad_w / np.sqrt(past_w[index])
                model.factors[index] -= RATE * 0.5 * grad_v / np.sqrt(past_v[index])
                model.bias -= RATE * slip / math.sqrt(past_b)
        return model


def _metadata(documents: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in documents.columns else F.lit(None)).cast("long")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = FeatureMaker()
    for batch in batches:
        rows = [make(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        columns = [pa.array([list(r[k]) for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "label", "slots", "amounts", "stats"])


def fit_quality(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_docs: int = SAMPLE_DOCS) -> FactorisationMachine:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold(folds=folds) != held))
    share = min(1.0, sample_docs / max(1, marks.count()))
    picked = marks.withColumn("h", F.xxhash64(F.lit(13), "doc_id")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounds for repeated ids, in an order that makes them repeatable.
    picked = picked.orderBy("h", "label").limit(2 * sample_docs).drop("h")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _metadata(documents).alias("n"))
    joined = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text", "n")
    joined = joined.orderBy(F.xxhash64(F.lit(13), "doc_id"), F.xxhash64("text"), "label", "n").limit(4 * sample_docs)
    schema = "doc_id long, label int, slots array<bigint>, amounts array<double>, stats array<double>"
    found = joined.mapInArrow(_features, schema).toArrow()
    ids, labels_of = found["doc_id"].to_pylist(), found["label"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], labels_of[k]))  # stable: rows of one id keep the order above
    # Views of the one table, not lists: the features of a long document are its whole vocabulary.
    return FactorisationMachine.fit([(labels_of[k], *(found[c][k].values.to_numpy() for c in ("slots", "amounts", "stats"))) for k in order])


def quality_score(documents: DataFrame, model: FactorisationMachine) -> Column:
    """Column of scores, for rows of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        make, machine = FeatureMaker(), shared.value
        for texts, sizes in batches:
            given = [None if pd.isna(n) else int(n) for n in sizes]
            yield pd.Series(machine.scores(make(t, n) for t, n in zip(texts, given)), dtype="float64")

    return score(F.col("text").cast("string"), _metadata(documents))


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit_quality(documents, labels, folds, held)
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold(folds=folds) == held, F.lit(False)).alias("held_out"),
        quality_score(documents, model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier does not reject."""
    model = fit_quality(documents, labels)
    return documents.where(quality_score(documents, model) >= THRESHOLD)
