"""URL filter: rules first, then the ratio of two character language models.

Rules are plain column expressions over host and path. URLs that a rule decides
are the labelled set: one smoothed variable-order Markov model is fitted on
accepted ones, one on rejected ones. A URL's score is the difference of the two
log-likelihoods over its length. Four fifths of the labelled URLs, by hash, are
counted, all of them; all of the last fifth place the threshold: the place of
fewest errors, classes weighed alike, and never on the accepting side of zero.

A character's probability depends on the ``ORDER`` characters before it, so a score
is a sum of weights of five-character grams. Grams are counted, smoothed order by
order and looked up by joins: no model is held whole. Order by order each gram meets
97 others at most. Weights of the grams asked for most (``COMMON``) go to the tasks
that cut URLs, the others meet theirs in a shuffle. Weights are whole multiples of
2**-32, so sums do not depend on their order.

URLs that no rule decides are blocked where the score says they are closer to
rejected ones than the threshold allows. ``UrlRatio`` is the same model in one
process, for a few URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule; an empty text scores 0; with no labelled URL of a class, every URL
scores 0 and is allowed; repeated rows are counted and judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import Workspace

#: Fixed values of the contract: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Grams whose weights every task gets: a megabyte. All others are looked up by a join.
COMMON = 1 << 16
#: Steps of a nat in which the threshold is placed.
STEPS = 1024
UNIT = 1 << 32
ROWS_OUT = 1 << 18
ORDER = 4
SYMBOLS = 97  # printable ASCII, and one for all else; the last marks the begin
SMOOTHING = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - 32
    raw[(raw < 0) | (raw >= SYMBOLS - 2)] = SYMBOLS - 2
    return raw


@dataclass
class CharacterModel:
    """Counts of contexts up to ``ORDER`` characters, each order smoothed by the
    one below it (Witten-Bell style, with a uniform base)."""

    grams: list[np.ndarray]  # sorted keys of the (k+1)-grams
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]

    @staticmethod
    def keys(codes: np.ndarray, order: int) -> np.ndarray:
        padded = np.concatenate([np.full(order, SYMBOLS - 1), codes])
        key = np.zeros(len(codes), dtype=np.int64)
        for k in range(order + 1):
            key = key * SYMBOLS + padded[k : k + len(codes)]
        return key

    @classmethod
    def fit(cls, texts: list[str]) -> CharacterModel:
        fields: list[list] = [[], [], [], [], []]
        for order in range(ORDER + 1):
            keys = np.concatenate([cls.keys(_codes(t), order) for t in texts] or [np.zeros(0, np.int64)])
            grams, counts = np.unique(keys, return_counts=True)
            contexts, first, kinds = np.unique(grams // SYMBOLS, return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            for field, value in zip(fields, (grams, counts, contexts, totals, kinds)):
                field.append(value)
        return cls(*fields)

    def log_likelihood(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of each character's probability, given what precedes it."""
        p = np.full(len(codes), 1.0 / SYMBOLS)
        for order in range(ORDER + 1):
            if not len(self.grams[order]):
                continue
            key = self.keys(codes, order)
            n = _find(self.grams[order], self.counts[order], key)
            total = _find(self.contexts[order], self.totals[order], key // SYMBOLS)
            kinds = _find(self.contexts[order], self.kinds[order], key // SYMBOLS)
            p = (n + (SMOOTHING + kinds) * p) / (total + SMOOTHING + kinds)
        return np.log(p)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


@dataclass
class UrlRatio:
    accepted: CharacterModel | None
    rejected: CharacterModel | None
    threshold: float = 0.0

    def score(self, url: str | None) -> float:
        """Above zero: likelier among rejected URLs. Nats a character."""
        if not url or self.accepted is None or self.rejected is None:
            return 0.0
        codes = _codes(url)
        return float((self.rejected.log_likelihood(codes) - self.accepted.log_likelihood(codes)).mean())


def calibrate(scores: np.ndarray, blocked: np.ndarray) -> float:
    """Threshold of the fewest errors with both classes weighed alike, 0 at least."""
    if not len(scores) or blocked.all() or not blocked.any():
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, b = scores[order], blocked[order]
    missed = np.concatenate([[0], np.cumsum(b)]) / b.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(~b)]) / (~b).sum()
    k = int(np.argmin(missed + wrong))
    low = s[k - 1] if k else s[0]
    high = s[k] if k < len(s) else s[-1]
    return max(0.0, float(low + high) / 2)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``ORDER`` + 1 characters that end at each character of each text, and
    the number of its text. Those of a lower order are their last characters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes, out = _codes("".join(texts)), np.zeros(len(owner), np.int64)
    for back in range(ORDER, -1, -1):
        before = np.concatenate([np.zeros(min(back, len(codes)), np.int64), codes[: max(0, len(codes) - back)]])
        out = out * SYMBOLS + np.where(place >= back, before, SYMBOLS - 1)
    return out, owner


def _parts(urls: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of URLs of about ``ROWS_OUT`` characters, each with its first place."""
    begin = size = 0
    for k, url in enumerate(urls):
        size += len(url)
        if size > ROWS_OUT:
            yield begin, urls[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(urls):
        yield begin, urls[begin:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of (url, n), added up within a run."""
    for batch in batches:
        times = batch.column(1).to_numpy()
        for at, urls in _parts(batch.column(0).to_pylist()):
            grams, owner = _grams(urls)
            kinds, which = np.unique(grams, return_inverse=True)
            n = np.zeros(len(kinds), np.int64)
            np.add.at(n, which, times[at + owner])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["gram", "n"])


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, n) over rows of (url, n)."""
    return urls.where("url <> ''").select("url", "n").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_weights(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, times, weight) for ``asked`` (gram, times): the logarithm of the gram's
    probability by ``CharacterModel`` on rejected URLs over that on accepted ones, in
    units. ``counts``: gram, accepted, rejected."""
    level = F.lit(None)
    for order in range(ORDER + 1):
        width = F.lit(SYMBOLS ** (order + 1))
        seen = counts.groupBy((F.col("gram") % width).alias("g")).agg(F.sum("accepted").alias("n_a"), F.sum("rejected").alias("n_r"))
        around = seen.groupBy(F.expr(f"g div {SYMBOLS}").alias("context")).agg(
            F.sum("n_a").alias("t_a"), F.sum("n_r").alias("t_r"), F.count_if(F.col("n_a") > 0).alias("k_a"), F.count_if(F.col("n_r") > 0).alias("k_r")
        )
        now = asked.select((F.col("gram") % width).alias("g")).distinct().withColumn("context", F.expr(f"g div {SYMBOLS}"))
        now = now.join(seen, "g", "left").join(around, "context", "left").na.fill(0)
        if order:
            now = now.withColumn("below", F.col("g") % (SYMBOLS**order)).join(level.withColumnRenamed("g", "below"), "below")
        else:
            now = now.withColumn("p_a", F.lit(1.0 / SYMBOLS)).withColumn("p_r", F.lit(1.0 / SYMBOLS))
        smooth = lambda c: (F.col(f"n_{c}") + (SMOOTHING + F.col(f"k_{c}")) * F.col(f"p_{c}")) / (F.col(f"t_{c}") + SMOOTHING + F.col(f"k_{c}"))
        level = now.select("g", smooth("a").alias("p_a"), smooth("r").alias("p_r"))
    weight = F.round((F.log("p_r") - F.log("p_a")) * UNIT).cast("long")
    return asked.join(level.select(F.col("g").alias("gram"), weight.alias("weight")), "gram")


def _weigh(grams: np.ndarray, weights: np.ndarray):
    """(key, gram, weight) of (key, url): the weights of common grams added up, without
    a gram, and a row for each other gram, without a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for at, urls in _parts(batch.column(1).to_pylist()):
                found, owner = _grams(urls)
                place = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                known = grams[place] == found
                sums = np.zeros(len(urls), np.int64)
                np.add.at(sums, owner[known], weights[place[known]])
                rest = found[~known]
                rows = pa.array(at + np.concatenate([np.arange(len(urls)), owner[~known]]))
                gram = pa.concat_arrays([pa.nulls(len(urls), pa.int64()), pa.array(rest, pa.int64())])
                weight = pa.concat_arrays([pa.array(sums), pa.nulls(len(rest), pa.int64())])
                yield pa.RecordBatch.from_arrays([keys.take(rows), gram, weight], ["key", "gram", "weight"])

    return run


def url_scores(urls: DataFrame, counts: DataFrame, own: Workspace, common: int = COMMON) -> DataFrame:
    """(key, score) of distinct (key, url, n); nats a character."""
    asked = own.table(gram_counts(urls).withColumnRenamed("n", "times"), "asked")
    weights = own.table(gram_weights(counts, asked), "weights")
    most = weights.orderBy(F.desc("times"), "gram").limit(common)
    held = sorted((r.gram, r.weight) for r in most.collect())
    grams, values = np.array([g for g, _ in held] or [-1]), np.array([w for _, w in held] or [0])
    worded = urls.where("url <> ''").select("key", "url")
    cut = own.table(worded.mapInArrow(_weigh(grams, values), "key binary, gram long, weight long"), "cut")
    other = cut.where("gram is not null").select("key", "gram").join(weights.select("gram", "weight"), "gram").select("key", "weight")
    total = cut.where("gram is null").select("key", "weight").unionByName(other).groupBy("key").agg(F.sum("weight").alias("sum"))
    sizes = worded.select("key", F.char_length("url").alias("size"))
    return total.join(sizes, "key").select("key", (F.col("sum") / F.lit(float(UNIT)) / F.col("size")).alias("score"))


def judge_urls(pages: DataFrame, rules=RULES, common: int = COMMON) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    own = Workspace(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("match", matched_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("verdict"))

    # Every URL once, with its number of rows. Of labelled ones a fifth is held out.
    held = F.col("verdict").isNotNull() & (F.pmod(F.xxhash64(F.lit(31), "url"), F.lit(5)) == 0)
    kinds = rows.where("url is not null").groupBy("url", "verdict").agg(F.count(F.lit(1)).alias("n"))
    kinds = own.table(kinds.select("url", "verdict", "n", held.alias("held"), F.unhex(F.md5("url")).alias("key")), "kinds")
    fitted = kinds.where("verdict is not null and not held")
    sides = {c: gram_counts(fitted.where(F.col("verdict") == v)) for c, v in (("accepted", "allow"), ("rejected", "block"))}
    zero = F.lit(0).cast("long")
    both = sides["accepted"].select("gram", F.col("n").alias("accepted"), zero.alias("rejected")).unionByName(sides["rejected"].select("gram", zero.alias("accepted"), F.col("n").alias("rejected")))
    counts = own.table(both.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "counts")

    none = F.lit(0.0)
    told = counts.agg(F.max("accepted").alias("a"), F.max("rejected").alias("r")).first()
    if not told.a or not told.r:
        free = rows.where("verdict is null").withColumn("score", none)
        threshold = 0.0
        own.close()
    else:
        scores = own.table(url_scores(kinds.where("held or verdict is null"), counts, own, common), "scores")
        # Held-out rows by steps of the score: a few thousand sums, however many rows.
        marks = kinds.where("held").join(scores, "key", "left").groupBy(F.floor(F.coalesce("score", none) * STEPS).alias("step")).agg(
            F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allow"), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("block")
        )
        threshold = calibrate_steps([(r.step, r.allow, r.block) for r in marks.collect()])
        free = rows.where("verdict is null").withColumn("key", F.unhex(F.md5("url"))).join(scores, "key", "left").withColumn("score", F.coalesce("score", none))
        own.close(scores)
    columns = ("page_id", "host", "path", "rule")
    judged = free.select(*columns, F.when(F.col("score") > threshold, "block").otherwise("allow").alias("verdict"), "score")
    return rows.where("verdict is not null").select(*columns, "verdict", F.lit(None).cast("double").alias("score")).unionByName(judged)


def calibrate_steps(marks: list[tuple[int, int, int]]) -> float:
    """As ``calibrate``, of (step, accepted, rejected) sums: between two steps that hold
    rows, in the middle of the gap."""
    marks = sorted(marks)
    allow, block = (np.array([m[k] for m in marks], float) for k in (1, 2))
    if not allow.sum() or not block.sum():
        return 0.0
    steps = np.array([m[0] for m in marks], float)
    missed = np.concatenate([[0], np.cumsum(block)]) / block.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(allow)]) / allow.sum()
    k = int(np.argmin(missed + wrong))
    low = steps[k - 1] + 1 if k else steps[0]
    high = steps[k] if k < len(steps) else steps[-1] + 1
    return max(0.0, float(low + high) / 2 / STEPS)
