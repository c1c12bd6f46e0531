"""Exact dedup by a log-structured merge index of text digests.

Rows arrive in memtables. Each is folded to one entry a digest (smallest
identifier, number of rows) and flushed as a run sorted by digest; a run that is
looked up gets a bit filter beside it. A new memtable is looked up in every
older run: digests that the run's filter rules out never meet its entries. When
a level holds ``FANOUT`` runs they are merged into one run of the next level,
and compaction merges what is left; the smallest identifier stays.

Hits (digests of more than one row) are verified byte by byte: their texts are
fetched through a filter of fixed size, and each digest's least and greatest
text must be equal. Digests of more than one text (a weak digest) are regrouped
by SHA-256 first, so a digest collision never drops a text.

Everything is a DataFrame operation, the plan is one for all sizes, and texts
move only for hits. A hot digest meets in aggregates that combine on the map
side; digests of more than a 2000th of all rows (2000 at most) are joined by
broadcast, the others by key.

Defined results: a null text counts as empty; equal rows (also equal ids) are
one group of which exactly one row is kept; an empty table gives an empty
result; extra columns are ignored; a row without an id stays only where all of
its group have none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import SPACE_RE, Workspace, bit_filter, maybe_in, row_hash, text_or_empty, whole_rows

#: Memtables of one bulk load, and runs a level holds before they are merged.
MEMTABLES = 2
FANOUT = 2
#: A digest of more than this part of all rows is hot.
HOT_PART = 2000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RE, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


class DigestIndex:
    """Levels of runs under one folder of the shared file system.

    An entry is (digest, first, n, lo, hi): the smallest identifier, the number
    of rows, and the least and greatest SHA-256 among them. A run's filter is
    written when it is first asked for.
    """

    def __init__(self, spark: SparkSession, workspace: Workspace | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.workspace = workspace or Workspace(spark, "digest-index")
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.filters: dict[int, DataFrame] = {}

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(runs := self.levels[level]) < self.fanout:
            return
        self.levels[level] = []
        merged = self.workspace.table(_merged(runs).sortWithinPartitions("digest"), f"run-{level + 1}")
        self.workspace.drop(*runs, *[self.filters.pop(id(r), None) for r in runs])
        self._push(merged, level + 1)

    def _filter(self, run: DataFrame) -> DataFrame:
        if id(run) not in self.filters:
            self.filters[id(run)] = self.workspace.table(bit_filter(run, "digest"), "filter")
        return self.filters[id(run)]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, rows: DataFrame) -> DataFrame:
        """Take (digest, doc_id, uid, text_sha256) rows as one memtable.

        Returns the memtable's digests that are hits: held by more than one row
        of it, or by an older run.
        """
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")
        entries = rows.groupBy("digest").agg(
            first, F.count(F.lit(1)).alias("n"), F.min("text_sha256").alias("lo"), F.max("text_sha256").alias("hi")
        )
        run = self.workspace.table(entries.sortWithinPartitions("digest"), "run-0")
        hits = [run.where("n > 1").select("digest"), self.probe(run).select("digest")]
        found = self.workspace.table(reduce(DataFrame.unionByName, hits).distinct(), "hits")
        self._push(run, 0)
        return found

    def probe(self, digests: DataFrame) -> DataFrame:
        """Entries of older runs for the given digests (column ``digest``)."""
        wanted = digests.select("digest")
        found = [run.join(maybe_in(wanted, "digest", self._filter(run)), "digest", "left_semi") for run in self.runs()]
        return _merged(found) if found else digests.limit(0)

    def compacted(self) -> DataFrame:
        """One entry a digest over all runs."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else _merged(runs)


def _merged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).groupBy("digest").agg(
        F.min("first").alias("first"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def _joined(rows: DataFrame, entries: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` with their entry's columns. Entries of many rows are few, since
    each stands for more than a ``HOT_PART``-th of ``total``."""
    hot = F.broadcast(entries.where(F.col("n") * HOT_PART > total))
    rest = rows.join(hot, on, "left_anti").join(entries.where(F.col("n") * HOT_PART <= total), on)
    return rows.join(hot, on).unionByName(rest)


def exact_groups(documents: DataFrame, digest: Callable[[Column], Column] | None = None, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, uid, keep_id, group_size, kept, text_sha256 for every row.

    ``uid`` numbers the rows of this call; it parts rows of equal id.
    ``digest`` may be any function of the normalised text, weak ones too; the
    SHA-256 itself if none is given.
    """
    spark = documents.sparkSession
    own = workspace or Workspace(spark, "exact-dedup")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).alias("norm"))
    rows = source.select("doc_id", F.monotonically_increasing_id().alias("uid"), sha256_hex(F.col("norm")).alias("text_sha256"), *([digest(F.col("norm")).alias("digest")] if digest else []))
    if digest is None:
        rows = rows.withColumn("digest", F.unhex("text_sha256"))
    seen = Observation()
    rows = own.table(rows.observe(seen, F.count(F.lit(1)).alias("n")), "rows")
    total = seen.get["n"]

    index = DigestIndex(spark, own)
    turn = F.pmod(F.xxhash64(F.lit(3), "doc_id", "uid"), F.lit(MEMTABLES))
    hits = [index.add(rows.where(turn == k)) for k in range(MEMTABLES)]
    level = index.compacted()

    columns = ["doc_id", "uid", "text_sha256", "first", "n"]
    out = _joined(rows, level.where("lo = hi"), ["digest"], total).select(columns)
    suspects = level.where("lo <> hi").select("digest", "n")
    if suspects.limit(1).count():
        # Digests of several texts are regrouped with the whole text's own hash.
        parts = own.table(_joined(rows, suspects, ["digest"], total).drop("n"), "suspects")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")
        regrouped = parts.groupBy("digest", "text_sha256").agg(first, F.count(F.lit(1)).alias("n"))
        out = out.unionByName(_joined(parts, regrouped, ["digest", "text_sha256"], total).select(columns))
    out = out.select(
        "doc_id", "uid", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256"
    )
    out = own.table(out, "groups")

    # Byte verification of the hits; their rows are found by id, through a filter.
    members = rows.join(reduce(DataFrame.unionByName, hits).distinct(), "digest", "left_semi")
    texts = maybe_in(source, "doc_id", bit_filter(members, "doc_id")).withColumn("text_sha256", sha256_hex(F.col("norm")))
    spread = texts.groupBy("text_sha256").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    if spread.where("least <> greatest").limit(1).count():
        raise ArithmeticError("different texts share a SHA-256; no group can be told by it")
    own.close(out)
    return out


def drop_exact_copies(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns.

    A row whose id is in no group of two or more stays where it is. The others
    meet by id and text: of rows that share both, the one of the least hash.
    """
    spark = documents.sparkSession
    own = Workspace(spark, "exact-copies")
    groups = exact_groups(documents, workspace=own)
    copies = groups.where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    keys = [F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_none"), "_sha"]
    verdicts = own.table(copies.groupBy(*keys).agg(F.max("kept").alias("_kept")), "verdicts")
    ids = verdicts.select(F.when(~F.col("_none"), F.col("_id")).alias("_id"))
    bits = own.table(bit_filter(ids, "_id"), "copy-filter")
    own.drop(groups)
    named = whole_rows(documents, F.col("doc_id").cast("long").alias("_own"))
    alone = maybe_in(named, "_own", bits, inside=False)
    met = maybe_in(named, "_own", bits).withColumn("_sha", sha256_hex(normalised(text_or_empty("row.text"))))
    same = [F.coalesce("_own", F.lit(0)).alias("_id"), F.col("_own").isNull().alias("_none"), "_sha"]
    one = met.groupBy(*same).agg(F.min_by("row", row_hash(documents)).alias("row"))
    stay = one.join(verdicts, ["_id", "_none", "_sha"], "left").where(F.coalesce("_kept", F.lit(True)))
    return alone.select("row").unionByName(stay.select("row")).select("row.*")
