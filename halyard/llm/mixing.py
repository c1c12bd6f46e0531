"""Mixing sources to target weights by a hypergeometric splitting tree.

1. Sizes (words) of all documents are counted; a budget is shared out over the
   sources by weight, each source capped at a multiple of its size.
2. The documents of a source fall into blocks of about ``DOCS_A_BLOCK`` by a hash
   of their id. Blocks are drawn in permuted order, in as many passes as the
   target needs; each drawn pass of a block is one ball, and their number is the
   source's quota. The block in which the target ends is settled document by
   document.
3. A tree deals the balls of all sources to output shards: each node sends a
   uniformly drawn half of its balls to its left child and the rest to its right
   one, which splits the quotas by a multivariate hypergeometric draw. A
   document is taken once for every ball of its block that a shard got, so
   shards hold disjoint balls, and each is shuffled locally.

All of it is DataFrame operations. Nothing is ordered whole: prefix sums and
halves are found over ``CELLS`` cells of a hash, and only the cell in which the
end falls is ordered row by row.

Defined results: a null text has size 0; documents of size 0 add no words;
sources order by code point with null last; equal rows are drawn independently
of their order; an empty table gives an empty mix; the same seed gives the same
mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm.common import WORD_RE, Workspace, bit_filter, maybe_in, row_hash, text_or_empty, whole_rows

#: Weights by a source's place, repeating; the contract's fixed values.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET_SHARE = 1.5
CAP = 2.0
DOCS_A_BLOCK = 64
CELL_BITS = 12
#: Parts into which a shard is written.
SHARD_PARTS = 64


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD_RE})"), F.lit(1))).cast("long")


def _uniform_key(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _cell(key: Column) -> Column:
    """One of 2**CELL_BITS cells; keys of a lower cell come first in its order."""
    return F.shiftrightunsigned(key, 64 - CELL_BITS)


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, cap: float = CAP
) -> DataFrame:
    """(source, source_size, docs) -> with weight and target.

    The water level of the capped sharing is found in closed form: sources sorted
    by the level at which they fill up, the first level that does not fill its
    own source. One row a source, so the ordered window is over sources only.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = totals.withColumn("place", F.row_number().over(place) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("fills", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (
        ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("reached", F.when(F.col("level") <= F.col("fills"), F.col("level")))
        .withColumn("water", F.max("reached").over(every))
    )
    target = F.when(F.col("fills") <= F.col("water"), F.col("cap")).otherwise(F.col("weight") * F.col("water"))
    return levelled.select("source", "place", "source_size", "docs", "weight", F.coalesce(target, F.col("cap")).alias("target"))


@dataclass
class Mix:
    documents: DataFrame  # doc_id, uid, source, size, source_size, target, copies, taken, shards
    shards: DataFrame  # shard, place, quota


def deal(balls: DataFrame, shards: int, seed: int, own: Workspace) -> DataFrame:
    """(place, block, pass) -> with shard; every level halves each node exactly.

    The half of the balls with the least hashes goes left. Counts by cell tell
    the cell in which the half ends (one row a node, ``shards`` at most); its
    balls alone are ranked.
    """
    nodes = balls.select("place", "block", "pass", F.lit(0).cast("long").alias("node"))
    past = None
    for level in range(int(math.log2(shards))):
        drawn = nodes.withColumn("r", _uniform_key(seed + level, "node", "place", "block", "pass")).withColumn("cell", _cell(F.col("r")))
        in_node = Window.partitionBy("node")
        upto = in_node.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = (
            drawn.groupBy("node", "cell").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0)))
            # The odd ball of a node goes left in every other node.
            .withColumn("half", F.floor((F.sum("n").over(in_node) + F.col("node") % 2) / 2))
        )
        ends = cells.where("below < half and half <= below + n").select("node", F.col("cell").alias("end"), (F.col("half") - F.col("below")).alias("room"))
        placed = drawn.join(F.broadcast(ends), "node", "left")
        clear = placed.where("end is null or cell <> end").withColumn("left", F.coalesce(F.col("cell") < F.col("end"), F.lit(False)))
        within = Window.partitionBy("node").orderBy("r", "place", "block", "pass")
        edge = placed.where("cell = end").withColumn("left", F.row_number().over(within) <= F.col("room"))
        child = (F.col("node") * 2 + F.when(F.col("left"), 0).otherwise(1)).alias("node")
        nodes = own.table(clear.select("place", "block", "pass", child).unionByName(edge.select("place", "block", "pass", child)), "mix-level")
        own.drop(past)
        past = nodes
    return nodes.withColumnRenamed("node", "shard")


def mix_sources(
    documents: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = BUDGET_SHARE,
    cap: float = CAP,
    shards: int = 8,
    seed: int = 20,
) -> Mix:
    """Draw the mix. ``shards`` is a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    own = Workspace(documents.sparkSession, "mix")
    sized = own.table(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("uid"),
            F.col("source").cast("string").alias("source"),
            word_count(text_or_empty()).alias("size"),
            F.xxhash64(text_or_empty()).alias("text_key"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / DOCS_A_BLOCK)).cast("long")
    sources = own.table(source_targets(totals, weights, share, cap).withColumn("n_blocks", blocks_of), "sources")
    # Joined by its name; equal rows of a source are spread by a salt, as one source
    # may hold a third of all rows.
    spread = F.explode(F.sequence(F.lit(0), F.lit(SHARD_PARTS - 1)))
    salted = sources.withColumn("_salt", spread)
    named = sized.withColumn("_salt", F.pmod(F.xxhash64(F.lit(seed + 9), "uid"), F.lit(SHARD_PARTS)).cast("int"))
    keyed = named.join(salted, (named["_salt"] == salted["_salt"]) & named["source"].eqNullSafe(salted["source"])).drop(salted["source"]).drop("_salt")
    # The order key permutes a source's documents; equal rows are interchangeable.
    keyed = keyed.withColumn("key", _uniform_key(seed, "doc_id", "text_key")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed + 7), "doc_id", "text_key"), F.col("n_blocks"))
    )
    blocks = own.table(
        keyed.groupBy("place", "block").agg(
            F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
        ),
        "blocks",
    )
    # Whole passes first, then the words that are left of the target: cells of blocks
    # in permuted order, then the blocks of the cell in which the target ends.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    blocks = (
        blocks.withColumn("passes", passes)
        .withColumn("left_over", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("r", _uniform_key(seed + 1, "place", "block"))
        .withColumn("cell", _cell(F.col("r")))
    )
    in_order = Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = blocks.groupBy("place", "cell").agg(F.sum("words").alias("cell_words"))
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_words").over(in_order), F.lit(0))).select("place", "cell", "before")
    in_cell = Window.partitionBy("place", "cell").orderBy("r", "block").rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        blocks.join(cells, ["place", "cell"])
        .withColumn("upto", F.col("before") + F.sum("words").over(in_cell))
        .withColumn("begin", F.col("upto") - F.col("words"))
        .withColumn("whole", F.col("upto") <= F.col("left_over"))
        .withColumn("split", (~F.col("whole")) & (F.col("begin") < F.col("left_over")) & (F.col("words") > 0))
        .withColumn("draws", F.col("passes") + (F.col("whole") | F.col("split")).cast("long"))
    )
    ordered = own.table(ordered.select("place", "block", "passes", "left_over", "begin", "split", "draws"), "order")
    # The block in which the target ends: its documents in permuted order.
    edge = ordered.where("split").select("place", "block", (F.col("left_over") - F.col("begin")).alias("room"))
    within = Window.partitionBy("place", "block").orderBy("key", "doc_id", "text_key", "uid")
    inside = (
        keyed.join(edge, ["place", "block"])
        .withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        # A document joins if the larger part of it is inside the target.
        .where(F.col("upto") - F.col("size") / 2 <= F.col("room"))
        .where("size > 0")
        .select("uid", F.lit(True).alias("inside"))
    )
    # Each pass of a block is one ball; the tree deals them to the shards.
    balls = ordered.where("draws > 0").select("place", "block", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))).alias("pass"))
    dealt = deal(balls, shards, seed + 100, own)
    homes = dealt.groupBy("place", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))  # a ball a pass
    plan = ordered.select("place", "block", "passes", "split").join(homes, ["place", "block"], "left")
    chosen = keyed.join(plan, ["place", "block"]).join(inside, "uid", "left")
    got = F.coalesce("homes", F.array())
    got = F.when(F.col("split") & F.col("inside").isNull(), F.filter(got, lambda h: h["pass"] <= F.col("passes"))).otherwise(got)
    chosen = chosen.withColumn("got", got).withColumn("copies", F.size("got").cast("long"))
    out = chosen.select(
        "doc_id",
        "uid",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, F.transform("got", lambda h: h["shard"])).alias("shards"),
        "text_key",
    )
    quotas = dealt.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("quota"))
    return Mix(out, quotas)


def apply_mix(documents: DataFrame, **options) -> DataFrame:
    """The mixed rows of ``documents``: all columns, a row for each copy taken.

    A shard is written in ``SHARD_PARTS`` parts, each shuffled by hash. Of rows
    that share id and text the one of the least hash stands for all; their
    copies are counted by shard, so no list of them is held."""
    seed = options.get("seed", 20)
    own = Workspace(documents.sparkSession, "mixed")
    mix = mix_sources(documents, **options).documents
    taken = mix.where("copies > 0").select("doc_id", "text_key", F.explode("shards").alias("_shard"))
    counts = taken.groupBy("doc_id", "text_key", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col("doc_id").alias("_rid"), F.col("text_key").alias("_rkey"), "_shard", "_n")
    same = mix.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("text_key").distinct()
    bits = own.table(bit_filter(same, "text_key"), "repeated")
    left = whole_rows(documents, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_or_empty()).alias("_key"))
    one = maybe_in(left, "_key", bits).groupBy("_id", "_key").agg(F.min_by("row", row_hash(documents)).alias("row"))
    rows = maybe_in(left, "_key", bits, inside=False).unionByName(one.select("row", "_id", "_key"))
    joined = rows.join(counts, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_key") == F.col("_rkey")))
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return (
        copies.repartition(F.col("_shard"), F.pmod(F.xxhash64("_id", "_key", "_copy"), F.lit(SHARD_PARTS)))
        .sortWithinPartitions("_shard", F.xxhash64(F.lit(seed + 3), "_id", "_key", "_copy"))
        .select("row.*")
    )
