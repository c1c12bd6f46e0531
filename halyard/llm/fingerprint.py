"""Document fingerprints by a homomorphic multiset hash.

A text is cut into units: paragraphs (lines), long ones into runs of six words
counted from the paragraph's start.
Every unit gives wide hash vectors; a document's fingerprint is their sum,
lane by lane, modulo powers of two. Sums do not depend on the order of units,
and units are added or removed by adding or subtracting their vectors
(``combine`` and ``remove``).

Lanes: four 64-bit hashes as eight lanes modulo 2**32 (equality), the number of
units modulo 2**32, and from the bits of the hashes 240 one-bit lanes, three
packed in a word, modulo 2**20 (likeness: with signs, the mean square of the
difference of two lane vectors estimates the size of the symmetric difference).

All of it is DataFrame expressions; only the neighbour of a document is fetched
by one shuffle over ranges of ids.

Defined results: a null text is the empty text, which has no units; two empty
texts are alike (1.0); a text is alike to itself (1.0); equal ids are ordered by
text hash; a lone row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm.common import materialise, text_or_empty

SEEDS = (11, 23, 37, 53)
SHIFTS = 20
PACKED = 3
LANE_BITS = 20
#: Lanes lie one bit apart; the bit between takes the carry and is cleared.
STRIDE = LANE_BITS + 1
LANES = len(SEEDS) * SHIFTS * PACKED
MASK32 = (1 << 32) - 1
#: One bit in each of the three packed lanes, all of their bits, and the carries.
ONES = sum(1 << (STRIDE * k) for k in range(PACKED))
LANE_MASK = (1 << LANE_BITS) - 1
KEPT = ONES * LANE_MASK
CARRIES = ONES << LANE_BITS
ROWS_A_BUCKET = 512
MAX_RANGES = 1 << 16
UNIT_RE = r"(?:[^ \n]++ ?+){1,6}+"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def units(text: Column) -> Column:
    """Runs of at most six words of one paragraph; blank ones are left out."""
    return F.regexp_extract_all(text, F.lit(UNIT_RE), F.lit(0))


def hash_with(seed: int):
    # A default argument would be taken for the array's index.
    return lambda unit: F.xxhash64(F.lit(seed), unit)


def bits_from(k: int):
    return lambda h: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ONES))


def _lanes(hashed: list[Column]) -> Column:
    def total(hashes: Column, lane) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + lane(h))

    def modular(hashes: Column, lane) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + lane(h)).bitwiseAND(F.lit(KEPT)))

    lanes: list[Column] = []
    for h in hashed:
        lanes.append(total(h, lambda x: x.bitwiseAND(F.lit(MASK32))).bitwiseAND(F.lit(MASK32)))
        lanes.append(total(h, lambda x: F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(MASK32)))
    lanes.append(F.size(hashed[0]).cast("long"))
    for h in hashed:
        lanes += [modular(h, bits_from(k)) for k in range(SHIFTS)]
    return F.array(*lanes)


def fingerprint_lanes(text: Column) -> Column:
    """array<long>: eight equality lanes, the unit count, the packed lanes."""
    hashes = lambda us: F.array(*(F.transform(us, hash_with(s)) for s in SEEDS))
    return bind(units(text), lambda us: bind(hashes(us), lambda hs: _lanes([hs[k] for k in range(len(SEEDS))])))


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of two texts' units together."""
    return _masked(F.zip_with(a, b, lambda x, y: x + y))


def remove(a: Column, b: Column) -> Column:
    """Fingerprint of the units of ``a`` without those of ``b``."""
    # A set carry bit in front of each lane lends what the lane may lack.
    return _masked(F.zip_with(F.transform(a, lambda x, i: F.when(i < 9, x).otherwise(x.bitwiseOR(F.lit(CARRIES)))), b, lambda x, y: x - y))


def _masked(lanes: Column) -> Column:
    return F.transform(lanes, lambda x, i: F.when(i < 9, x.bitwiseAND(F.lit(MASK32))).otherwise(x.bitwiseAND(F.lit(KEPT))))


def to_hex(lanes: Column) -> Column:
    """The equality lanes and the count as hexadecimal digits."""
    return F.concat_ws("", F.transform(F.slice(lanes, 1, 9), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated 2 |A and B| / (|A| + |B|) over units, 0 to 1; 1 for equal ones."""
    n = lambda x: F.element_at(x, 9)
    lane = lambda word, k: F.shiftright(word, STRIDE * k).bitwiseAND(F.lit(LANE_MASK))
    turn = 1 << LANE_BITS

    def squares(x: Column, y: Column) -> Column:
        # Signed lane: twice the ones less the units, the nearest value modulo the lane.
        surplus = n(a) - n(b)
        middle = F.floor(surplus / 2)
        diffs = [F.pmod(lane(x, k) - lane(y, k) - middle + turn // 2, F.lit(turn)) - turn // 2 + middle for k in range(PACKED)]
        return reduce(lambda p, q: p + q, [(d * 2 - surplus) * (d * 2 - surplus) for d in diffs])

    words = len(SEEDS) * SHIFTS
    pairs = F.zip_with(F.slice(a, 10, words), F.slice(b, 10, words), squares)
    apart = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, v: acc + v) / F.lit(float(LANES))
    both = n(a) + n(b)
    estimate = F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(apart, both.cast("double")))
    equal = F.slice(a, 1, 9) == F.slice(b, 1, 9)
    return F.when(equal, 1.0).when((n(a) == 0) | (n(b) == 0), 0.0).otherwise(estimate)


def id_ranges(documents: DataFrame) -> Column:
    """Bucket of a row by (doc_id, tie), ascending, cut by the data.

    Boundaries are approximate quantiles of the ids, one for ``ROWS_A_BUCKET``
    rows and ``MAX_RANGES`` at most, so that wide, clustered or outlying ids make
    no large range. Rows without an id come first; those and the rows of an id
    that fills several ranges are parted by ``tie``, a hash of the text.
    """
    sizes = documents.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")).first()
    wanted = max(1, min(MAX_RANGES, sizes["named"] // ROWS_A_BUCKET))
    cuts: list[int] = []
    if sizes["named"] and wanted > 1:
        shares = F.from_json(F.lit(str([k / wanted for k in range(1, wanted)])), "array<double>")
        cuts = documents.agg(F.percentile_approx("doc_id", shares, F.lit(10 * wanted)).alias("q")).first()["q"]
    bounds = F.from_json(F.lit(str(list(cuts))), "array<bigint>")
    steps = len(cuts).bit_length()
    unnamed = max(1, -(-(sizes["n"] - sizes["named"]) * wanted // max(1, sizes["named"]))) if sizes["named"] else MAX_RANGES
    unnamed = min(MAX_RANGES, unnamed)
    # The tie as a share of its range, to part rows of one id in the order of ties.
    share = F.lit(0.5) + F.col("tie") / F.lit(2.0**64)

    def search(least: bool) -> Column:
        """How many boundaries are below the id (``least``) or not above it."""

        def step(span: Column, _: Column) -> Column:
            middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
            cut = F.element_at(bounds, F.least(middle + 1, F.lit(len(cuts))))
            right = (cut < F.col("doc_id")) if least else (cut <= F.col("doc_id"))
            right = right & (span["lo"] < span["hi"])
            return F.struct(F.when(right, middle + 1).otherwise(span["lo"]).alias("lo"), F.when(right | (span["lo"] >= span["hi"]), span["hi"]).otherwise(middle).alias("hi"))

        if not steps:
            return F.lit(0)
        begin = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step)["lo"]

    low, high = search(True), search(False)
    own = low + F.floor(share * (high - low + 1)).cast("int")
    return F.when(F.col("doc_id").isNull(), F.floor(share * unnamed).cast("int") - unnamed).otherwise(F.least(own, high)).cast("long")


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: the next row by id, cyclically.

    Rows fall into ranges by id; each range also gets the first row of the
    following one, so the neighbour is found inside a range. The ordered list of
    ranges has at most ``2 * MAX_RANGES`` rows, which are broadcast.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = base.withColumn("bucket", id_ranges(base.select("doc_id")))
    # Range by range: its first row, handed to the range before it.
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    order = Window.orderBy("bucket")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = materialise(
        firsts.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(every))).select(
            "before", F.col("bucket").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie")
        ),
        "id-ranges",
    )
    met = (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    # Equal rows may all be first; one a range is enough.
    guests = placed.join(F.broadcast(heads), met).groupBy("before", "doc_id", "tie").agg(F.min("text").alias("text"))
    guests = guests.select("doc_id", "text", "tie", F.col("before").alias("bucket"))
    # The following range's rows sort behind the range's own.
    union = placed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    union = union.repartition("bucket").withColumn("fp", fingerprint_lanes(F.col("text")))
    in_range = Window.partitionBy("bucket").orderBy("guest", "doc_id", "tie", "text")
    return (
        union.withColumn("next_text", F.lead("text").over(in_range))
        .withColumn("next_fp", F.lead("fp").over(in_range))
        .where("guest = 0")
    )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter of its
    code points replaced by the first of the next document), with likenesses."""
    rows = with_next(documents).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut)
    )
    rows = rows.withColumn("edited", edited).withColumn("edited_fp", fingerprint_lanes(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        to_hex(F.col("fp")).alias("fingerprint"),
        to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
