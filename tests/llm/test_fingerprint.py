import hashlib
from collections import Counter

from pyspark.sql import functions as F

from halyard.llm.fingerprint import combine, fingerprint_documents, fingerprint_lanes, id_ranges, likeness, remove, to_hex


def test_homomorphism_and_order(spark):
    df = spark.createDataFrame([("x y\nz", "z\nx y", "x y", "z")], "a string, b string, c string, d string")
    fp = {c: fingerprint_lanes(F.col(c)) for c in "abcd"}
    row = df.select(
        (to_hex(fp["a"]) == to_hex(fp["b"])).alias("order"),
        (combine(fp["c"], fp["d"]) == fp["a"]).alias("plus"),
        (remove(fp["a"], fp["d"]) == fp["c"]).alias("minus"),
        (to_hex(fp["a"]) == to_hex(fp["c"])).alias("other"),
    ).first()
    assert (row.order, row.plus, row.minus, row.other) == (True, True, True, False)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = {}
    for k, (doc_id, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 4
        want[doc_id] = (len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())
    got = fingerprint_documents(docs.repartition(5)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(want)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(texts)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) > 0.95 * len(by_text)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)
    assert abs(sum(r.near_edited for r in long) / len(long) - 0.75) < 0.08


def test_ranges_follow_the_data(spark, monkeypatch):
    """Wide, dense, repeated and missing ids in small ranges: the next text is the right one."""
    monkeypatch.setattr("halyard.llm.fingerprint.ROWS_A_BUCKET", 5)
    ids = [-(2**62), -(2**63), 0, 2**62, 2**63 - 1, *range(1, 60), *[7] * 30, *[None] * 25]
    rows = [(i, f"text {k} " + "word " * (k % 9)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    placed = docs.withColumn("bucket", id_ranges(docs.select("doc_id"))).collect()
    order = sorted(placed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.bucket for r in order] == sorted(r.bucket for r in order)
    assert max(Counter(r.bucket for r in placed).values()) <= 25
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint_documents(docs.select("doc_id", "text")).collect())
    want = Counter()
    for k, r in enumerate(order):
        after, cut = order[(k + 1) % len(order)].text, len(r.text) // 4
        want[(r.doc_id, len(r.text), hashlib.sha256((r.text[: len(r.text) - cut] + after[:cut]).encode()).hexdigest())] += 1
    assert got == want


def test_edge_rows(spark):
    rows = [(1, None), (5, ""), (5, ""), (9, "a b c d. e f"), (None, "q"), (10**12, "w x\n" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as bucket")
    got = fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    assert {r.near_edited for r in got if r.doc_id in (1, 5)} == {1.0}
    lone = fingerprint_documents(docs.where("doc_id = 9")).first()
    assert lone.near_next == 1.0
    assert fingerprint_documents(docs.limit(0)).count() == 0
