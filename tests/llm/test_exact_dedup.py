from collections import Counter

from pyspark.sql import functions as F

from halyard.llm.exact_dedup import DigestIndex, drop_exact_copies, exact_groups

ROWS = [(5, "a  b"), (1, "a b"), (2, "a\t b"), (3, None), (4, ""), (4, ""), (6, "z"), (None, "a b"), (7, "c " * 50_000)]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as digest", "2 as uid")


def test_groups(spark):
    got = exact_groups(frame(spark)).collect()
    assert len(got) == len(ROWS)
    size = {r.doc_id: r.group_size for r in got}
    assert size[1] == size[2] == size[5] == size[None] == 4
    assert size[3] == size[4] == 3 and size[6] == size[7] == 1
    assert sum(r.kept for r in got) == 4
    assert {r.doc_id: r.keep_id for r in got}[4] == 3


def test_weak_digest_is_verified(spark):
    """With a digest of one value all texts collide; verification parts them."""
    docs = frame(spark)
    weak = exact_groups(docs, digest=lambda text: F.lit("same")).drop("uid").collect()
    true = exact_groups(docs).drop("uid").collect()
    assert sorted(map(str, weak)) == sorted(map(str, true))
    part = exact_groups(docs, digest=lambda text: F.length(text)).drop("uid").collect()
    assert sorted(map(str, part)) == sorted(map(str, true))


def test_rows_without_id_do_not_collide(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "y"), (1, "z")], "doc_id long, text string")
    got = exact_groups(docs, digest=lambda text: F.lit("same")).collect()
    assert [r.group_size for r in got] == [1, 1, 1] and all(r.kept for r in got)


def test_index_grows_run_by_run(spark):
    """Memtables in turn: hits are told against older runs, levels merge."""
    def rows(ids):
        return spark.createDataFrame([(f"d{k % 10}".encode(), k, k, f"s{k % 10}") for k in ids], "digest binary, doc_id long, uid long, text_sha256 string")

    index = DigestIndex(spark)
    seen, counts = set(), Counter()
    for ids in ([31, 22, 13], [4, 14, 25], [6, 33], [2, 99, 57], [8]):
        found = {bytes(r.digest).decode() for r in index.add(rows(ids)).collect()}
        new = Counter(f"d{k % 10}" for k in ids)
        assert found == {d for d, n in new.items() if n > 1 or d in seen}
        seen |= set(new)
        counts += new
    assert [len(level) for level in index.levels] == [1, 0, 1]
    got = {bytes(r.digest).decode(): (r["first"].doc_id, r.n) for r in index.compacted().collect()}
    every = [31, 22, 13, 4, 14, 25, 6, 33, 2, 99, 57, 8]
    assert got == {d: (min(k for k in every if f"d{k % 10}" == d), n) for d, n in counts.items()}
    hit = index.probe(spark.createDataFrame([(b"d3",), (b"none",)], "digest binary")).collect()
    assert [(bytes(r.digest), r.n) for r in hit] == [(b"d3", 2)]


def test_hot_digest(spark):
    """A third of all rows in one group, with and without an id."""
    docs = spark.range(900).selectExpr("if(id % 7 = 0, null, id) as doc_id", "if(id % 3 = 0, 'hot', 't' || id) as text", "id as place")
    kept = drop_exact_copies(docs).collect()
    assert len(kept) == 601 and [r.doc_id for r in kept if r.text == "hot"] == [3]
    assert drop_exact_copies(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 601


def test_filter_keeps_one_row_a_text(spark):
    docs = frame(spark)
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 6, 7]
    twice = docs.where("doc_id = 6").union(docs.where("doc_id = 6"))
    assert drop_exact_copies(twice).count() == 1


def test_filter_keeps_rows_without_an_id(spark):
    """Beside an equal text with an id they go; else one row a text stays."""
    lone = spark.createDataFrame([(None, "q"), (None, "w  w"), (None, "w w"), (None, None), (None, "q")], "doc_id long, text string")
    docs = frame(spark).unionByName(lone.selectExpr("*", "1 as kept", "'x' as digest", "2 as uid"))
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 6, 7]
    assert sorted(" ".join(r.text.split()) for r in rows if r.doc_id is None) == ["q", "w w"]


def test_empty(spark):
    assert exact_groups(frame(spark).limit(0)).count() == 0
