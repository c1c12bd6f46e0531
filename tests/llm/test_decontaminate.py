"""Benchmark windows in documents, against a loop over all positions."""

import random
import re

from pyspark.sql import functions as F

from halyard.llm.decontaminate import Words, contaminated_windows, covered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    known = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            known.setdefault(tuple(w[k : k + n]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(docs, items, **options):
    found = contaminated_windows(docs, items, **options).select("doc_id", "n_words", covered(F.col("windows")).alias("hit"), "items")
    return sorted(((r.doc_id, r.n_words, r.hit, tuple(r["items"] or ())) for r in found.collect()), key=str)


def test_words():
    w = Words(["Éa B-c1", None, "", "x", "-- ab\x7fZ "])
    assert w.count.tolist() == [3, 0, 0, 1, 2]
    assert [w.text(k, k + 1) for k in range(6)] == ["Éa", "b", "c1", "x", "ab", "z"]
    assert w.text(0, 3) == "Éa b c1"


def test_windows(spark):
    rng = random.Random(5)
    alphabet = "the of a quick brown fox Jumps over lazy dog é ß 7".split()
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(1, text(30)), (2, text(10)), (2, text(12)), (None, text(11)), (4, "brown the"), (5, "of a quick brown fox"), (6, ""), (7, None), (8, "...!"), (10, text(9)), (9, "7 7 7 7 7 7")]
    passages = [t for _, t in items if t]
    docs = [(k, " ".join([text(rng.randrange(40)), rng.choice(passages).replace(" ", ", "), text(5)])) for k in range(60)]
    docs += [(3, None), (4, ""), (None, passages[0]), (None, passages[0]), (5, " ".join(passages) * 30), (6, "7 " * 500), (7, passages[1].upper()), (8, passages[0].rsplit(" ", 25)[0])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert run(d, i) == brute(docs, items)
    assert run(d.repartition(5), i, window=6, shingle=2) == brute(docs, items, 6)
    extra = d.withColumn("row", F.lit("x")).withColumn("hits", F.lit("y"))
    assert run(extra, i.withColumn("words", F.lit(1))) == brute(docs, items)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(d, none) == [(1, 2, 0, ())]
    assert run(d.where("false"), none) == []
