"""Findings of round 3 on the corpus operators."""

import random

from halyard.llm import common, packing
from halyard.llm import jaccard as J
from halyard.llm.queries import tokenizer_path


def test_long_sets_that_meet_by_chance_are_not_paired(spark):
    """pipeline: in crowded keys and star rounds only pairs that may be similar are formed."""
    rng, texts = random.Random(6), []
    for size in (100, 300, 2500, 6000, 6100, 12000, 17000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        near = words[: size * 19 // 20]
        near[size // 2] = "x"
        texts += [" ".join(words), " ".join(near), *(" ".join(f"v{rng.randrange(10**6)}" for _ in range(size)) for _ in range(3))]
    name, make = J.Namer(J.set_digest), J.Shingler(5)
    found = {name(make(t)): set(make(t).tolist()) for t in texts}
    want = {(a, b) for a in found for b in found if a < b and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])}
    placed = spark.createDataFrame([(1, node, len(s), node) for node, s in found.items()], "key long, node long, size int, root long")
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = frame.mapInArrow(J._set_table(5, name), "node long, tokens array<bigint>, sketch array<bigint>, small array<bigint>, slim array<bigint>")
    got = {(r.a, r.b) for r in J.crowded_pairs(placed, sets, 80).collect()}
    assert len(want) == 7 and want <= got and len(got - want) <= 3
    offered = {(r.a, r.b) for r in J.chief_pairs(placed, sets, 80, 1).collect()}
    assert len(offered) <= 2 and offered <= got


def test_every_labelled_url_counts(spark):
    """models are fitted on all labelled URLs but the held-out fifth, which places the threshold."""
    from pyspark.sql import functions as F

    from halyard.llm.url_filter import CharacterModel, UrlRatio, judge_urls

    urls = [f"http://s{k}.com/{k % 7}" for k in range(30_000)] + [f"https://x{k * 7}.net/fr/{k}" for k in range(3_000)] * 2 + [f"http://y{k}.org/fr/é{k}" for k in range(40)] + ["", None, "y" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert {k: r for k, r in got.items()} == {r.page_id: r for r in judge_urls(pages, common=9).collect()}
    split = pages.where("url is not null").select("page_id", F.pmod(F.xxhash64(F.lit(31), "url"), F.lit(5)).alias("h"))
    fitted = {r.page_id for r in split.where("h <> 0").collect()}
    sides = [CharacterModel.fit([u for k, u in enumerate(urls) if k in fitted and got[k].rule and got[k].verdict == v]) for v in ("allow", "block")]
    ratio = UrlRatio(*sides)
    free = [k for k in got if got[k].rule is None]
    assert len(got) == len(urls) and len(free) == 43
    assert all(abs(got[k].score - ratio.score(urls[k])) < 1e-6 for k in free)
    assert {got[k].verdict for k in free if urls[k] and "fr" in urls[k]} == {"block"}


def test_driver_collects_garbage_between_tables(spark, monkeypatch):
    """pipeline: a heap past its part of the limit is emptied when a table is written."""
    own, runs = common.Workspace(spark, "test-heap"), []
    monkeypatch.setattr(common.Workspace, "release", lambda self: runs.append(1))
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    taken = heap.totalMemory() / heap.maxMemory()
    for part in (1.1, taken / 2):
        monkeypatch.setattr(common, "HEAP_PART", part, raising=False)
        assert own.table(spark.range(3), "some").count() == 3
        assert len(runs) == (part < taken)


def test_driver_loads_no_vocabulary_to_pack(spark):
    """pipeline: the width of ids is read from the ids, on the executors."""
    packing.encoder.cache_clear()
    rows = packing.pack_documents(spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string"), tokenizer_path()).collect()
    assert {r.doc_id for r in rows} == {1, 2} and packing.encoder.cache_info().currsize == 0


def test_near_copies_run_no_plans_for_nothing(spark, monkeypatch):
    """pipeline: components are made anew only where links were found, and rows that their ids
    tell apart need no branch for repeated ids."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[20 * i : 20 * i + 20]) for i in range(20)]
    runs, forest = [], J.forest
    monkeypatch.setattr(J, "forest", lambda edges, own: runs.append(1) or forest(edges, own))
    alone = J.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in alone.collect()} == set(range(20)) and not runs
    rows = list(enumerate([*texts, texts[3] + " more", None]))
    plan = (kept := J.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")))._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id for r in kept.collect()} == {*range(20), 21} and len(runs) == 1
    assert "MapInArrow" not in plan
    rows.append((0, texts[0]))  # a repeated id: one row of it stays
    assert sorted(r.doc_id for r in J.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [*range(20), 21]
