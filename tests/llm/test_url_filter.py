import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm.url_filter import RULES, CharacterModel, UrlRatio, _codes, calibrate, judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(LOWER), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


ODD = [None, "", "example.com/en/", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://com", "http://com/", "http://xcom/", "http://a.net/es/://b.com/", "http://é.example.com/en/", "x://a.net#/fr/", "http://a.net/fr/\nq", "https://a.net?/es/", "http://" + "a" * 100_000 + ".org/"]


def test_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1 - k, u) for k, u in enumerate(ODD)], "page_id long, url string")
    both = pages.union(odd).union(odd).withColumn("host", F.lit(1)).withColumn("verdict", F.lit("x"))
    urls = [(r.page_id, r.url) for r in both.collect()]
    got = judge_urls(both).collect()
    assert len(got) == len(urls)
    url_of = dict(urls)
    for r in got:
        host, path, rule, verdict = brute(url_of[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)


def test_model_is_a_distribution():
    model = CharacterModel.fit(["abcab", "abd", "http://x"])
    for context in ("", "a", "ab", "zz"):
        codes = [np.concatenate([_codes(context), [s]]).astype(np.int64) for s in range(97)]
        assert sum(np.exp(model.log_likelihood(c)[-1]) for c in codes) == pytest.approx(1)


def test_ratio_parts_classes():
    good = [f"https://www.site{k}.org/news/{k}" for k in range(300)]
    bad = [f"http://cheap-pills.shop{k}.biz/buy?id={k}" for k in range(300)]
    ratio = UrlRatio(CharacterModel.fit(good[:200]), CharacterModel.fit(bad[:200]))
    assert max(map(ratio.score, good[200:])) < min(map(ratio.score, bad[200:]))
    assert calibrate(np.array([-1, 0.2, 0.6, 1.0]), np.array([False, False, True, True])) == pytest.approx(0.4)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in judge_urls(df).collect()] == ["allow", "allow"]
    assert judge_urls(df.limit(0)).count() == 0
