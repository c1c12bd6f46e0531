import zlib

import numpy as np
import pytest

from halyard.llm.lang_id import ORDER, PpmModel, has_letter, identify_languages

SAMPLES = {"aa": [b"abcabcabc abd", b"abca"], "bb": [b"xyzzy xyz bca", b"abxyz"]}


def slow_bits(model, raw, lang):
    """Code length by walking the tree from the counts."""
    samples = SAMPLES[lang]
    a = model.alphabet
    sym = lambda r: [0] * ORDER + [int(model.symbol_of[b]) for b in r]
    rows = {}
    union = {}
    for name, texts in SAMPLES.items():
        for t in texts:
            s = sym(t)
            for i in range(ORDER, len(s)):
                for d in range(ORDER + 1):
                    c = tuple(s[i - d : i])
                    union[c] = union.get(c, 0) + 1
                    if name == lang:
                        rows.setdefault(c, {})
                        rows[c][s[i]] = rows[c].get(s[i], 0) + 1

    def dist(c):
        lower = dist(c[1:]) if c else [1 / a] * a
        n = rows.get(c)
        if n is None or (c and union[c] < 2):
            return lower
        total, kinds = sum(n.values()), len(n)
        left = sum(p for s, p in enumerate(lower) if s not in n)
        return [(n[s] if s in n else kinds * p / left) / (total + kinds) for s, p in enumerate(lower)]

    s, bits = sym(raw), 0.0
    for i in range(ORDER, len(s)):
        c = tuple(s[i - ORDER : i])
        while c and union.get(c, 0) < 2:
            c = c[1:]
        bits -= np.log2(dist(c)[s[i]])
    return bits


@pytest.mark.parametrize("raw", [b"abcabd", b"xyz", b"q?z", b"a", b"bca xy"])
def test_exact_code_lengths(raw):
    model = PpmModel.fit(SAMPLES)
    got = model.code_lengths([b"", raw, raw])
    assert got[0] == pytest.approx([0, 0])
    assert got[1] == pytest.approx([slow_bits(model, raw, lang) for lang in ("aa", "bb")], rel=1e-4)
    assert got[2] == pytest.approx(got[1])


def test_rows_are_distributions():
    model = PpmModel.fit(SAMPLES)
    p = np.exp2(-model.bits.astype(float)).reshape(-1, model.alphabet, 2)
    assert p.sum(1) == pytest.approx(np.ones((len(p), 2)), rel=1e-4)


def test_slices_equal_whole(monkeypatch):
    model = PpmModel.fit(SAMPLES)
    raw = b"abcabc xyz" * 50
    whole = model.code_lengths([raw])
    monkeypatch.setattr("halyard.llm.lang_id.SLICE", 37)
    assert model.code_lengths([raw, b"ab"])[0] == pytest.approx(whole[0], rel=1e-5)


def test_letters():
    assert [has_letter(x) for x in ("12 _", "½²", "a", "日", "")] == [False, False, True, True, False]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify_languages(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edge_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the of and", "en"), ("der die und", "de"), (None, "en"), ("", None), ("12 34", "en"), ("und " * 200_000, None)] * 2)]
    docs = spark.createDataFrame([*rows, (None, "the", "fr")], "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = identify_languages(docs).collect()
    assert len(got) == 13
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 4)) and all(0 <= r.score <= 1 for r in got)
    assert identify_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify_languages(docs.where("lang is null")).collect()} == {"und"}
