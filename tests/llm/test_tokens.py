import zlib
from itertools import product

import numpy as np
import pytest

from halyard.llm.common import scratch_path
from halyard.llm.packing import boundary_after, hilbert_keys, pack_documents
from halyard.llm.queries import tokenizer_path
from halyard.llm.token_files import read_document, read_token_files, round_trip, train_dictionary, write_token_files
from halyard.llm.tokenizing import WordCachedEncoder, encoder

ODD = [None, "", "  a  b\n\nc ", "a\n", "\n", "x\ty z", "it's  we'll 12 ½²\n\n", "<|endoftext|> a b", "日本 語 a", "a b,c.\nD!! e", "w " * 30_000]


def reference(text):
    ids = encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return [*ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(10 * k, t) for k, t in enumerate(ODD)], "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as part")


def test_cached_encoding_equals_library():
    enc = encoder(tokenizer_path())
    texts = [t or "" for t in ODD]
    assert [[*enc.ids(b).tolist(), 0] for b in enc.encode_many(texts)] == [reference(t) for t in texts]


def test_cache_is_bounded():
    """Small caches, long words, words of one line each: the ids do not change."""
    enc = WordCachedEncoder(tokenizer_path(), cache_words=40)
    texts = [f"word{k} Mot{'é' * (k % 60)} {'long' * k}, line\nAnd{chr(97 + k % 26)}z (x{k})!{'!' * k} it's-{k}" for k in range(300)]
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        assert [[*enc.ids(b).tolist(), 0] for b in enc.encode_many(part)] == [reference(t) for t in part]
        assert len(enc.older) + len(enc.cache) < 400
        assert max(map(len, [*enc.cache, *enc.tails]), default=0) <= 48


def test_long_documents_train_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr("halyard.llm.token_files.SAMPLE_IDS", 50)
    docs = spark.createDataFrame([(k, f"alpha beta {k} gamma " * 200) for k in range(40)], "doc_id long, text string")
    assert train_dictionary(docs, tokenizer_path())
    assert train_dictionary(docs, tokenizer_path()) == train_dictionary(docs.repartition(5), tokenizer_path())
    assert round_trip(docs, tokenizer_path()).count() == 40


def test_files_round_trip(spark, odd):
    got = {r.doc_id: r for r in round_trip(odd.repartition(3), tokenizer_path()).collect()}
    start = 0
    for k, text in enumerate(ODD):
        ids = reference(text)
        r = got[10 * k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_single_document_access(spark, odd):
    path = scratch_path(spark, "test-files")
    write_token_files(odd, path, tokenizer_path())
    for k in (2, 9):
        assert read_document(spark, path, 10 * k, tokenizer_path()) == reference(ODD[k])
    assert read_document(spark, path, 7, tokenizer_path()) is None
    full = {r.doc_id: r.ids for r in read_token_files(spark, path, tokenizer_path(), with_ids=True).collect()}
    assert full[20] == reference(ODD[2])


def test_table_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = 0
    got = {r.doc_id: r for r in round_trip(docs, tokenizer_path()).collect()}
    for row in docs.orderBy("doc_id").collect():
        ids = reference(row.text)
        assert (got[row.doc_id].start, got[row.doc_id].ids_crc32) == (start, crc(ids))
        start += len(ids)


def test_hilbert_is_a_path():
    cells = np.array(list(product(range(8), repeat=3)))
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_tail_sequences():
    total, seen = 3 * 1024 + 513 + 6, []
    at = 0
    while at < total:
        number, begin, end = boundary_after(at, total)
        assert begin == at
        seen.append((number, end - begin))
        at = end
    assert at == total and [n for n, _ in seen] == list(range(len(seen)))
    assert [s for _, s in seen] == [1024] * 3 + [512, 4, 2, 1]


def check_packing(rows, texts):
    at, by_doc = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(at) == list(range(len(at)))
    assert all(n <= 1024 and n & (n - 1) == 0 for n in at.values())
    for doc_id, text in texts.items():
        ids, start = reference(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (start, len(ids), crc(ids[start : start + r.length]))
            start += r.length
        assert start == len(ids)


def test_packing(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_packing(pack_documents(docs, tokenizer_path()).collect(), {r.doc_id: r.text for r in docs.collect()})
    check_packing(pack_documents(odd, tokenizer_path()).collect(), {10 * k: t for k, t in enumerate(ODD)})


def test_empty_and_repeated(spark, odd):
    assert pack_documents(odd.limit(0), tokenizer_path()).count() == 0
    assert round_trip(odd.limit(0), tokenizer_path()).count() == 0
    twice = odd.where("doc_id < 50")
    twice = twice.union(twice)
    assert sum(r.length for r in pack_documents(twice, tokenizer_path()).collect()) == 2 * sum(len(reference(t)) for t in ODD[:5])
