import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm.pii import detect_pii, find_spans, luhn

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    text = text or ""
    for m in EMAIL.finditer(text):
        out.append(("email", m.start(), m.end()))
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def base(text):
    return [s for s in find_spans(text) if s[0] in ("email", "ip", "card", "phone")]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aB.@-+% 0125()\n9é", max_size=40))
def test_base_equals_patterns_on_noise(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1.2.3.4", "255.1", ".", "a@b.c", "@d.e", "4111 1111 1111 1111", "4111111111111111", "+1 (988) 555-2485", " ", "x", "-", "+49-30 1234567", "256.1.1.1", "..", "a@b..c"]), max_size=8))
def test_base_equals_patterns_on_pieces(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("see https://ann:pw@example.org/x", "login"),
        ("see http://bob:" + "a" * 300 + "@host.org/", "login"),
        ("IBAN: DE89 3704 0044 0532 0130 00 please", "account"),
        ("IBAN number DE89370400440532013000", "account"),
        ("Kontonummer: DE89370400440532013000.", "account"),
        ("pay DE89370400440532013000 now", "account"),
        ("iban:" + " " * 40 + "GB82 WEST 1234 5698 7654 32", "account"),
        ("MT84 MALT 0110 0001 2345 MTLC AST0 01S", "account"),
        ("routing number: 021000021", "account"),
        ("SSN 123-45-6789,", "id"),
        ("social security no. 123 45 6789", "id"),
    ],
)
def test_added_kinds(text, kind):
    assert kind in [s[0] for s in find_spans(text)]


def test_added_kinds_need_valid_boundaries():
    assert find_spans("IBAN: DE88 3704 0044 0532 0130 00 please") == []
    assert find_spans("see https://example.org/x") == []
    for text in ("XDE89370400440532013000", "DE89370400440532013000X", "routing 021000022", "ssn 000-12-3456", "ssn 123-45-67890", "123-45-6789", "ssn"):
        assert not [s for s in find_spans(text) if s[0] in ("account", "id")], text


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "é a.b@c.de 1.2.3.4"), (None, "x " * 200_000 + "+1 (988) 555-2485")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as spans", "1 as n_email")
    got = detect_pii(df).collect()
    assert len(got) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty for r in got if r.doc_id in (1, 2))
    assert [r.spans for r in got if r.doc_id == 3] == ["email:2:10,ip:11:18"] and [r.n_spans for r in got if r.doc_id == 3] == [2]
    assert [r.n_phone for r in got if r.doc_id is None] == [1]
    assert detect_pii(df.limit(0)).count() == 0


def test_table_equals_patterns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in detect_pii(docs).collect():
        want = ",".join(f"{k}:{b}:{e}" for k, b, e in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
