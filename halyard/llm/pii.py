"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, URL schemes,
digit pairs, dotted digits, plus-digits and identifier cues. A local parser for
each anchor kind expands to the left and right and validates the boundary. No
pattern engine walks the text, and a parser reads no part twice that another
anchor of its kind has read, so the time is linear in the text's length.

Base kinds (leftmost, non-overlapping for each kind, failing ones dropped with
no retry): ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits,
Luhn), ``phone`` (plus sign, 10 to 15 digits). Added kinds:

* ``account``: an IBAN (country letters, two digits, 15 to 34 letters and digits
  in all, in one piece or in groups of four; its check digits hold), with or
  without a cue; or after a cue word a US bank routing number (nine digits, its
  check digit holds);
* ``login``: user information in front of the host of a URL;
* ``id``: after a cue word a US social security number (three, two and four
  digits, no group of zeros, not 000, 666 or 9xx in front).

Between a cue and the number may stand any run of blanks and of ``:=#.`` marks,
and the words no, nr, num or number.

Defined results: null and empty texts have no spans; offsets are code points,
ends exclusive; rows repeat as given; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "account", "login", "id")
#: Cue words of account and identity numbers, words that may follow
#: them, URL schemes, and the countries of the IBAN registry.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "routing", "aba")
ID_CUES = ("ssn", "social security", "social-security")
FILLERS = ("number", "num", "no", "nr")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "git://", "ws://", "wss://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://", "smtp://", "ldap://")
IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BI BR BY CH CR CY CZ DE DJ DK DO EE EG ES FI FK FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MN MR MT MU NI NL NO OM PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM SO ST SV TL TN TR UA VA VG XK YE"
).split()

DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = _ALNUM | frozenset("._%+-")
LABEL = _ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
UPPER_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
GAPS = frozenset(" \t\r\n:=#.")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", (1, "at"))
    for x in "0123456789":
        a.add_word("+" + x, (2, "plus"))
        for y in "0123456789":
            a.add_word(f"{x}.{y}", (3, "dotted"))
            for gap in ("", " ", "-"):
                a.add_word(f"{x}{gap}{y}", (2 + len(gap), "digits"))
    for cues, kind in ((ACCOUNT_CUES, "account"), (ID_CUES, "id")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(form, (len(form), kind))
    for country in IBAN_COUNTRIES:
        for x in "0123456789":
            a.add_word(country + x, (3, "iban"))
    for scheme in SCHEMES:
        a.add_word(scheme, (len(scheme), "scheme"))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part back to ``floor`` at most, then two labels or more."""
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    if begin == at:
        return None
    n, end, dots = len(text), at + 1, 0
    while True:
        label = end
        while label < n and text[label] in LABEL:
            label += 1
        if label == end:
            break
        end = label
        if end < n and text[end] == "." and end + 1 < n and text[end + 1] in LABEL:
            dots += 1
            end += 1
        else:
            break
    return (begin, end) if dots > 0 else None


def digit_run(text: str, begin: int) -> int:
    """End of the chain of digits with lone spaces or hyphens between."""
    n, end = len(text), begin + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def dotted_run(text: str, begin: int) -> list[tuple[int, int]]:
    """Runs of digits joined by single dots, from ``begin``."""
    n, runs, at = len(text), [], begin
    while True:
        end = at
        while end < n and text[end] in DIGITS:
            end += 1
        runs.append((at, end))
        if end + 1 < n and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return runs


def parse_iban(text: str, begin: int) -> tuple[int, int] | None:
    """An IBAN from its country letters on: the longest one whose check holds
    and that ends where its word does."""
    n = len(text)
    if begin > 0 and text[begin - 1] in _ALNUM or not text[begin + 2 : begin + 4].isdecimal() or not text[begin + 2 : begin + 4].isascii():
        return None
    code, ends, end = [], [], begin
    while end < n and len(code) < 35:
        if text[end] in UPPER_ALNUM:
            code.append(text[end])
            ends.append(end + 1)
        elif not (text[end] == " " and code and len(code) % 4 == 0 and end + 1 < n and text[end + 1] in UPPER_ALNUM):
            break
        end += 1
    for size in range(min(34, len(code)), 14, -1):
        stop = ends[size - 1]
        if (stop >= n or text[stop] not in _ALNUM) and iban_holds("".join(code[:size])):
            return begin, stop
    return None


def after_cue(text: str, at: int) -> int:
    """Where a number may begin after a cue's end: behind marks and filler words."""
    n, begin, moved = len(text), at, True
    while moved:
        moved = False
        while begin < n and text[begin] in GAPS:
            begin, moved = begin + 1, True
        if moved or begin == at:
            ahead = text[begin : begin + 7].lower()
            for word in FILLERS:
                if begin > at and ahead.startswith(word) and (len(ahead) == len(word) or ahead[len(word)] in GAPS):
                    begin += len(word)
                    break
            else:
                moved = False
    return begin


def digits_from(text: str, begin: int) -> int:
    end = begin
    while end < len(text) and text[end] in DIGITS:
        end += 1
    return end


def parse_routing(text: str, begin: int) -> tuple[int, int] | None:
    """Nine digits whose weighted sum (3, 7, 1) is a multiple of ten."""
    end = digits_from(text, begin)
    if end - begin != 9 or (end < len(text) and text[end] in _ALNUM):
        return None
    total = sum(int(c) * w for c, w in zip(text[begin:end], (3, 7, 1) * 3))
    return (begin, end) if total and total % 10 == 0 else None


def parse_social(text: str, begin: int) -> tuple[int, int] | None:
    """Three, two and four digits with hyphens, blanks or nothing between."""
    parts, at = [], begin
    for k, width in enumerate((3, 2, 4)):
        part = text[at : at + width]
        if len(part) < width or any(c not in DIGITS for c in part):
            return None
        parts.append(part)
        at += width
        if k < 2 and at < len(text) and text[at] in " -":
            at += 1
    if at < len(text) and text[at] in _ALNUM:
        return None
    good = parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000"
    return (begin, at) if good else None


def parse_login(text: str, at: int) -> tuple[int, int] | None:
    """``user:secret@`` right after a scheme, within its authority."""
    n, end = len(text), at
    while end < n and text[end] not in "/?#@ \t\r\n\"'<>":
        end += 1
    return (at, end) if end < n and text[end] == "@" and ":" in text[at + 1 : end] else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    email_floor = digits_to = dotted_to = 0
    for last, (width, anchor) in automaton().iter(text):
        begin = last + 1 - width
        if anchor == "digits":
            if begin >= digits_to:
                digits_to = digit_run(text, begin)
                digits = "".join(c for c in text[begin:digits_to] if c in DIGITS)
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", begin, digits_to))
        elif anchor == "dotted":
            if begin >= dotted_to:
                first = begin
                while first > dotted_to and text[first - 1] in DIGITS:
                    first -= 1
                runs = dotted_run(text, first)
                dotted_to = runs[-1][1]
                for k in range(0, len(runs) - 3, 4):
                    four = runs[k : k + 4]
                    if all(small_part(text[b:e]) for b, e in four):
                        out.append(("ip", four[0][0], four[3][1]))
        elif anchor == "at":
            if found := parse_email(text, begin, email_floor):
                out.append(("email", *found))
                email_floor = found[1]
        elif anchor == "plus":
            end = begin + 2
            while end < len(text) and text[end] in PHONE:
                end += 1
            while end > begin + 3 and text[end - 1] not in DIGITS:
                end -= 1
            if end > begin + 3 and text[end - 1] in DIGITS:
                n = sum(c in DIGITS for c in text[begin:end])
                if 10 <= n <= 15:
                    out.append(("phone", begin, end))
        elif anchor == "iban":
            if found := parse_iban(text, begin):
                out.append(("account", *found))
        elif anchor == "scheme":
            if found := parse_login(text, last + 1):
                out.append(("login", *found))
        elif (number := after_cue(text, last + 1)) > last + 1:
            if found := (parse_social if anchor == "id" else parse_routing)(text, number):
                out.append((anchor, *found))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def small_part(digits: str) -> bool:
    bare = digits.lstrip("0")
    return len(bare) < 3 or (len(bare) == 3 and bare <= "255")


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
_BASE = KINDS[:4]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = find_spans(text)
            base = ",".join(f"{k}:{b}:{e}" for k, b, e in spans if k in _BASE)
            values = [doc_id, *(sum(s[0] == k for s in spans) for k in _BASE)]
            values += [hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{b}:{e}" for k, b, e in spans), len(spans)]
            for column, value in zip(rows, values):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)


def detect_pii(documents: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row; one pass, no shuffle."""
    return documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_batches, SCHEMA)
