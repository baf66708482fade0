from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from quaestor.llm import personal_data
from tests.oracle import folder

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def base_of(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    ]


def check(row, text):
    base = base_of(text or "")
    listed = ",".join(f"{k}:{a}:{b}" for k, own in zip(personal_data.KINDS, base) for a, b in own)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(map(len, base))
    assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    every = row.spans.split(",") if row.spans else []
    assert set(listed.split(",")) - {""} <= set(every)
    place = [(personal_data.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in every)]
    assert place == sorted(set(place)) and all(0 <= a < b <= len(text or "") for _, a, b in place)


def test_query_against_expressions(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder()}/documents.parquet").collect()}
    rows = entry.queries()["op11_offset_transducers"](spark, folder()).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])
    assert sum(r.n_email for r in rows) and sum(r.n_phone for r in rows) and sum(r.n_card for r in rows)


def test_hard_rows(hard, empty):
    rows = personal_data.find_personal_data(hard).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in hard.collect())
    texts = {r.doc_id: r.text for r in hard.collect()}
    for r in rows:
        if r.doc_id is not None:
            check(r, texts[r.doc_id])
    assert personal_data.find_personal_data(empty).collect() == []


def found(text):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    flagged = bool((personal_data._glyphs()[points] != 0).any())
    base, every = personal_data.spans(text, points, flagged)
    assert base == base_of(text)
    return {(k, text[a:b]) for k, own in zip(personal_data.KINDS, every) for a, b in own}


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane.doe (at) mail (dot) example (dot) org now", "email", "jane.doe (at) mail (dot) example (dot) org"),
        ("x jane[at]example[dot]org.", "email", "jane[at]example[dot]org"),
        ("Jane DOT Doe AT example DOT org", "email", "Jane DOT Doe AT example DOT org"),
        ("mail jane at mail.example dot org, please", "email", "jane at mail.example dot org"),
        ("to jane @ example . org", "email", "jane @ example . org"),
        ("jane@example dot org", "email", "jane@example dot org"),
        ("a jane_at_example_dot_org", "email", "jane_at_example_dot_org"),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ!", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ"),
        ("see jаne@exаmple.org", "email", "jаne@exаmple.org"),
        ("ja​ne@exam­ple.org", "email", "ja​ne@exam­ple.org"),
        ("correo jane arroba example punto org", "email", "jane arroba example punto org"),
        ("call plus one five five five two three four five six seven eight", "phone",
         "plus one five five five two three four five six seven eight"),
        ("+1 (five five five) 555-0134", "phone", "+1 (five five five) 555-0134"),
        ("tel +４９ ３０ １２３４５６７", "phone", "+４９ ３０ １２３４５６７"),
        ("+1 5O5 555 0134", "phone", "+1 5O5 555 0134"),
        ("card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("to four triple one triple one triple one triple one triple one", "card",
         "four triple one triple one triple one triple one triple one"),
        ("host one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("192(dot)168(dot)0(dot)1", "ip", "192(dot)168(dot)0(dot)1"),
        ("١٩٢.١٦٨.٠.١", "ip", "١٩٢.١٦٨.٠.١"),
    ],
)
def test_disguises(text, kind, source):
    got = {s for k, s in found(text) if k == kind}
    assert got == {source}


@pytest.mark.parametrize(
    "text",
    [
        "Meet me at home, dot the letters and go.",
        "stay-at-home.This is one of two or three things at point blank.",
        "lunch at noon (at the cafe) for one or two",
        "one two three four five",
        "5 @ 10.50 each",
        "Zwei, drei, vier. Un deux trois. uno dos tres",
        "été à la plage – naïve “quotes” … ½",
    ],
)
def test_prose_is_left_alone(text):
    assert found(text) == set()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a1.@+- (9é_dotA4​,"), max_size=60))
def test_plain_spans_are_those_of_the_expressions(text):
    assert personal_data.detect(text) == base_of(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("one five plus at dot (at) @ . a b1 12 ( ) é ​ ｘ １ - double , _dot_".split(" ")), max_size=25))
def test_tapes_keep_their_places(parts):
    """Every character of the last tape stands for a part of the source, in order."""
    text = " ".join(parts)
    tape = personal_data.clear(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert len(tape.text) == len(tape.starts) == len(tape.ends)
    assert (tape.starts < tape.ends).all() and (np.diff(tape.starts) >= 0).all() and (np.diff(tape.ends) >= 0).all()
    assert not len(text) or tape.ends.max(initial=0) <= len(text)


@pytest.mark.parametrize(
    "part", ["a", "1", "a.", "1.", "1 ", " ", "@", "+", "+1(", "(", " at ", " dot ", "one ", "a@b", "(at)", "1O", ".", "_", "@a ", "double ", "dot dot@"]
)
def test_long_texts_take_linear_time(part):
    text = (part * 500_000)[:500_000]
    began = time.process_time()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    personal_data.spans(text, points, True)
    assert time.process_time() - began < 12
