from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from quaestor.llm import licenses, secrets, url_rules
from quaestor.llm.textops import blocks
from tests.oracle import difference, duck, duck_rows, folder, spark_rows

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_of(text):
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += at
        labels |= {label} if at else set()
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(labels))


def check_licenses(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
        base, every = (set(x.split(",")) - {""} for x in (r.base_labels, r.labels))
        assert base <= every and r.labels == ",".join(sorted(every)) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(every)


def test_license_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder()}/documents.parquet").collect()}
    rows = entry.queries()["op5_signature_licenses"](spark, folder()).collect()
    assert len(rows) == len(texts)
    check_licenses(rows, texts)
    assert {x for r in rows for x in r.labels.split(",")} >= {"mit", "apache", "gpl", "cc-by-nc"}


def test_license_hard_rows(hard, empty):
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    rows = licenses.scan_licenses(hard).collect()
    assert len(rows) == hard.count()
    check_licenses([r for r in rows if r.doc_id is not None], texts)
    assert licenses.scan_licenses(empty).collect() == []


def detected(text):
    (block,) = blocks(pa.array([text]))
    scan = licenses.Scanner()
    data = licenses.LOWER[block.data]
    starts, ends, document = block.runs(licenses.WORD[data])
    held = scan.keywords(licenses.hash_runs(data, starts, ends), document, 1)[0]
    return [d[:3] for d in scan.detect(data.tobytes(), held)], scan.detect(data.tobytes(), -1)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the Apache License, Version 2.0.", [(0, 8, "apache")]),
        ("SPDX-License-Identifier: GPL-3.0-or-later", [(0, 8, "gpl")]),
        ("under the terms; GNU Lesser General Public License v3", [(3, 9, "lgpl")]),
        ("Licensed under CC BY-NC 4.0.", [(0, 7, "cc-by-nc")]),
        ("Released under the MIT License", [(0, 5, "mit")]),
        ("the permit licence is not one", []),
        ("the three-clause BSD licence or the zlib license", [(1, 5, "bsd-3-clause"), (7, 9, "zlib")]),
    ],
)
def test_signatures(text, want):
    got, every = detected(text)
    assert got == want and [d[:3] for d in every] == want


def test_hundreds_of_rules_and_gates_lose_nothing():
    """A text that a rule's expression fits always holds the rule's keywords."""
    rules = licenses.signature_rules()
    assert len(rules) > 300
    scan = licenses.Scanner()
    rng = random.Random(2)
    stated = 0
    for form, _, _ in licenses.FORMS:
        for _, name, _, identifier in licenses.FAMILIES:
            for _ in range(6):
                text = sample(form.format(n=f"(?:{name})", i=f"(?:{identifier})"), rng)
                got, every = detected(text)
                assert got == [d[:3] for d in every], text
                stated += bool(got)
    assert stated > 0.95 * 6 * len(rules)
    assert len(scan.rules) == len(rules)


def sample(pattern, rng):
    """Some string that a pattern fits."""

    def walk(items):
        return "".join(one(op, v) for op, v in items)

    def one(op, v):
        name = str(op)
        if name == "LITERAL":
            return chr(v)
        if name == "IN":
            kind, value = rng.choice(v)
            if str(kind) == "CATEGORY":
                return rng.choice("0123456789")
            return chr(rng.randint(*value)) if str(kind) == "RANGE" else chr(value)
        if name == "SUBPATTERN":
            return walk(v[-1])
        if name == "BRANCH":
            return walk(rng.choice(v[1]))
        low, high, inner = v
        return "".join(walk(inner) for _ in range(rng.randint(low, min(int(high), low + 2))))

    return walk(re._parser.parse(pattern))


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[0], x[2]))


def all_spans(text):
    """Every rule over the whole text, without an index."""
    out = []
    for r, rule in enumerate(secrets.RULES):
        out += [(*m.span(), r) for m in re.finditer(rule.pattern, text or "") if rule.valid(m)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def check_secrets(rows, texts):
    kinds = [r.kind for r in secrets.RULES]
    for r in rows:
        base = base_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[2] == k for x in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base, kinds).encode()).hexdigest()
        assert r.spans == secrets.joined(all_spans(texts[r.doc_id]), kinds)
        assert {x for x in secrets.joined(base, kinds).split(",")} <= set(r.spans.split(","))


def test_secret_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder()}/documents.parquet").collect()}
    rows = entry.queries()["op10_trigram_secrets"](spark, folder()).collect()
    assert len(rows) == len(texts) and any(r.n_hex for r in rows)
    check_secrets(rows, texts)


SECRETS = [
    "ghp_" + "a1B2" * 9, "xoxb-123456789012-abc", "AIza" + "x" * 35, "sk_live_" + "4eC39H" * 3, "eyJabcdefgh.eyJabcdefgh.abcdefgh_-",
    "-----BEGIN RSA PRIVATE KEY-----", "https://user:pass@host", "Bearer " + "t" * 24, "API_KEY = 'abcdefgh'", "apikey:12345678",
    "AKIA" + "Z" * 12, "ſecret=12345678", "to\u212aen=12345678", "PASSWORD=short", "f" * 31, "f" * 32, "npm_" + "a" * 36, "é", " ", "\n",
]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SECRETS), max_size=4).map("".join), max_size=8), st.integers(1, 200))
def test_index_finds_what_full_scans_find(texts, size):
    scan = secrets.scanner()
    got = [s for b in blocks(pa.array(texts, pa.string()), size) for s in scan.scan(b)]
    assert got == [all_spans(t) for t in texts]


def test_queries_name_mandatory_trigrams():
    assert secrets.trigram_query("abcd") == ("and", ("abc", "bcd"))
    assert secrets.trigram_query("AB[cd]e") == ("or", (("and", ("abc", "bce")), ("and", ("abd", "bde"))))
    assert secrets.trigram_query("ab|xyz") is secrets.ALL
    assert secrets.trigram_query("(?:abc)*x") is secrets.ALL
    assert secrets.trigram_query("x(?:abc)+y") == "abc"
    assert secrets.trigram_query("abc[0-9]+xyz") == ("and", ("abc", "xyz"))
    assert secrets.trigram_query("[0-9a-f]+") is secrets.ALL


def test_secret_hard_rows(hard, empty):
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    rows = secrets.find_secrets(hard).collect()
    assert len(rows) == hard.count()
    check_secrets([r for r in rows if r.doc_id is not None], texts)
    assert secrets.find_secrets(empty).collect() == []
    red = {r.doc_id: r.text for r in secrets.redact(hard).collect() if r.doc_id is not None}
    assert secrets.redact(hard).columns == hard.columns
    assert red[15] == "[assign] [access] [hex]" and red[4] is None
    assert all(red[d] == t for d, t in texts.items() if d != 15)


# ---------------------------------------------------------------- urls


def site_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = []
    for verdict, rule in url_rules.SITE_RULES:
        site, _, prefix = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_query_matches_sql(spark):
    key = "op4_rarest_token_rules"
    got = spark_rows(entry.queries()[key](spark, folder()))
    assert difference(got, duck_rows(duck(folder()), entry.oracle_sql()[key])) is None


URLS = [
    "http://example.net/en/1", "http://EXAMPLE.net/EN/1", "https://a.b.example.net", "https://a.net?x=/", "net/", "x://net/y", "http://org/fr/",
    "http://m.example.com/de/?utm_source=a", "http://spam-farm.example.org/fr/x", "http://spam-farm.example.org/es/x", "://", "",
    "http://shop.org/cart", "http://shop.org/cartoon", "http://docs.shop.org/cart/1", "http://a.org/login/help", "http://a.org/login",
    "http://a.org/x?q=1&utm_source=z", "http://a.org/x.exe", "http://évil.net/a", "http://a.org:80/fr/", "no scheme", "http://a.org/a\n/cart",
    "http://wiki.a.org/cart", "http://ads.x.org/", "http://roads.x.org/", "http://x.org/?a=1://net/",
]


def test_urls_one_by_one(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate([*URLS, None, URLS[0]])] + [(None, URLS[0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = url_rules.default_rules()
    got = url_rules.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[0] if r.page_id is None or r.page_id > len(URLS) else [*URLS, None][r.page_id]
        host, path, rule, verdict = site_verdict(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict is None:
            # Every pattern over the whole, without an index.
            whole = (url.split("://", 1)[1] if url and "://" in url else "").lower()
            fits = [x for x in rules if not x.site and re.search(x.regex, whole, re.DOTALL)]
            allows = [x for x in fits if x.verdict == "allow"]
            verdict = (allows or fits)[0].verdict if fits else "allow"
        assert r.verdict == verdict, url
    judged = {r.page_id: r.verdict for r in got}
    by_url = {u: judged[i] for i, u in enumerate(URLS)}
    assert by_url["http://shop.org/cart"] == "block" and by_url["http://shop.org/cartoon"] == "allow"
    assert by_url["http://docs.shop.org/cart/1"] == "allow" and by_url["http://roads.x.org/"] == "allow"
    assert url_rules.judge_urls(pages.limit(0)).collect() == []


def test_rules_are_filed_under_their_rarest_token():
    rules = url_rules.default_rules()
    counts = {"example": 90, "net": 50, "en": 70, "com": 60, "de": 10, "spam": 1, "farm": 1, "fr": 3}
    index, rest = url_rules.file_rules(rules, counts)
    filed = {rules[i].text: t for t, own in index.items() for i in own}
    assert filed["example.net/en/"] == "net" and filed["example.com/de/"] == "de" and filed["org/fr/"] == "org"
    # Every token of a rule is whole in every URL it fits.
    assert url_rules.compile_rule("block", "||spam-farm.*^").tokens == ("spam", "farm")
    assert url_rules.compile_rule("block", "abc/def").tokens == ()
    assert {rules[i].text for i in rest} == {r.text for r in rules if not r.tokens}


KEY_BODY = "\n".join(["MIIEpAIBAAKCAQEA" + "Ab9+/x" * 8] * 5)


@pytest.mark.parametrize(
    ("text", "left"),
    [
        (f"a -----BEGIN RSA PRIVATE KEY-----\n{KEY_BODY}\nqL3=\n-----END RSA PRIVATE KEY----- b", "a [private_key] b"),
        (f"a -----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{KEY_BODY}\n-----END PRIVATE KEY-----", "a [private_key]"),
        (f"a -----BEGIN PRIVATE KEY-----\n{KEY_BODY}\nqL3=\nThen prose goes on.", "a [private_key]\nThen prose goes on."),
        ("a -----BEGIN PRIVATE KEY----- and prose", "a [private_key] and prose"),
        (r"k = '-----BEGIN PRIVATE KEY-----\nMIIEpAIBAAKCAQEAxx\n-----END PRIVATE KEY-----\n'", r"k = '[private_key]\n'"),
    ],
)
def test_private_keys_go_with_their_bodies(spark, text, left):
    df = spark.createDataFrame([(text,)], "text string")
    assert secrets.redact(df).first().text == left


@pytest.mark.parametrize("part", ["eyJaaaaaaaa-", "eyJaaaaaaaa.", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nMIIEpAIBAAKCAQEA\n"])
def test_hostile_texts_take_linear_time(part):
    (block,) = blocks(pa.array([part * (1_000_000 // len(part))]), 1 << 21)
    scan = secrets.scanner()
    began = time.process_time()
    scan.scan(block)
    assert time.process_time() - began < 8


def test_a_block_gives_its_spans_each_time():
    """Blocks cut from arrays that are dropped at once."""
    text = "x password: hunter2hunter2 y"
    for i in range(300):
        (block,) = blocks(pa.array(["pad" * (i % 7), text]).slice(1))
        assert secrets.scanner().scan(block) == [[(2, 26, 0)]]
