from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quaestor.functions import stemming as rules
from quaestor.functions.stemming import with_stems
from quaestor.operators import text_store
from quaestor.operators.search import STOP_WORDS


PAIRS = """
caresses caress|flies fli|dies die|ties tie|cries cri|gas gas|gaps gap|kiwis kiwi|this this|news news|skies sky
agreed agre|feed feed|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl
hopping hop|hoping hope|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|luxuriated luxuri
happy happi|sky sky|by by|say say|cry cri|enjoyment enjoy|sayings say|relational relat|conditional condit
rational ration|digitizer digit|conformably conform|radically radic|differently differ|analogously analog
vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|hopefulness hope
callousness callous|formality formal|sensitivity sensit|sensibility sensibl|triplicate triplic|formative format
formalize formal|electricity electr|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow
inference infer|airliner airlin|adjustable adjust|defensible defens|irritant irrit|replacement replac
adjustment adjust|dependent depend|adoption adopt|communism communism|activate activ|homologous homolog
effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll
generously generous|general general|generic generic|communication communic|arsenal arsenal|proceeding proceed
inning inning|outings outing|herrings herring|dying die|only onli|early earli|knightly knight|knavish knavish
youth youth|yield yield|player player|boyish boyish|consistency consist|consignment consign|consolingly consol
"""


def test_known_stems(spark):
    pairs = [tuple(p.split()) for line in PAIRS.strip().splitlines() for p in line.split("|")]
    rows = with_stems(spark.createDataFrame(pairs, "token string, want string")).collect()
    assert {r.token: r.stem for r in rows} == {r.token: r.want for r in rows}


VOWELS = "aeiouy"


def porter2(word):
    """The rules letter by letter."""
    if word in rules._EXCEPTIONS:
        return rules._EXCEPTIONS[word]
    if len(word) <= 2:
        return word
    w = list(word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in VOWELS):
            w[i] = "Y"
    w = "".join(w)

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    p1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    p2 = region(p1)
    has_vowel = lambda s: any(c in VOWELS for c in s)

    def short(s):
        if len(s) == 2:
            return s[0] in VOWELS and s[1] not in VOWELS
        return len(s) > 2 and s[-1] not in VOWELS + "wxY" and s[-2] in VOWELS and s[-3] not in VOWELS

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in rules._WHOLE_AFTER_PLURAL:
        return w
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if suffix in ("eedly", "eed"):
                w = rest + "ee" if len(rest) >= p1 else w
            elif has_vowel(rest):
                w = rest
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(rules._DOUBLES):
                    w = w[:-1]
                elif len(w) <= p1 and short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for table, region_start in ((rules._STEP_2, p1), (rules._STEP_3, p1), (dict.fromkeys(rules._STEP_4, ""), p2)):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                rest = w[: -len(suffix)]
                fits = len(rest) >= (p2 if suffix == "ative" else region_start)
                last = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}.get(suffix)
                if fits and (last is None or rest[-1:] and rest[-1] in last):
                    w = rest + table[suffix]
                break
    if w.endswith("e"):
        if len(w) - 1 >= p2 or (len(w) - 1 >= p1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


def test_stems_of_made_words(spark):
    """All suffixes on all kinds of beginnings, against the rules letter by letter."""
    rng = random.Random(4)
    ends = [*rules._STEP_2, *rules._STEP_3, *rules._STEP_4, "s", "sses", "ies", "ied", "ed", "ing", "edly", "ingly", "eed", "eedly", "y", "e", "l", ""]
    begins = ["", "y", "é", "yy", "ay", "gener", "commun", "1", *["".join(rng.choices("abceilnorstyé", k=rng.randint(1, 6))) for _ in range(400)]]
    words = {b + rng.choice(["", *"abelnty"]) + e + f for b in begins for e in rng.sample(ends, 12) for f in ("", rng.choice(ends))}
    df = spark.createDataFrame([(w,) for w in words if w], "token string")
    got = {r.token: r.stem for r in with_stems(df).collect()}
    wrong = {w: (got[w], porter2(w)) for w in got if got[w] != porter2(w)}
    assert not wrong and len(got) > 4000
    assert with_stems(spark.createDataFrame([(None,)], "token string")).first().stem is None


def plain(texts, questions, k):
    stems = lambda t: [porter2(w) for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in STOP_WORDS]
    held = {i: Counter(stems(t)) for i, t in texts}
    df = Counter(s for c in held.values() for s in c)
    out = defaultdict(list)
    for q, text in questions:
        for i, c in held.items():
            both = set(stems(text)) & set(c)
            if both:
                out[q].append((-round(sum(c[s] * math.log(len(texts) / df[s]) for s in both), 6), i, len(both)))
    return {q: [(i, m, pytest.approx(-s, abs=2e-6)) for s, i, m in sorted(rows)[:k]] for q, rows in out.items()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    words = [w for line in PAIRS.strip().splitlines() for p in line.split("|") for w in [p.split()[0]]]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(3000)]
    texts += [(5000, None), (5001, ""), (5002, "the of and"), (5003, "Hoping hopes hoped HOPE")]
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(texts, "chunk_id long, text string")
    text_store.write_index(df.repartition(7), path, buckets=16)
    return path, texts


def test_search_equals_all_scores(spark, corpus):
    path, texts = corpus
    questions = [(1, "hopes of adoption"), (2, "caress caresses"), (3, "unheard words"), (4, None), (5, "flies dying " * 4), (None, "goodness")]
    df = spark.createDataFrame(questions, "query_id long, question string")
    for k in (1, 10, 5000):
        got = defaultdict(list)
        for r in sorted(text_store.search_index(spark, path, df, k, buckets=16).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append((r.chunk_id, r.matched, r.score))
        assert dict(got) == plain(texts, questions, k)


def test_blocks_are_whole_and_bounded(spark, corpus):
    path, texts = corpus
    rows = spark.read.parquet(f"{path}/blocks").collect()
    assert all(r.n == len(r.ids) == len(r.tfs) <= text_store.BLOCK and r.max_tf == max(r.tfs) and r.first_id == r.ids[0] for r in rows)
    held = Counter((r.stem, i) for r in rows for i in r.ids)
    assert max(held.values()) == 1
    short = Counter(r.stem for r in rows if r.n < text_store.BLOCK)
    assert max(short.values()) <= 8 + 1  # one at the end of each range partition


def test_only_asked_folders_are_read(spark, corpus):
    path, _ = corpus
    held = spark.read.parquet(f"{path}/blocks").filter(F.col("bucket").isin([3]))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)


def test_rare_stems_close_most_blocks(spark, tmp_path):
    """A question with a rare stem opens few blocks of a common one."""
    rows = [(i, "common " + ("zebra " * 40 if i % 997 == 0 else "")) for i in range(20_000)]
    text_store.write_index(spark.createDataFrame(rows, "chunk_id long, text string"), str(tmp_path))
    df = spark.createDataFrame([(1, "zebra common")], "query_id long, question string")
    got = [r.chunk_id for r in text_store.search_index(spark, str(tmp_path), df, 5).collect()]
    assert sorted(got) == [i for i in range(20_000) if i % 997 == 0][:5]


def test_each_token_is_stemmed_once(spark, tmp_path, monkeypatch):
    """Stemming is the dear step: its rows are the different tokens, not each text's."""
    asked = []
    monkeypatch.setattr(text_store, "with_stems", lambda df: (asked.append(df.count()), with_stems(df))[1])
    rows = [(i, "hopes hoped hoping the adoption") for i in range(400)]
    text_store.write_index(spark.createDataFrame(rows, "chunk_id long, text string").repartition(4), str(tmp_path))
    assert asked == [4]


def test_null_and_repeated_ids_over_small_batches(spark, tmp_path):
    """Texts of one id count as one, a null id is an id, wherever batches end."""
    rng = random.Random(11)
    words = ["hope", "hopes", "hoping", "zebra", "zebras", "adoption", "caress"]
    texts = [(rng.choice([None, *range(160)]), " ".join(rng.choices(words, k=rng.randint(1, 9)))) for _ in range(700)]
    path, size = str(tmp_path), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        text_store.write_index(spark.createDataFrame(texts, "chunk_id long, text string").repartition(5), path, buckets=4)
        questions = spark.createDataFrame([(q, " ".join(words[q : q + 3])) for q in range(5)], "query_id long, question string")
        got = {(r.query_id, r.chunk_id): r for r in text_store.search_index(spark, path, questions, 500, buckets=4, block=2).collect()}
    finally:
        spark.conf.set(size, before)
    held = defaultdict(Counter)
    for i, t in texts:
        held[i].update(porter2(w) for w in t.split())
    df = Counter(s for c in held.values() for s in c)
    want = {}
    for q in range(5):
        for i, c in held.items():
            both = {porter2(w) for w in words[q : q + 3]} & set(c)
            if both:
                want[q, i] = (len(both), pytest.approx(sum(c[s] * math.log(len(texts) / df[s]) for s in both), abs=2e-6))
    assert any(i is None for _, i in want)
    assert {key: (r.matched, r.score) for key, r in got.items()} == want
    stored = spark.read.parquet(f"{path}/blocks").collect()
    assert max(Counter((r.stem, i) for r in stored for i in r.ids).values()) == 1
    best = {(r.query_id, r.chunk_id): r["rank"] for r in text_store.search_index(spark, path, questions, 3, buckets=4).collect()}
    assert best == {key: r["rank"] for key, r in got.items() if r["rank"] <= 3}
