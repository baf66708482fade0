from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quaestor.llm import kn_classifier, kneser_ney, quality_rules, word_model
from tests.llm.conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ending(word):
    """The class of a word's last two bytes; a word of one byte has it twice."""
    data = word.encode()
    return 1 + (31 * data[-1] + 7 * data[max(len(data) - 2, 0)]) % 15


def pairs(text):
    words = WORDS.findall(text or "")
    return Counter(zip([0, *map(ending, words)], words))


def plain(training):
    """(pair, times or None) to surprise, by dictionaries of words."""
    counts = Counter()
    for text in training:
        counts.update(pairs(text))
    total, taken, kinds, uses = (defaultdict(float) for _ in range(4))
    for (_, b), n in counts.items():
        kinds[b] += 1
        uses[b] += n
    d1, d0 = (
        kneser_ney._discounts([list(t.values()).count(n) for n in (1, 2, 3, 4)]) for t in (counts, kinds)
    )
    off = lambda n, d: d[int(min(n, 3)) - 1]
    for (a, _), n in counts.items():
        total[a] += n
        taken[a] += off(n, d1)
    every = sum(kinds.values())
    unseen = sum(off(n, d0) for n in kinds.values()) / every / (len(kinds) + 1) if counts else 1.0

    def surprise(pair, times=None):
        (a, b), n = pair, counts[pair]
        left_out = times is not None and n <= times
        weight = taken[a] / total[a] if a in total and not (left_out and total[a] <= n) else 1.0
        known = b in kinds and not (left_out and uses[b] <= n)
        p_word = (kinds[b] - off(kinds[b], d0)) / every + unseen if known else unseen
        own = (n - off(n, d1)) / total[a] if n and not left_out else 0.0
        return -math.log(own + weight * p_word)

    return surprise


def frame(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


@pytest.mark.parametrize("head", [word_model.HEAD, 50, 0])
def test_equals_dictionaries_and_keeps_every_word(spark, head):
    """Case, digits and other letters tell words apart, and a copy changes no mean; so at every size of the head."""
    training = [prose(i, 60) for i in range(30)] + ["Öl 1", "öl 2", "日本 語"]
    texts = [*training, *[prose(i, 40) for i in range(50, 55)], "Ab ab 1 2", None, " ", training[0]]
    keys = {r.key: r.text for r in frame(spark, texts).select("text", word_model.key().alias("key")).collect()}
    rows = word_model.surprises(frame(spark, texts), frame(spark, training), head).collect()
    got = {keys[r.key]: r for r in rows}
    assert len(got) == len(rows)
    surprise = plain(training)
    assert set(got) == {t for t in texts if t and t.strip()}
    for text, r in got.items():
        own = pairs(text)
        assert r.words == sum(own.values())
        each = [(n, surprise(p), surprise(p, n)) for p, n in own.items()]
        mean, alone = (sum(e[0] * e[j] for e in each) / r.words for j in (1, 2))
        spread = [math.sqrt(max(sum(e[0] * e[j] ** 2 for e in each) / r.words - m * m, 0) / r.words) for j, m in ((1, mean), (2, alone))]
        near = lambda x: pytest.approx(x, rel=1e-5, abs=1e-5)
        assert (r.surprise, r.surprise_alone) == (near(mean), near(alone))
        assert (r.error, r.error_alone) == (pytest.approx(spread[0], abs=2e-3), pytest.approx(spread[1], abs=2e-3))


def test_spills_and_shards_change_nothing(spark, monkeypatch):
    texts = [prose(i, 300) for i in range(40)]
    whole = {r.key: r for r in word_model.surprises(frame(spark, texts)).collect()}
    surprise = plain(texts)
    for r, text in ((whole[r.key], r.text) for r in frame(spark, texts).select("text", word_model.key().alias("key")).collect()):
        own = pairs(text)
        assert r.surprise_alone == pytest.approx(sum(n * surprise(p, n) for p, n in own.items()) / r.words, rel=1e-5)
    monkeypatch.setattr(word_model, "SPILL", 700)
    again = {r.key: r for r in word_model.surprises(frame(spark, texts), head=20).collect()}
    assert set(again) == set(whole)
    for k, r in whole.items():
        assert tuple(again[k])[1:] == pytest.approx(tuple(r)[1:], rel=1e-4, abs=2e-3)


def test_without_training_texts(spark):
    none = frame(spark, [])
    assert [r.surprise for r in word_model.surprises(frame(spark, ["a b", None]), none).collect()] == [0.0]
    assert word_model.surprises(none).collect() == []


def test_arrays_come_back():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 64, 1000, np.uint64))
    assert (word_model._unpacked_keys(word_model._packed_keys(keys)) == keys).all()
    assert (word_model._unpacked(word_model._packed(np.arange(5.0)), np.float64) == np.arange(5.0)).all()
    cuts = list(word_model._cuts(keys, 7))
    assert [c[0] for c in cuts] == list(range(7)) and sum(c[1].stop - c[1].start for c in cuts) == len(keys)


def test_tables_grow_with_the_corpus(spark):
    """Keys are as many as the texts have, past any alphabet's bound."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(500))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def size(df):
        table = word_model.merged(word_model.key_counts(df.select("text")))
        return sum(len(word_model._unpacked_keys(r["keys"])) for r in table.collect())

    assert (size(docs.filter("doc_id < 100")), size(docs)) == (50_000, 200_000)


def odd_words():
    """Clean texts over a few words, and one of the same letters in words nobody else uses."""
    clean = [(i, "aa", prose(i, 200)) for i in range(120)]
    letters = prose(999, 200).replace(" ", "")
    return [*clean, (500, "aa", " ".join(letters[i : i + 4] for i in range(1, len(letters), 4)))]


def test_both_queries_see_words(spark):
    docs = spark.createDataFrame(odd_words(), "doc_id long, lang string, text string")
    ids = docs.filter("doc_id < 100").select("doc_id")
    for rows in (quality_rules.judge(docs).collect(), kn_classifier.classify(docs, ids).collect()):
        of = {r.doc_id: r.word_log_perplexity for r in rows}
        assert of[500] > max(v for d, v in of.items() if d != 500)
        assert {r.doc_id for r in rows if not r.kept} == {500}
