from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from quaestor.llm import kn_classifier, kneser_ney, language, quality_rules
from quaestor.llm.symbols import BASE, grams
from quaestor.llm.textops import blocks
from tests.llm.conftest import prose
from tests.oracle import folder


def codes_of(texts, order, size=1 << 20):
    out = []
    for block in blocks(pa.array(texts, pa.string()), size):
        codes, offsets = grams(block, order)
        out += [x.tolist() for x in np.split(codes, offsets[1:-1])]
    return out


def plain_model(counts, order):
    """Interpolated modified Kneser-Ney by dictionaries: gram to probability."""
    levels = [dict(counts)]
    for k in range(order - 1, 0, -1):
        levels.append(Counter(g % BASE**k for g in levels[-1]))
    levels.reverse()
    model, weights = [], []
    for k, level in enumerate(levels):
        times = Counter(level.values())
        d = kneser_ney._discounts([times[n] for n in (1, 2, 3, 4)])
        of = lambda n: d[min(n, 3) - 1]
        total, taken = defaultdict(int), defaultdict(float)
        for g, n in level.items():
            total[g // BASE] += n
            taken[g // BASE] += of(n)
        weights.append({c: taken[c] / total[c] for c in total})
        lower = lambda g: model[-1][g % BASE**k] if k else 1 / BASE
        model.append(
            {g: (n - of(n)) / total[g // BASE] + weights[k][g // BASE] * lower(g) for g, n in level.items()}
        )
    return model, weights


def plain_p(gram, model, weights):
    share = 1.0
    for k in range(len(model) - 1, -1, -1):
        own = gram % BASE ** (k + 1)
        if own in model[k]:
            return share * model[k][own]
        share *= weights[k].get(own // BASE, 1.0)
    return share / BASE


def test_codes_do_not_depend_on_blocks():
    texts = ["Abc, d", None, "", "é", "x" * 50, "1 2\n#"]
    assert codes_of(texts, 3) == codes_of(texts, 3, 4)
    assert [len(c) for c in codes_of(texts, 3)] == [len(t or "") for t in texts]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_equals_dictionaries(spark, order):
    texts = [prose(i, 80) for i in range(12)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = Counter(c for codes in codes_of(texts, order) for c in codes)
    assert {r.gram: r.n for r in kneser_ney.gram_counts(df, order).collect()} == counts
    model = kneser_ney.fit(kneser_ney.gram_counts(df, order), order)
    plain, weights = plain_model(counts, order)
    new = Counter(c for codes in codes_of([prose(99, 60), "Zz#é 123"], order) for c in codes)
    wanted = sorted({*counts, *new})
    expected = [plain_p(g, plain, weights) for g in wanted]
    arrays = kneser_ney.HashArrays(model)
    assert np.allclose(np.exp(-arrays.surprise(np.array(wanted))), expected, rtol=1e-5)
    asked = spark.createDataFrame([(g,) for g in wanted], "gram long")
    joined = {r.gram: r.p for r in kneser_ney.probabilities(asked, model).collect()}
    assert np.allclose([joined[g] for g in wanted], expected, rtol=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    df = spark.createDataFrame([(prose(i, 50),) for i in range(5)], "text string")
    arrays = kneser_ney.HashArrays(kneser_ney.fit(kneser_ney.gram_counts(df, 3), 3))
    for context in (0, 5, 1 * BASE + 2, 47 * BASE + 47):
        assert np.exp(-arrays.surprise(context * BASE + np.arange(BASE))).sum() == pytest.approx(1, abs=1e-4)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def check_counts(rows, texts):
    for r in rows:
        counts = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)


def labelled(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{folder()}/labels.parquet").collect()}


def test_quality_rules_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder()}/documents.parquet").collect()}
    rows = entry.queries()["op3_perplexity_bands"](spark, folder()).collect()
    assert len(rows) == len(docs)
    check_counts(rows, docs)
    # The mean surprise under a model counted by dictionaries.
    every = codes_of(list(docs.values()), quality_rules.ORDER)
    plain, weights = plain_model(Counter(c for codes in every for c in codes), quality_rules.ORDER)
    known = dict(zip(docs, every))
    for r in rows[:200]:
        mean = np.mean([-math.log(plain[-1][c]) for c in known[r.doc_id]])
        assert r.log_perplexity == pytest.approx(mean, abs=1e-4)
    quality = labelled(spark, "quality")
    clean = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if quality.get(r.doc_id) == 0]
    assert np.mean([r.kept for r in clean]) > 0.99 and np.mean([r.kept for r in junk]) < 0.4


def test_quality_rules_hard_rows(hard, empty):
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    rows = quality_rules.judge(hard).collect()
    assert len(rows) == hard.count()
    check_counts([r for r in rows if r.doc_id is not None], texts)
    assert all(r.log_perplexity is None for r in rows if r.doc_id in (4, 5))
    assert quality_rules.judge(empty).collect() == []


def test_classifier_query(spark):
    rows = entry.queries()["op9_kneser_ney_classifier"](spark, folder()).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder()}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    labels = spark.read.parquet(f"{folder()}/labels.parquet").filter("quality = 1 and toxic = 0")
    trusted = {r.doc_id for r in labels.collect()} & set(docs)
    order = kn_classifier.ORDER
    codes = dict(zip(docs, codes_of([d.text for d in docs.values()], order)))
    plain, weights = plain_model(Counter(c for d in trusted for c in codes[d]), order)
    cache = {}
    for r in rows:
        assert r.trusted == (r.doc_id in trusted)
        for c in set(codes[r.doc_id]) - cache.keys():
            cache[c] = -math.log(plain_p(c, plain, weights))
        mean = np.mean([cache[c] for c in codes[r.doc_id]])
        assert r.log_perplexity == pytest.approx(mean, abs=1e-5)
    quality = labelled(spark, "quality")
    kept = lambda q: np.mean([r.kept for r in rows if quality.get(r.doc_id) == q])
    assert kept(1) > 0.99 and kept(0) < 0.3


def test_classifier_hard_rows(spark, hard, empty):
    ids = spark.createDataFrame([(1,), (9,), (18,), (None,), (999,), (1,)], "doc_id long")
    rows = kn_classifier.classify(hard, ids).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert (r.log_perplexity is None) == (r.n_grams == 0)
        assert r.trusted == (r.doc_id in (1, 9, 18)) and (r.n_grams > 0 or not r.kept)
    nobody = spark.createDataFrame([], "doc_id long")
    assert all(r.kept == (r.n_grams > 0) for r in kn_classifier.classify(hard, nobody).collect())
    assert kn_classifier.classify(empty, ids).collect() == []


def test_large_counts_fit_their_byte(spark):
    df = spark.createDataFrame([(1, "a", "x" * 2000), (2, "a", "xy" * 900)], "doc_id long, lang string, text string")
    ids = spark.createDataFrame([(2,)], "doc_id long")
    got = {r.doc_id: r.n_grams for r in kn_classifier.classify(df, ids).collect()}
    assert got == {1: 2000, 2: 1800}


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder()}/documents.parquet").collect()}
    rows = entry.queries()["op2_string_kernel"](spark, folder()).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    import zlib

    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


def plain_scores(sample, texts, options):
    """The same regression with the kernel written out pair by pair, without hashing."""

    def spectrum(text):
        text = re.sub(r"[^a-zäöüß]+", " ", text.lower())
        text = f" {text} " if text[:1] != " " else f" {text} "
        return {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])

    langs = sorted({l for l, _ in sample})
    every = [spectrum(t) for _, t in sample]
    marks = [x for l in langs for x in [s for s, (m, _) in zip(every, sample) if m == l][: options.landmarks]]
    inner, cross = kernel(marks, marks), kernel(every, marks)
    target = np.array([[1.0 if l == m else -1.0 for m in langs] for l, _ in sample])
    # min |K a - y|^2 + ridge a' K a over the landmarks' coefficients.
    a = np.linalg.lstsq(cross.T @ cross + options.ridge * inner, cross.T @ target, rcond=1e-10)[0]
    return kernel([spectrum(t) for t in texts], marks) @ a


def test_language_model_equals_pairwise_kernels():
    options = language.Fit(texts=12, landmarks=6)
    sample = [("aa", prose(i, 30)) for i in range(12)] + [("bb", prose(i, 30)[::-1]) for i in range(50, 62)]
    model = language.fit(sample, options)
    texts = [prose(70, 20), prose(71, 20)[::-1], "ba ce", prose(72, 500)]
    rows = [r for b in blocks(pa.array(texts)) for r in language.presence(b)]
    assert np.allclose(model._values(rows), plain_scores(sample, texts, options), atol=1e-2)


def test_language_hard_rows(spark, hard, empty):
    sample = language.sample_of(hard)
    assert len(sample) == len(set(sample)) and {l for l, _ in sample} == {"aa", "bb"}
    model = language.fit(sample)
    rows = language.identify(hard, model).collect()
    assert len(rows) == hard.count()
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            unknown = not any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == unknown and (r.score > 0) != unknown
    kept = language.keep_identified(hard, model, 0.0)
    assert kept.columns == hard.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    nothing = language.fit(language.sample_of(empty))
    assert {(r.lang_pred, r.score) for r in language.identify(hard, nothing).collect()} == {("und", 0.0)}
    assert language.identify(empty, model).collect() == []
