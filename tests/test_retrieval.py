"""Scores, merges, re-ranking, search and evaluation on hand-worked cases."""

from __future__ import annotations

import re

import pytest

from quaestor.operators import evaluate as ev
from quaestor.operators import retrieval as rt
from quaestor.operators import search as se


def ranked(df, *columns):
    return [tuple(r) for r in df.orderBy("query_id", "rank").select(*columns).collect()]


def test_positions_and_fetch(spark):
    found = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 9, 0.9)], "query_id int, pos long, distance double")
    index = spark.createDataFrame([(0, "chunk_1"), (1, "chunk_2")], "pos long, chunk_id string")
    mapped = rt.map_positions(found, index)
    assert sorted(r.chunk_id for r in mapped.collect()) == ["chunk_1", "chunk_2"]
    wanted = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("x", 3)], "chunk_id string, position int")
    store = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "chunk_id string, text string")
    rows = rt.fetch_by_ids(wanted, store).orderBy("position").collect()
    assert [(r.chunk_id, r.text, r.position) for r in rows] == [("b", "B", 0), ("a", "A", 1)]
    assert rt.fetch_by_ids(wanted.limit(0), store).isEmpty()


def test_hybrid_score_keeps_first_stage_order_on_ties(spark):
    near = spark.createDataFrame(
        [(1, "far", 3.0, 1.0, 2), (1, "tie", 3.0, 1.0, 3), (1, "near", 0.0, 0.0, 1)],
        "query_id int, chunk_id string, distance double, similarity double, rank int",
    )
    scored = rt.score_hybrid(near)
    assert ranked(scored, "chunk_id", "relevance", "similarity", "final_score", "rank") == [
        ("far", 0.25, 1.0, 0.775, 1), ("tie", 0.25, 1.0, 0.775, 2), ("near", 1.0, 0.0, 0.3, 3),
    ]
    assert {r.chunk_id: r.final_score for r in rt.score_distance(near).collect()}["far"] == 0.25


def brute_keyword(questions, docs, rules, k):
    result = []
    for qid, text in questions:
        terms = [t for triggers, found in rules if any(w in text.lower() for w in triggers) for t in found]
        hits = []
        for term in terms:
            matches = [d for d, t in docs if t is not None and term in t.lower()]
            for doc in matches[: k // len(terms) + 1]:
                if (doc, term) not in hits:
                    hits.append((doc, term))
        result += [(qid, d, t, n + 1) for n, (d, t) in enumerate(hits[:k])]
    return sorted(result)


def test_keyword_search_matches_brute_force(spark):
    rules = [(["alpha", "beta"], ["one", "two"]), (["gamma"], ["two", "three", "four"])]
    texts = ["one two", "TWO", None, "three one", "none", "two three", "", "Four one two"]
    docs = [(f"d{i:02d}", t) for i, t in enumerate(texts * 3)]
    questions = [(1, "Alpha?"), (2, "beta and GAMMA"), (3, "nothing"), (4, "gamma")]
    q = spark.createDataFrame(questions, "query_id int, question string")
    d = spark.createDataFrame(docs, "chunk_id string, text string").repartition(4)
    for k in (1, 5, 10):
        got = rt.keyword_search(q, d, rules, k)
        rows = sorted((r.query_id, r.chunk_id, r.matched_term, r.position) for r in got.collect())
        assert rows == brute_keyword(questions, docs, rules, k)


def test_hybrid_merge_order(spark):
    semantic = spark.createDataFrame(
        [(1, "s1", 1, 0.1), (1, "both", 2, 0.2), (1, "s1", 3, 0.3), (2, "only", 1, None)],
        "query_id int, doc_id string, position int, distance double",
    )
    keyword = spark.createDataFrame(
        [(1, "k1", 1), (1, "both", 2), (1, "k2", 3), (1, "k1", 4)], "query_id int, doc_id string, position int"
    )
    merged = rt.hybrid_merge(semantic, keyword, 5)
    assert ranked(merged, "query_id", "doc_id", "search_type", "distance", "rank") == [
        (1, "k2", "keyword", 0.5, 1), (1, "k1", "keyword", 0.5, 2),
        (1, "s1", "semantic", 0.1, 3), (1, "both", "semantic", 0.2, 4),
        (2, "only", "semantic", 0.5, 1),
    ]
    assert rt.hybrid_merge(semantic, keyword, 2).filter("query_id = 1").count() == 2


MINI_RANKED = {
    1: '{"ranked_documents": [{"doc_id": "c", "relevance_score": 5, "reason": "r"}, {"doc_id": "zz", "relevance_score": 4},'
    ' {"doc_id": "a", "relevance_score": 3}, {"doc_id": "c", "relevance_score": 1, "reason": "again"}]}',
    2: '```json\n{"ranked_documents": [{"doc_id": "b", "relevance_score": 2, "reason": "x"}]}\n```',
    3: "sorry, no",
    4: '{"ranked_documents": []}',
    5: None,
    6: '{"other": 1}',
    7: '\n\n```json\n{"ranked_documents": [{"doc_id": "b", "relevance_score": 2}]}\n```\n',
    8: 'Here:\n```JSON {"ranked_documents": [{"doc_id": "b", "relevance_score": 2}]} ``` Done.',
    9: 'The answer is {"ranked_documents": [{"doc_id": "b", "relevance_score": 2}]}, as asked.',
}


def test_rerank_parse_and_merge(spark):
    outputs = spark.createDataFrame(list(MINI_RANKED.items()), "query_id int, output string")
    candidates = spark.createDataFrame(
        [(q, c, n + 1) for q in MINI_RANKED for n, c in enumerate("abcd")], "query_id int, chunk_id string, rank int"
    )
    parsed = rt.parse_ranked(outputs)
    assert {r.query_id for r in parsed.collect()} == {1, 2, 7, 8, 9}
    merged = rt.rerank_merge(candidates, parsed, 3)
    order = {}
    for q, c, s, source in ranked(merged, "query_id", "chunk_id", "reranker_score", "source"):
        order.setdefault(q, []).append((c, s, source))
    assert order[1] == [("c", 5, "reranked"), ("a", 3, "reranked"), ("b", None, "initial")]
    assert order[2] == [("b", 2, "reranked"), ("a", None, "initial"), ("c", None, "initial")]
    plain = [(c, None, "initial") for c in "abc"]
    assert order[3] == order[4] == order[5] == order[6] == plain
    off = rt.rerank_merge(candidates, parsed, 2, enabled=False)
    assert ranked(off.filter("query_id = 1"), "chunk_id") == [("a",), ("b",)]
    assert rt.rerank_merge(candidates.limit(0), parsed).isEmpty()


def test_keyword_rerank(spark):
    rows = [
        (1, "c1", "btk es bűnszervezet", "mi az a BTK btk", 0.5, 1),
        (1, "c2", "törvény", "mi az a BTK btk", 0.9, 2),
        (1, "c3", "semmi", "mi az a BTK btk", 0.9, 3),
    ]
    df = spark.createDataFrame(
        rows, "query_id int, chunk_id string, text string, question string, relevance double, rank int"
    )
    weights = {"btk": 0.2, "bűnszervezet": 0.3, "törvény": 0.1}
    expected = []
    for _, c, text, question, base, rank in rows:
        hits = sum(1 for w in set(question.lower().split()) if w in text.lower())
        boost = sum(v for w, v in weights.items() if w in text.lower())
        expected.append((-round(base + 0.1 * hits + boost, 4), rank, c))
    got = ranked(rt.keyword_rerank(df, weights, 2), "chunk_id", "reranker_score")
    assert got == [(c, -s) for s, _, c in sorted(expected)[:2]]


def test_authority_rank(spark):
    rows = [(1, "a", 3, 2, 2001), (1, "b", 3, 1, 1999), (1, "c", 5, 3, 1990), (1, "d", 3, 2, 2005)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, score int, court_rank int, year int")
    assert [c for (c,) in ranked(rt.authority_rank(df), "chunk_id")] == ["c", "b", "d", "a"]


def test_text_search(spark):
    docs = spark.createDataFrame(
        [("d1", "Cats and dogs. Cats!"), ("d2", "dogs"), ("d3", "the and of"), ("d4", None), ("d5", "CATS; dogs? birds")],
        "chunk_id string, text string",
    )
    index = se.text_index(docs)
    postings = {(r.token, r.chunk_id): r.tf for r in index.collect()}
    assert postings[("cats", "d1")] == 2 and ("and", "d1") not in postings and len(postings) == 6
    asked = spark.createDataFrame([(1, "cats birds"), (2, "the"), (3, "dogs dogs")], "query_id int, question string")
    every = se.text_search(asked, docs)
    assert ranked(every, "query_id", "chunk_id", "matched") == [(1, "d5", 2), (1, "d1", 1), (3, "d1", 1), (3, "d2", 1), (3, "d5", 1)]
    both = se.text_search(asked, docs, mode="and")
    assert ranked(both.filter("query_id = 1"), "chunk_id") == [("d5",)]
    blocks = se.text_search(asked, docs.repartition(4), block=1)
    assert ranked(blocks, "query_id", "chunk_id", "score") == ranked(every, "query_id", "chunk_id", "score")
    assert se.text_search(asked, docs.limit(0)).count() == se.text_search(asked.limit(0), docs).count() == 0


def test_snippets(spark):
    snippets = spark.createDataFrame(
        [("c", 0, "zero", [1.0, 0.0]), ("c", 1, "Indok olás", [1.0, 1.0]), ("c", 2, "two", [0.0, 1.0]),
         ("c", 3, "same as zero", [1.0, 0.0]), ("other", 0, "x", [1.0, 0.0])],
        "chunk_id string, snippet_no int, snippet string, snippet_embedding array<float>",
    )
    pairs = spark.createDataFrame([(1, "c")], "query_id int, chunk_id string")
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    row = se.select_snippets(pairs, snippets, questions).first()
    assert row.snippet == "Indok olás\n\n---\n\nzero\n\n---\n\nsame as zero"
    assert row.snippets == 3 and row.best_score == round(1.5 * 0.5**0.5, 6)
    # A chunk without snippets stays, with its whole text if there is one.
    both = spark.createDataFrame([(1, "c"), (1, "bare"), (1, "lost")], "query_id int, chunk_id string")
    texts = spark.createDataFrame([("bare", " "), ("c", "all")], "chunk_id string, text string")
    got = {r.chunk_id: r for r in se.select_snippets(both, snippets, questions, whole=texts).collect()}
    assert len(got) == 3 and got["c"].snippet == row.snippet
    assert (got["bare"].snippet, got["bare"].snippets, got["bare"].best_score) == (" ", 0, None)
    assert got["lost"].snippet is None


MINI_GT = [
    ("none", [], ["L1_1"]),
    ("two docs", ["L1_.*"], ["L1_1", "L1_2", "X"]),
    ("middle only", ["1_.*"], ["L1_1"]),
    ("no results", ["L1_.*"], []),
    ("second", ["Q.*", "B|C"], ["A", "C", "B"]),
]


def brute_metrics(patterns, docs):
    found = sum(any(re.match(p, d) for d in docs) for p in patterns)
    precision = found / len(docs) if docs else 0
    recall = found / len(patterns) if patterns else 0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0
    first = next((i + 1 for i, d in enumerate(docs) if any(re.match(p, d) for p in patterns)), 0)
    return tuple(round(x, 9) for x in (precision, recall, f1, 1 / first if first else 0))


def test_retrieval_metrics(spark):
    truth = spark.createDataFrame([(q, p) for q, p, _ in MINI_GT], "query_id string, doc_patterns array<string>")
    found = spark.createDataFrame(
        [(q, d, n + 1) for q, _, docs in MINI_GT for n, d in enumerate(docs)], "query_id string, doc_id string, rank int"
    )
    got = {
        r.query_id: tuple(round(x, 9) for x in (r.precision_at_k, r.recall_at_k, r.f1_at_k, r.mrr))
        for r in ev.evaluate_retrieval(found, truth).collect()
    }
    assert got == {q: brute_metrics(p, d) for q, p, d in MINI_GT}
    assert got["middle only"] == (0, 0, 0, 0)


def test_answer_quality(spark):
    long_text = " ".join(["szó"] * 48)
    answers = [
        ("plain", "A felperes nyert", ["nyert", "vesztett"]),
        ("cited", "x (Forrás: Pf.1) y (Forrás: Kf.2) (Forrás: )", []),
        ("w49", long_text + " x", ["szó"]),
        ("w50", long_text + " x y", ["szó"]),
        ("w500", " ".join(["a"] * 500), ["b"]),
        ("w501", " ".join(["a"] * 501), ["b"]),
        *[(m, m + " ...", ["x"]) for m in ev.SECTION_MARKERS],
    ]
    df = spark.createDataFrame(answers, "query_id string, answer string, key_points array<string>")
    rows = {r.query_id: r for r in ev.answer_quality(df).collect()}
    assert rows["plain"].key_points_coverage == 0.5 and rows["plain"].key_points_found == ["nyert"]
    assert rows["plain"].legal_terms_used == ["felperes", "per"]
    assert (rows["cited"].citation_count, rows["cited"].has_citations) == (2, True)
    assert rows["cited"].key_points_coverage == 0.0
    assert [rows[w].is_adequate_length for w in ("w49", "w50", "w500", "w501")] == [False, True, True, False]
    assert all(rows[m].has_structured_response for m in ev.SECTION_MARKERS)
    assert not rows["plain"].has_structured_response


@pytest.fixture
def cases(spark):
    rows = [
        (1, "Q" * 60, "civil", "easy", 1.0, 1.0, 1.0, 1.0, 0.5, 0.9, True, 60),
        (2, "short", "civil", "hard", 0.5, 0.5, 0.5, 0.5, 0.5, 0.7, False, 10),
        (3, "third", "criminal", "hard", 0.0, 0.0, 0.0, 0.0, 1.0, 0.8, False, 99),
    ]
    names = (
        "query_id int, question string, domain string, difficulty string, precision_at_k double, recall_at_k double, "
        "f1_at_k double, mrr double, key_points_coverage double, semantic_similarity double, has_citations boolean, word_count int"
    )
    return spark.createDataFrame(rows, names)


def test_reports(cases):
    overall = {r.metric: (round(r.mean, 6), round(r.std, 6)) for r in ev.overall(cases).collect()}
    assert overall["precision_at_k"] == (0.5, 0.408248)
    groups = {(r.grouping, r.value): (r.mean_precision, r.cases) for r in ev.grouped(cases).collect()}
    assert groups == {
        ("domain", "civil"): (0.75, 2), ("domain", "criminal"): (0.0, 1), ("difficulty", "easy"): (1.0, 1),
        ("difficulty", "hard"): (0.25, 2), ("all", "all"): (0.5, 3),
    }
    grade = ev.grade(cases).first()
    assert round(grade.overall_score, 4) == round(100 * (0.5 * 0.3 + 2 / 3 * 0.4 + 0.8 * 0.3), 4)
    assert grade.grade == "FAIR"
    advice = {r.component for r in ev.recommendations(cases).collect()}
    assert advice == {"precision_at_k", "key_points_coverage"}
    best = {r.kind: r.query_id for r in ev.best_and_worst(cases).collect()}
    assert best == {"best": 3, "worst": 1}
    summary = {r.query_id: r.question for r in ev.summary(cases).collect()}
    assert summary[1] == "Q" * 50 + "..." and summary[2] == "short..."
    text_ids = cases.withColumn("query_id", cases.query_id.cast("string"))
    assert {r.kind: r.query_id for r in ev.best_and_worst(text_ids).collect()} == {"best": "3", "worst": "1"}
    assert ev.grade(cases.filter("query_id < 0")).first().overall_score is None


def test_compile_needs_both_sides(spark, cases):
    truth = cases.select("query_id", "question", "domain", "difficulty")
    retrieval = spark.createDataFrame([(1, 0.5), (2, 0.5)], "query_id int, precision_at_k double")
    answers = spark.createDataFrame([(2, "a"), (3, "b")], "query_id int, answer string")
    similarity = spark.createDataFrame([(1, 0.1)], "query_id int, semantic_similarity double")
    row = ev.compile_cases(truth, retrieval, answers, similarity).collect()
    assert [(r.query_id, r.semantic_similarity) for r in row] == [(2, 0.0)]
