from __future__ import annotations

from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline
from quaestor.llm import language, near_dup, secrets
from quaestor.llm.tokens import encoder
from tests.llm.conftest import hard_rows, prose
from tests.llm.test_decontaminate import plain as plain_overlaps
from tests.llm.test_pipeline_links import kept_at
from tests.llm.test_scans import all_spans
from tests.oracle import folder

STAGES = dict(corpus_pipeline.STAGES)


def redacted(text):
    if text is None:
        return None
    out, at, spans = "", 0, all_spans(text)
    while spans:
        start, end, rule = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[1])
        out += text[at:start] + f"[{secrets.RULES[rule].kind}]"
        at = end
    return out + text[at:]


def test_stages_against_plain_computation(spark):
    """Each stage on its own input, at the smallest scale, against plain Python."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}

    found = STAGES["language"](spark, docs, path)
    assert found.columns == columns
    after = {r.doc_id: r for r in found.collect()}
    model = language.fit(language.sample_of(docs))
    told = language.identify(docs, model).collect()
    assert set(after) == {r.doc_id for r in told if r.lang_pred != "und" and r.score >= 0.5}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert all(d in after for d in before if quality.get(d) == 1)

    found = STAGES["near_duplicates"](spark, docs, path)
    assert found.columns == columns
    assert {r.doc_id for r in found.collect()} == kept_at([(d, r.text) for d, r in before.items()], 80)

    found = STAGES["decontamination"](spark, docs, path)
    assert found.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    short = {d: r.text for d, r in before.items() if len(r.text) < 1200}
    bad = {d for d, _ in plain_overlaps(list(short.items()), items)}
    assert {r.doc_id for r in found.collect()} & set(short) == set(short) - bad

    found = STAGES["secrets"](spark, docs, path)
    assert found.columns == columns
    for r in found.collect():
        assert r.text == redacted(before[r.doc_id].text) and r.n_chars == len(r.text)


def test_whole_pipeline(spark):
    path = "/root/testdata/sf0.001"
    rows = entry.queries()["pipeline"](spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
    left = {r.doc_id: len(encoder().whole(r.text)) + 1 for r in docs.collect()}
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert dict(got) == left


def test_hard_rows_and_nothing(spark, hard, empty):
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder())
        assert docs.columns == hard.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        nothing = stage(spark, empty, folder())
        assert nothing.columns == empty.columns and nothing.collect() == []
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) - ids.count(None) == len({i for i in ids if i is not None})
    assert 2 not in ids and 11 not in ids and {4, 5, 6, 19}.isdisjoint(ids)
    assert corpus_pipeline.packed(spark, docs, folder()).count() > 0
    assert corpus_pipeline.packed(spark, empty, folder()).collect() == []
    assert len(hard_rows()) == hard.count()


def test_no_unique_text_is_lost_under_a_shared_id(spark):
    """An id with several texts loses those that are copies, and no other; repeated rows become one."""
    a, b = prose(21, 120), prose(22, 120)
    near = a + " and more"
    cases = [
        ([(3, a), (3, b), (4, near)], {(3, a), (3, b)}, {3: {3}, 4: {3}}),
        ([(2, a), (3, near), (3, b)], {(2, a), (3, b)}, {2: {2}, 3: {2, 3}}),
        ([(5, a), (5, a), (5, b), (None, a), (6, None), (6, None)], {(5, a), (5, b), (None, a), (6, None)}, {5: {5}, None: {None}, 6: {6}}),
    ]
    for rows, want, components in cases:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        left = [tuple(r) for r in STAGES["near_duplicates"](spark, docs, folder()).collect()]
        assert sorted(left, key=str) == sorted(want, key=str)
        got = defaultdict(set)
        for r in near_dup.near_duplicates(docs).collect():
            got[r.doc_id].add(r.component_id)
            assert r.kept == (r.doc_id == r.component_id)
        assert dict(got) == components
