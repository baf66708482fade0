from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm import packing, token_files
from quaestor.llm.packing import Limits
from quaestor.llm.textops import blocks
from quaestor.llm.tokens import encoder
from quaestor.session import shared_folder

import pyarrow as pa


def ids_of(text):
    return np.append(encoder().whole(text or ""), 0).astype("<u4")


def encoded(texts, size=1 << 20):
    return [x.tolist() for b in blocks(pa.array(texts, pa.string()), size) for x in encoder().encode(b)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" '\n\tastrvlmed5É.-ｱ²٣ \U0001f600"), max_size=30), max_size=6), st.integers(1, 60))
def test_block_encoding_equals_library(texts, size):
    assert encoded(texts, size) == [encoder().whole(t).tolist() for t in texts]


def test_added_tokens_and_long_texts():
    texts = ["a<|endoftext|>b", None, "", "word " * 50_000 + "it's"]
    assert encoded(texts) == [encoder().whole(t or "").tolist() for t in texts]


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 50), Limits(128, 128, 127), Limits(100, 2, 99)])
def test_pieces_cover_each_id_once(hard, limits):
    rows = packing.pack_documents(hard, limits).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = Counter()
    for row in hard.collect():
        want[row.doc_id, len(ids_of(row.text))] += len(ids_of(row.text))
    assert {k: sum(n for _, n, _ in v) for k, v in parts.items()} == dict(want)
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    for (doc, _), own in parts.items():
        if doc is None:
            continue
        ids = ids_of(texts[doc])
        times = want[doc, len(ids)] // len(ids)
        assert Counter(i for s, n, _ in own for i in range(s, s + n)) == dict.fromkeys(range(len(ids)), times)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in own)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert total <= limits.tokens and len(own) <= limits.segments
        assert sum(n - 1 for _, n in own) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0


def test_rounds_of_bounded_size(hard, monkeypatch):
    whole = packing.pack_documents(hard.filter("doc_id is not null"))
    packer = packing.DocumentPacker(Limits())
    out = packer.add(0, 2500)
    assert [p[:3] for p in out] == [(0, 0, 1024), (0, 1024, 1024)]
    assert packer.pack(last=False) == [] and packer.waiting == 452
    rest = packer.pack(last=True)
    assert sorted(p[2] for p in rest) == [4, 64, 128, 256] and packer.waiting == 0
    assert whole.count() > 0


def test_no_rows(empty):
    assert packing.pack_documents(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 120)), max_size=60))
def test_examples_stay_whole_under_all_limits(examples):
    limits = Limits(100, 4, 80)
    tokens, loss = (np.array([e[i] for e in examples], np.int64) for i in (0, 1))
    bins, offsets = packing.place(tokens, loss, limits)
    for i, (t, l) in enumerate(examples):
        assert (bins[i] >= 0) == (t <= 100 and l <= 80)
    for b in set(bins.tolist()) - {-1}:
        own = np.flatnonzero(bins == b)
        assert tokens[own].sum() <= 100 and len(own) <= 4 and loss[own].sum() <= 80
        order = own[np.lexsort((tokens[own], offsets[own]))]
        assert (offsets[order] == np.append(0, np.cumsum(tokens[order])[:-1])).all()


def test_examples_as_a_job(spark):
    rows = [(1, 900, 800), (2, 200, 10), (2, 200, 10), (None, 50, None), (3, 5000, 1), (4, None, None)]
    df = spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long")
    got = packing.pack_examples(df).collect()
    assert len(got) == 6
    assert [r.example_id for r in got if r.sequence_id is None] == [3]
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.tokens if r.sequence_id is not None else 0
    assert max(filled.values()) <= 1024


def test_files_round_trip(spark, hard):
    path = f"{shared_folder(spark)}/tokens-test"
    token_files.write_tokens(hard.filter("doc_id is not null"), path)
    rows = token_files.digest(token_files.read_tokens(spark, path)).collect()
    rows.sort(key=lambda r: (r.start))
    want = sorted((r.doc_id, r.text or "") for r in hard.collect() if r.doc_id is not None)
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    at = 0
    for row, (_, text) in zip(rows, want):
        ids = ids_of(text)
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    back = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, path).collect()}
    assert back[10] == ids_of(dict(want)[10]).tolist()
    plan = spark.read.orc(path).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan


def test_files_of_nulls_and_nothing(spark, hard, empty):
    for name, df, n in (("nulls", hard.filter("doc_id is null"), 2), ("none", empty, 0)):
        path = f"{shared_folder(spark)}/tokens-{name}"
        token_files.write_tokens(df, path)
        assert token_files.digest(token_files.read_tokens(spark, path)).count() == n
