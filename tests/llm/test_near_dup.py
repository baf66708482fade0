from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from quaestor.llm import near_dup
from quaestor.llm.textops import blocks
from tests.oracle import difference, duck, duck_rows, folder, spark_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain(rows):
    """(doc_id, text) to {doc_id: component} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d, s in sets.items() if s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}, sets


def test_named_query_is_exact(spark):
    rows = spark.read.parquet(f"{folder()}/documents.parquet").select("doc_id", "text").collect()
    components, sets = plain([tuple(r) for r in rows])
    got = entry.queries()["op7_hyperminhash"](spark, folder()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), components[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_named_query_matches_sql(spark):
    key = "op7_hyperminhash"
    got = spark_rows(entry.queries()[key](spark, folder()))
    assert difference(got, duck_rows(duck(folder()), entry.oracle_sql()[key])) is None


def test_far_copies_of_one_text(spark):
    """Many copies with edits of their own: few link, and their pairs are never listed."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for number in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 8])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((number + 1, " ".join(words)))
    components, _ = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == components and 10 < len(set(got.values())) < 150


def edited(words, rate, rng):
    return [w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in words]


def test_chains_of_edits(spark):
    """Copies of copies: links between different texts, some of them just at the border."""
    rng = random.Random(5)
    rows, number = [], 0
    for family in range(6):
        words = [f"w{family}_{i}" for i in range(rng.choice([8, 40, 150, 600]))]
        for _ in range(25):
            rows.append((number, " ".join(words)))
            number += 1
            words = edited(words, rng.choice([0.0, 0.01, 0.02, 0.04]), rng)
    components, _ = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == components


def test_hard_rows(hard, empty):
    rows = hard.collect()
    known = [(r.doc_id, r.text) for r in rows if r.doc_id is not None]
    components, sets = plain(known)
    got = near_dup.near_duplicates(hard).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles) == (components[r.doc_id], len(sets[r.doc_id]))
    assert near_dup.near_duplicates(empty).collect() == []


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        every = rng.integers(0, 2**64, 3000, dtype=np.uint64)
        cut = rng.integers(0, 1400)
        a, b = np.unique(every[: 3000 - cut]), np.unique(every[cut:])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (near_dup.registers(s)[None] for s in (a, b))
        errors.append(near_dup.estimate(x, y, np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


@pytest.mark.parametrize("size", [1, 2, 7, 50, 5000])
def test_registers_of_equal_sets_agree(size):
    values = np.unique(np.random.default_rng(size).integers(0, 2**64, size, dtype=np.uint64))
    assert (near_dup.registers(values) == near_dup.registers(values.copy())).all()


def test_sets_do_not_depend_on_blocks():
    texts = ["a b c d e f g", None, "A B C", " ", "x " * 3000, "é b c d e f"]
    column = pa.array(texts, pa.string())
    one = [s.tolist() for b in blocks(column) for s in near_dup.shingle_sets(b)]
    many = [s.tolist() for b in blocks(column, 3) for s in near_dup.shingle_sets(b)]
    assert one == many and [len(s) for s in one] == [len(shingles(t)) for t in texts]
