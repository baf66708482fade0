from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from quaestor.llm import decontaminate
from quaestor.llm.decontaminate import MASKS, Rule, overlap
from quaestor.llm.textops import blocks
from tests.llm.conftest import prose
from tests.oracle import folder


@pytest.mark.parametrize("n", range(12, 20))
def test_masks_hit_every_stretch(n):
    """Whatever fifth of n tokens is substituted, some mask meets none of them."""
    laid = [
        sum(1 << (at + i) for i, c in enumerate(mask) if c == "1")
        for mask in MASKS
        for at in range(n - len(mask) + 1)
    ]
    for changed in itertools.combinations(range(n), n // 5):
        bits = sum(1 << i for i in changed)
        assert any(not places & bits for places in laid)


def tokens_of(text):
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = lower.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    return [w for w in (x.strip(signs + "\x0b\x0c") for x in words) if w]


def plain(docs, items, rule=Rule()):
    """All pairs, all diagonals."""
    found = {}
    for d, text in docs:
        a = np.array(tokens_of(text), object)
        for i, item in items:
            b = np.array(tokens_of(item), object)
            if len(b) < rule.least_tokens:
                continue
            best = None
            for shift in range(-len(b) + 1, len(a)):
                low, high = max(shift, 0), min(len(a), shift + len(b))
                equal = a[low:high] == b[low - shift : high - shift]
                s, e = overlap(np.asarray(equal, bool), rule.identity)
                if e - s >= rule.least_tokens:
                    own = (int(equal[s:e].sum()), e - s, -(low + s), -(low - shift + s))
                    best = max(best or own, own)
            if best:
                found[d, i] = (-best[2], -best[3], best[1], best[0])
    return found


def as_dict(df):
    return {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_tokens, r.n_equal) for r in df.collect()}


def test_tokens():
    texts = ['"Ab" c-d, (E) ... é! \n x', None, "", "!!", "a"]
    for size in (1, 1 << 20):
        counts = []
        for block in blocks(pa.array(texts), size):
            counts += np.bincount(decontaminate.tokens(block)[1], minlength=len(block)).tolist()
        assert counts == [len(tokens_of(t)) for t in texts] == [5, 0, 0, 0, 1]


def test_named_query_is_exact(spark):
    tables = [spark.read.parquet(f"{folder()}/{t}.parquet") for t in ("documents", "benchmark")]
    docs = [(r.doc_id, r.text) for r in tables[0].collect()]
    items = [(r.item_id, r.text) for r in tables[1].collect()]
    got = as_dict(entry.queries()["op1_spaced_seeds"](spark, folder()))
    flagged = {d for d, _ in got}
    assert flagged and got == plain([(d, t) for d, t in docs if d in flagged], items)
    # Comparing all diagonals is slow in plain Python: of the rest, the short texts.
    assert plain([(d, t) for d, t in docs if d not in flagged and len(t) < 700], items) == {}


def test_substitutions_everywhere(spark):
    rng = random.Random(3)
    items = [(i, prose(100 + i, 40)) for i in range(8)]
    docs = []
    for d in range(60):
        words = prose(1000 + d, 80).split()
        item = rng.choice(items)[1].split()
        length = rng.choice([10, 12, 15, 25, 40])
        at = rng.randrange(len(item) - length + 1)
        part = [w if rng.random() > 0.15 else "changed" for w in item[at : at + length]]
        docs.append((d, " ".join(words[:30] + part + words[30:])))
    frames = [
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ]
    assert as_dict(decontaminate.contaminated(*frames)) == plain(docs, items)


def test_hard_rows(spark, hard, empty):
    items = [(1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, "too short"), (None, prose(18, 30))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = as_dict(decontaminate.contaminated(hard, frame))
    assert {k for k in got if k[1] == 1} == {(d, 1) for d in (1, 2, 3, 11, None)}
    assert (18, None) in got and all(i in (1, None) for _, i in got)
    assert decontaminate.contaminated(empty, frame).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(hard, none).collect() == []


def test_long_items_are_compared_whole(spark):
    """An item of 1,000 tokens whose tail differs, and one with a third of its second half substituted."""
    item = prose(77, 1000).split()
    tail = item[:760] + [f"new{i}" for i in range(240)]
    thin = item[:500] + [w if i % 3 else "changed" for i, w in enumerate(item[500:])]
    docs = [(1, " ".join(["before", *tail, "after"])), (2, " ".join(thin)), (3, " ".join(item[600:]))]
    items = [(1, " ".join(item)), (2, prose(78, 14))]
    frames = [
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ]
    got = as_dict(decontaminate.contaminated(*frames))
    assert got == plain(docs, items) and got[1, 1][2] == 950 and got[2, 1][2] == 1000
