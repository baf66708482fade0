from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_near_dup import shingles


def kept_at(rows, percent):
    """Smallest ids of the groups that pairs of at least `percent` link, from all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    common = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), both in common.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d for d in sets if find(d) == d}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_duplicate_stage_links_from_80(spark, size):
    """The stage drops copies of 0.80 to 0.85 too, by brute force."""
    path = f"/root/testdata/{size}"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, path).collect()}
    assert got == kept_at(rows, 80) and len(got) < len(kept_at(rows, 85))
