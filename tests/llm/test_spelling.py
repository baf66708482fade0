from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from quaestor.llm import spelling
from quaestor.llm.textops import blocks
from tests.oracle import folder

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain(rows):
    """Two words are near if they share what one deletion leaves, at fitting places."""
    counts = counted(rows)
    near, by_gap = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_gap[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_gap.values():
        for w in group:
            near[w] |= group - {w}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), counts.get(forms[w]))
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{folder()}/documents.parquet").select("doc_id", "text").collect()
    df = entry.queries()["op13_bloom_neighbourhoods"](spark, folder())
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found, want = got(df), plain([(r.doc_id, r.text) for r in rows])
    assert found == want
    assert any(form for form, *_ in want.values())


def chained():
    """Counts that grow tenfold along a chain, ties, long words, letters of both alphabets."""
    rng = random.Random(3)
    texts = ["abcdefgh " * 2, "abcdefgi " * 70, "abcdefji " * 800, "abcdekji " * 9000, "xbcdekji " * 100_000]
    texts += ["ÀÉÿçñöüß " * 3, "ÀÉÿçñöü " * 3, "àÉÿçñöüß " * 40, "aaaabbbb " * 2, "aaabbbb " * 30, "aaaabbb " * 30]
    long = "".join(rng.choices("abcdefgé", k=3000))
    texts += [f"{long} {long} x{long} x{long} {long[:-1]}z {long[:-1]}z", "m" * 33 + " " + "m" * 32, "m" * 33 + "-" + "m" * 32]
    words = ["".join(rng.choices("abc", k=rng.randint(6, 10))) for _ in range(4000)]
    texts += [" ".join(rng.choices(words, k=300)) for _ in range(60)]
    return [*enumerate(texts), (None, texts[0]), (None, None), (5, None), (6, ""), (7, "×÷×÷×÷×÷ ×÷×÷×÷×÷"), (0, texts[0])]


def test_chains_ties_and_long_words(spark):
    rows = chained()
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = plain(rows)
    assert want["abcdefgh"][:2] == ("abcdefgi", "xbcdekji")
    assert got(spelling.group_variants(df.repartition(4))) == want


def test_many_rounds_give_the_same(spark):
    """With filters of 64 slots each length is cut into parts and every word takes part in several rounds."""
    rows = [r for r in chained() if len(r[1] or "") < 10_000][:30]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.group_variants(df, round_slots=128)) == plain(rows)


def test_rounds_are_bounded():
    rounds = spelling.rounds_of({7: 10_000_000, 8: 900_000_000, 9: 50, 32: 10}, 1 << 20)
    assert all(sum(s.slots for s in r) <= 1 << 20 for r in rounds)
    parts = Counter(s.length for r in rounds for s in r)
    assert parts == {7: 1, 8: 64, 9: 1, 32: 1}
    assert all(s.base + s.slots <= 1 << 20 for r in rounds for s in r)


def test_few_false_positives(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("abcdefghijklmnop", k=11)) for _ in range(20_000)}
    df = spark.createDataFrame([(w, 2, 11) for w in words], "word string, n long, class int")
    assert spelling.candidates(df).count() < 0.5 * len(words)


def test_hard_rows(hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert got(spelling.group_variants(hard)) == plain(rows)
    assert spelling.group_variants(empty).collect() == []


def test_checksums_of_runs():
    data = np.frombuffer(b"abc" + b"x" * 200 + b"hello", np.uint8)
    starts, ends = np.array([0, 3, 203]), np.array([3, 203, 208])
    prefixes = np.array([zlib.crc32(b"1:"), zlib.crc32(b"2:"), zlib.crc32(b":")], np.uint32)
    want = [zlib.crc32(b"1:abc"), zlib.crc32(b"2:" + b"x" * 200), zlib.crc32(b":hello")]
    assert spelling._checksums(data, starts, ends, prefixes).tolist() == want


def test_one_word_of_a_megabyte_is_linear():
    began = time.process_time()
    (block,) = blocks(pa.array(["é" * 500_000]), 1 << 20)
    rows = spelling._block_counts(pa.array(["1"]), block)
    assert rows.num_rows == 1
    prober = spelling._Prober(np.zeros(64, np.uint64), [spelling.Shard(32, 0, 1, 64, 0)], np.array([233, 234], np.uint8))
    (matrix, _), = spelling._lengths(rows.column(0))
    assert list(prober.edited(matrix)) == []
    assert time.process_time() - began < 10
