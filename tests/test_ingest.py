"""Loading, sampling, memo and profiling on small fixtures."""

from __future__ import annotations

import datetime as dt
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.functions.embedding import HashEmbedder, embed_udf, text_model_udf
from quaestor.operators import ingest as ig
from quaestor.operators import profile as pf
from quaestor.operators import scale as sc
from quaestor.operators.memo import memoize
from quaestor.sources import sinks as sk
from quaestor.sources import tables as st

MINI_INGEST = [
    ("k1", "d1", 0, "a", "s", [1.0]),
    ("k1", "d2", 0, "b", None, [1.0]),  # duplicate key in the batch
    ("old", "d3", 0, "c", "s", [1.0]),  # stored already
    (None, "d4", 0, "d", "s", [1.0]),  # no chunk id
    ("", "d5", 1, "e", "s", [1.0]),
    ("k6", None, 0, "f", "s", [1.0]),  # no document
    ("k7", "", 0, "g", "s", [1.0]),
    ("k8", "d8", 0, "h", "s", None),  # no vector
]


@pytest.fixture
def mini(spark):
    return spark.createDataFrame(
        MINI_INGEST,
        "chunk_id string, doc_id string, chunk_no int, text string, source string, embedding array<float>",
    )


def test_admit_defaults_and_insert_ignore(spark, mini):
    ready = ig.with_defaults(ig.admit_rows(mini))
    assert {r.doc_id for r in ready.collect()} == {"d1", "d2", "d3", "d4", "d5"}
    assert {r.source for r in ready.filter("doc_id = 'd2'").collect()} == {"N/A"}
    again = ig.with_defaults(ig.admit_rows(mini))
    assert ready.exceptAll(again).isEmpty()
    stored = spark.createDataFrame([("old",)], "chunk_id string")
    new = ig.insert_ignore(ready, stored)
    assert sorted(r.doc_id for r in new.collect()) == ["d1", "d4", "d5"]
    assert ig.insert_ignore(new, new).isEmpty()


def test_vector_checks(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 0.0])], "id string, embedding array<float>"
    )
    valid, rejects = ig.split_valid_vectors(df)
    assert sorted(r.id for r in valid.collect()) == ["a", "d"]
    assert sorted((r.id, r.reason) for r in rejects.collect()) == [("b", "null"), ("c", "dim")]
    assert ig.split_valid_vectors(df, dim=1)[0].first().id == "c"
    with pytest.raises(ValueError, match="no vector"):
        ig.split_valid_vectors(df.filter("id = 'b'"))


def test_orphans_and_cascade(spark):
    child = spark.createDataFrame([("x", "d1"), ("y", "d2"), ("z", None), ("w", "d2")], "id string, doc_id string")
    parent = spark.createDataFrame([("d1",)], "doc_id string")
    assert sorted(r.id for r in ig.orphans(child, parent).collect()) == ["w", "y"]
    assert sorted(r.id for r in ig.cascade_delete(child, parent).collect()) == ["w", "y", "z"]


def test_batches(spark):
    rows = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "e"), (2, "f"), (3, None), (4, "g")], "batch int, chunk_id string"
    )
    loaded = spark.createDataFrame([(c,) for c in "abceg"], "chunk_id string")
    done = {r.batch: (r.sampled, r.found, r.done) for r in ig.batch_done(rows, loaded).collect()}
    assert done == {1: (3, 3, True), 2: (2, 1, False), 3: (0, 0, False), 4: (1, 1, True)}
    exact = {r.batch: (r.complete, r.resume_after) for r in ig.ingest_progress(rows, loaded).collect()}
    assert exact == {1: (False, None), 2: (False, None), 3: (False, None), 4: (True, None)}
    every = loaded.union(spark.createDataFrame([("d",)], "chunk_id string"))
    assert ig.ingest_progress(rows, every).first().resume_after == 1


def test_stratified_sample_is_exact_and_repeatable(spark):
    sizes = {"hot": 5000, "mid": 125, "small": 25, "one": 1}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, stratum string").repartition(5)
    for digits in (1, 3):
        sample = ig.stratified_sample(df, "stratum", "id", 0.1, digits=digits)
        counts = Counter(r.stratum for r in sample.collect())
        assert counts == {"hot": 500, "mid": 12, "small": 2}  # 12.5 and 2.5 go to the even number
    first = {r.id for r in ig.stratified_sample(df, "stratum", "id", 0.1, digits=1).collect()}
    assert first == {r.id for r in sample.collect()}
    assert first != {r.id for r in ig.stratified_sample(df, "stratum", "id", 0.1, seed=7).collect()}
    assert ig.stratified_sample(df, "stratum", "id", 1.0).count() == len(rows)
    for fraction in (0, 1.5):
        with pytest.raises(ValueError):
            ig.stratified_sample(df, "stratum", "id", fraction)


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(1000).select(
        F.md5(F.col("id").cast("string")).alias("chunk_id"),
        F.when(F.col("id") % 10 > 0, F.array(F.lit(1.0))).alias("embedding"),
    )
    got = [(r.pos, r.chunk_id) for r in ig.vector_index(df).collect()]
    ids = sorted(r.chunk_id for r in df.filter("embedding is not null").collect())
    assert sorted(got) == list(enumerate(ids))


def test_running_total_per_group(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 5).alias("w"))
    got = sc.running_total(df, ["id"], F.col("w"), "before", ["g"], partitions=6)
    totals = {0: 0, 1: 0}
    for row in sorted(got.collect(), key=lambda r: r.id):
        assert row.before == totals[row.g]
        totals[row.g] += row.w


def test_lag_over_slices(spark):
    rows = [("s", t, float(t * t % 17)) for t in range(60)] + [("one", 5, 1.0)]
    df = spark.createDataFrame(rows, "series string, ts int, value double")
    got = sc.lag_in_slices(df, ["series"], ["ts"], "value", "before", partitions=7)
    for row in got.collect():
        want = None if row.series == "one" or row.ts == 0 else float((row.ts - 1) ** 2 % 17)
        assert row.before == want


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", float(i)) for i in range(40)], "id int, g string, v double")
    sample = Counter(r.g for r in ig.stratified_sample(df, "g", "id", 0.5).collect())
    assert sample == {None: 10, "a": 10}
    assert sc.running_total(df, ["id"], F.lit(1), "n", ["g"]).count() == 40
    lagged = sc.lag_in_slices(df, ["g"], ["id"], "v", "before", partitions=7)
    assert lagged.filter("before = v - 2").count() == 38
    medians = pf.exact_percentiles(df, "v", [0.5], ["m"], ["g"])
    assert {r.g: r.m for r in medians.collect()} == {"a": 19.0, None: 20.0}


def test_null_keys_are_sampled_too(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("id"), F.lit("a").alias("g"))
    for fraction in (0.1, 0.5, 0.95, 1.0):
        assert ig.stratified_sample(df, "g", "id", fraction).count() == round(1000 * fraction)


def test_equal_rows_are_told_apart_the_same_way(spark):
    rows = [("k", 1, t) for t in "cab"]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "chunk_id string, doc_id int, text string").repartition(n)
        assert [r.text for r in ig.insert_ignore(df, df.limit(0)).collect()] == ["a"]


def test_progress_of_a_complete_and_an_empty_load(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "batch int, chunk_id string")
    for ids, last in ((["a", "b", "c", "d"], 3), (["a", "b", "d"], 1), (["c", "d"], None)):
        loaded = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
        got = ig.ingest_progress(rows, loaded).collect()
        assert len(got) == 3 and {r.resume_after for r in got} == {last}


def test_salted_join_keeps_every_row(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    left = left.unionByName(spark.range(3).select(F.lit("cold").alias("k"), "id"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert sc.salted_join(left, right, ["k"], "inner", ["id"]).count() == 1000
    kept = sc.salted_join(left, right, ["k"], "left", ["id"])
    assert kept.count() == 1003 and kept.filter("v is null").count() == 3


def test_ordered_page(spark):
    df = spark.range(10).select(F.col("id").alias("chunk_id"))
    assert [r.chunk_id for r in ig.ordered_page(df, "chunk_id", 1, 3).collect()] == [3, 4, 5]
    assert ig.ordered_page(df, "chunk_id", 9, 3).isEmpty()


def test_memo_computes_each_text_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "id int, text string")
    now = dt.datetime(2024, 1, 1, 12)
    key = "e:" + "{}"
    import hashlib

    def stored(text, value, expires):
        return (key.format(hashlib.sha256(text.encode()).hexdigest()), value, expires)

    memo = spark.createDataFrame(
        [stored("b", "kept", now + dt.timedelta(seconds=1)), stored("c", "stale", now)],
        "key string, value string, expires_at timestamp",
    )
    shout = text_model_udf(lambda: str.upper)
    found, fresh = memoize(df, memo, "e", "text", shout, F.lit(now), 60)
    assert {r.id: (r.value, r.memo_hit) for r in found.collect()} == {
        1: ("A", False), 2: ("A", False), 3: ("kept", True), 4: ("C", False), 5: (None, None),
    }
    new = fresh.collect()
    assert sorted(r.value for r in new) == ["A", "C"]
    assert {r.expires_at for r in new} == {now + dt.timedelta(seconds=60)}


def test_embedder_hook(spark):
    df = spark.createDataFrame([("x y",), (None,), ("",)], "t string")
    rows = [r[0] for r in df.select(embed_udf(lambda: HashEmbedder(8))("t")).collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-6
    assert rows[1] is None and rows[2] == [0.0] * 8


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=501).tolist(), "b": [5.0] * 200 + [1.0, 9.0], "c": [2.5]}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = pf.exact_percentiles(df, "v", [0.25, 0.5, 0.99], ["x", "y", "z"], ["g"])
    for row in got.collect():
        want = np.percentile(values[row.g], [25, 50, 99])
        assert np.allclose([row.x, row.y, row.z], want)
    whole = pf.exact_percentiles(df, "v", [0.5], ["m"]).first().m
    assert np.isclose(whole, statistics.median(v for vs in values.values() for v in vs))


def test_profiles(spark):
    df = spark.createDataFrame([(2001, None), (2004, "x"), (2004, None), (None, None)], "year int, s string")
    nulls = {r.column: (r.nulls, r.percent) for r in pf.profile_nulls(df).collect()}
    assert nulls == {"year": (1, 25.0), "s": (3, 75.0)}
    years = sorted((r.year, r.n) for r in pf.year_histogram(df).collect())
    assert years == [(2001, 1), (2002, 0), (2003, 0), (2004, 2)]
    chunks = spark.createDataFrame([("d1", "ab"), ("d1", "abcd"), ("d2", "a")], "doc_id string, text string")
    stats = pf.corpus_stats(chunks, approximate=True).first()
    assert (stats.documents, stats.chunks, stats.chunks_per_document) == (2, 3, 1.5)
    assert (stats.min_length, stats.max_length) == (1, 4)
    assert pf.corpus_stats(chunks.limit(0)).first().chunks_per_document is None


def test_scan_check_names_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).withColumnRenamed("id", "text_chunk").write.parquet(path)
    assert st.scan_checked(spark, path, ["text"], {"text_chunk": "text"}).columns == ["text"]
    with pytest.raises(ValueError, match="embedding, doc_id"):
        st.scan_checked(spark, path, ["text_chunk", "embedding", "doc_id"])


def test_tables_are_created_and_rebuilt(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS mini LOCATION '{tmp_path / 'db'}'")
    try:
        st.create_tables(spark, "mini")
        spark.sql("INSERT INTO mini.documents (doc_id, source) VALUES ('d', 's')")
        st.create_tables(spark, "mini")
        assert spark.table("mini.documents").count() == 1
        st.create_tables(spark, "mini", fresh=True)
        assert spark.table("mini.documents").count() == 0
        assert "embedding" in spark.table("mini.chunks").columns
    finally:
        spark.sql("DROP DATABASE mini CASCADE")


def test_request_rules(spark):
    df = spark.createDataFrame(
        [(1, "q", None, None), (2, "q", 0, False), (3, "q", 20, True), (4, "q", 21, None), (5, None, 5, None)],
        "id int, question string, max_documents int, use_cache boolean",
    )
    rows = {r.id: (r.max_documents, r.use_cache, r.accepted) for r in st.validate_requests(df).collect()}
    assert rows == {
        1: (5, True, True), 2: (0, False, False), 3: (20, True, True), 4: (21, True, False), 5: (5, True, False),
    }


def test_sinks(spark, tmp_path):
    index = spark.createDataFrame([(0, "chunk_1"), (1, "chunk_2")], "pos long, chunk_id string")
    path = str(tmp_path / "map.json")
    sk.write_id_map(index, path)
    back = sk.read_id_map(spark, path)
    assert back.dtypes == [("pos", "bigint"), ("chunk_id", "string")]
    assert sorted(map(tuple, back.collect())) == [(0, "chunk_1"), (1, "chunk_2")]
    with pytest.raises(ValueError, match="unsupported"):
        sk.read_id_map(spark, str(tmp_path / "map.pkl"))
    table = str(tmp_path / "t")
    sk.write_parquet(index.limit(0), table)
    assert spark.read.parquet(table).columns == ["pos", "chunk_id"]
    sk.write_parquet(spark.range(5), table)
    sk.write_parquet(spark.read.parquet(table).filter("id > 1"), table)
    assert [r.id for r in spark.read.parquet(table).orderBy("id").collect()] == [2, 3, 4]
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sk.write_parquet(broken, table)
    assert spark.read.parquet(table).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir() if ".old-" in p.name) == []
    cases = spark.createDataFrame([(1, ["a"], 0.5)], "query_id int, key_points_found array<string>, mrr double")
    sk.write_report(cases, str(tmp_path / "r.json"))
    report = spark.read.json(str(tmp_path / "r.json"))
    assert set(report.columns) == {"query_id", "mrr", "timestamp"}
    sk.write_summary(cases.drop("key_points_found"), str(tmp_path / "s.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s.csv")).first().mrr == "0.5"
    template = tmp_path / "p.txt"
    template.write_text("Kérdés: {question}", encoding="utf-8")
    assert sk.read_template(str(template)) == "Kérdés: {question}"
