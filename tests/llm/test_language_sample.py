from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.llm import language


def test_copies_take_no_share_of_the_sample(spark):
    """A language of many copies still gives all the different texts that are promised."""
    texts = language.Fit().texts
    ids = spark.range(300 * 40)
    many = ids.select(F.lit("aa").alias("lang"), F.concat(F.lit("many "), F.col("id") % 300).alias("text"))
    few = ids.select(F.lit("bb").alias("lang"), F.concat(F.lit("few "), F.col("id") % 3).alias("text"))
    sample = language.sample_of(many.union(few))
    assert len(sample) == len(set(sample))
    assert {l: sum(m == l for m, _ in sample) for l in ("aa", "bb")} == {"aa": texts, "bb": 3}
