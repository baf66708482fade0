"""A corpus from raw documents to packed sequences, stage by stage.

Each stage is one of the operators of `quaestor.llm` with its decision applied:
what it returns is written, and the next stage reads that. All but the last
return the columns they were given. Null ids and repeated rows are handled as
the operators say; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import decontaminate, language, near_dup, packing, secrets
from quaestor.llm.bloom import anti_join
from quaestor.llm.stored import stored
from quaestor.session import shared_folder


#: Five-word shingles link from 0.8 on; bands of six miss about 3e-6 of such pairs.
NEAR = near_dup.Rule(percent=80, band_rows=6)


#: Rows and bytes of an Arrow batch. Ten thousand texts, the default, are 20 MB and
#: more, held several times over by each task and its worker; a thousand long ones
#: are more than that. A longer text is a batch of its own.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Keep to smaller batches from here on; smaller settings stay."""
    for what, most in (("Records", ARROW_ROWS), ("Bytes", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.max{what}PerBatch"
        # Spark gives a default size in bytes; one with another unit was set on purpose.
        value = spark.conf.get(name).removesuffix("b")
        if value.lstrip("-").isdigit() and not 0 < int(value) <= most:
            spark.conf.set(name, str(most))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string kernel tells; the rest go."""
    _small_batches(spark)
    model = language.fit(language.sample_of(docs))
    return language.keep_identified(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id.

    An id of several texts keeps each that is not a copy of another document,
    one row of it.
    """
    _small_batches(spark)
    return near_dup.one_of_each(docs, NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item.

    A row without an id cannot be named by its overlap and stays.
    """
    _small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, items).select("doc_id").distinct()
    return anti_join(docs, stored(found, "contaminated"), "doc_id")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind; `n_chars` follows."""
    _small_batches(spark)
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither the language model nor the tokenizer; the tests hold
#: the rows against a plain computation of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
