"""Sinks: Parquet, JSON and CSV, and the readers that go with them."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_MAP_SCHEMA = "pos BIGINT, chunk_id STRING"
# Columns too long or nested for the flat report.
REPORT_DROPPED = ("key_points_found", "legal_terms_used")


def write_parquet(df: DataFrame, path: str) -> None:
    """Replace the table at `path`, which `df` may read.

    The new files are written beside it and take its place by a rename, so a
    failed write leaves the old table, and readers never see half a table. An
    empty frame leaves an empty table with its schema.
    """
    spark, beside = df.sparkSession, path.rstrip("/")
    mark = uuid.uuid4().hex
    df.write.parquet(f"{beside}.new-{mark}")
    at = spark._jvm.org.apache.hadoop.fs.Path
    new, old, target = at(f"{beside}.new-{mark}"), at(f"{beside}.old-{mark}"), at(beside)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"{path} cannot be replaced")
    if not files.rename(new, target):
        raise OSError(f"{path} cannot be replaced; its new files are in {new}")
    if files.exists(old):
        files.delete(old, True)
    spark.catalog.refreshByPath(beside)


def write_id_map(index: DataFrame, path: str) -> None:
    """Position and chunk id of a vector index as JSON lines."""
    _need_json(path)
    index.select(F.col("pos").cast("long"), F.col("chunk_id").cast("string")).write.mode(
        "overwrite"
    ).json(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    _need_json(path)
    return spark.read.schema(ID_MAP_SCHEMA).json(path)


def _need_json(path: str) -> None:
    if not path.endswith(".json"):
        raise ValueError(f"unsupported id map format: {path}")


def write_report(cases: DataFrame, path: str) -> None:
    """Evaluation cases as JSON lines with the time of writing."""
    dropped = [c for c in REPORT_DROPPED if c in cases.columns]
    cases.drop(*dropped).withColumn("timestamp", F.current_timestamp()).write.mode(
        "overwrite"
    ).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Evaluation summary as CSV with a header."""
    summary.write.mode("overwrite").option("header", True).csv(path)


def read_template(path: str) -> str:
    """A prompt template with `{placeholders}`."""
    return Path(path).read_text(encoding="utf-8")
