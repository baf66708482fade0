"""Scans with checks, parameterised SQL and managed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical tables; a fresh build drops children before parents.
SCHEMAS = {
    "documents": "doc_id STRING, source STRING, text STRING, attrs MAP<STRING, STRING>, "
    "created_at TIMESTAMP, updated_at TIMESTAMP",
    "chunks": "chunk_id STRING, doc_id STRING, chunk_no INT, text STRING, embedding ARRAY<FLOAT>, "
    "created_at TIMESTAMP, updated_at TIMESTAMP",
}


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """`df` itself, or an error that names the missing columns; starts no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scan_checked(
    spark: SparkSession,
    path: str,
    required: Sequence[str],
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parquet scan with a check of its columns and canonical names.

    `rename` maps the file's names to canonical ones, e.g. text_chunk to text.
    """
    return require_columns(
        spark.read.parquet(path).withColumnsRenamed(dict(rename or {})), required
    )


def sql_rows(spark: SparkSession, statement: str, args: Mapping[str, Any], **frames: DataFrame):
    """Run SQL with named parameters (`:name`) over the given frames (`{name}`)."""
    return spark.sql(statement, args=dict(args), **frames)


def create_tables(spark: SparkSession, database: str = "default", fresh: bool = False) -> None:
    """Create the canonical tables where absent; `fresh` drops them first."""
    if fresh:
        for name in reversed(SCHEMAS):
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def table_counts(tables: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Rows per named table, optionally of those that meet a condition."""
    counts = [
        (df if condition is None else df.filter(condition)).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("rows")
        )
        for name, (df, condition) in tables.items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result.select("table_name", "rows")


def validate_requests(
    requests: DataFrame, low: int = 1, high: int = 20, default: int = 5
) -> DataFrame:
    """Fill the defaults of a request table and say why a row is refused."""
    filled = requests.withColumn(
        "max_documents", F.coalesce("max_documents", F.lit(default))
    ).withColumn("use_cache", F.coalesce("use_cache", F.lit(True)))
    reason = F.when(F.col("question").isNull(), "question missing").when(
        ~F.col("max_documents").between(low, high), f"max_documents not in {low}..{high}"
    )
    return filled.withColumn("reason", reason).withColumn("accepted", reason.isNull())
