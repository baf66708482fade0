"""Tables between jobs: columnar, prunable, and safe from lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quaestor.session import cut_lineage


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back."""
    return cut_lineage(df, name)
