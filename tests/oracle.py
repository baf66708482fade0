"""Compare the named queries with their SQL on the test tables.

Run `python -m tests.oracle [key ...]` for a quick look, with TEST_SF=0.01 or
another scale.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def folder() -> str:
    return f"/root/testdata/sf{os.environ.get('TEST_SF', '0.01')}"


def duck(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{path}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return round(float(value), 9)
    return value


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, _sorted(tuple(_plain(row[n]) for n in names) for row in df.collect())


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.sql(sql)
    names = sorted(result.columns)
    at = [result.columns.index(n) for n in names]
    return names, _sorted(tuple(_plain(row[i]) for i in at) for row in result.fetchall())


def _sorted(rows) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v).__name__), str(v)) for v in row))


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for ours, theirs in zip(got[1], want[1]):
        if ours != theirs:
            return f"row {ours} != {theirs}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quaestor.session import build_session

    conf = {"spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = build_session(master="local[8]", shuffle_partitions=8, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder())
    oracles = entry.oracle_sql()
    for key, fn in entry.queries().items():
        if sys.argv[1:] and key not in sys.argv[1:]:
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, folder()))
            took = time.time() - start
            verdict = difference(got, duck_rows(con, oracles[key])) if key in oracles else "(no SQL)"
            print(f"{key:22s} {took:6.2f}s {len(got[1]):7d} rows {(verdict or 'ok')[:600]}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{key:22s} FAILED {type(error).__name__}: {str(error)[:900]}", flush=True)
