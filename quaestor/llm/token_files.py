"""Token ids in ORC files: integer run lengths, row indexes, Bloom filters.

`write_tokens` deals the documents out by ranges of their id, encodes each range
in order and writes it as one ORC file. ORC's integer columns are run-length
encoded; the id column is sorted, so row-group statistics bound it tightly, and
a Bloom filter on it answers point look-ups inside a stripe. Readers take
stripes in parallel, and a filter on `doc_id` skips files, stripes and row
groups by this metadata alone.

`read_tokens` gives the documents back with their place in the whole stream of
ids. Each row holds its place within its file, so the place in the stream needs
only the sum of each file before it: one narrow aggregate over two columns.

Null and empty texts are one end id. A null id comes first. Rows of equal id
are ordered by their text; equal rows are interchangeable, and ranges are cut
within one id if it holds many rows. An empty table writes an empty table. Only
the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.llm.textops import blocks
from quaestor.llm.tokens import END_ID, encoder

#: How the files are laid out; see the ORC specification for each.
LAYOUT = {
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> None:
    """Write (doc_id, part, start_in_part, n_tokens, ids) in ascending doc_id."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "_tie"]
    ranged = (
        own.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_tie")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, encode = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids = [np.append(x, np.int32(END_ID)) for x in encode.encode(block)]
                ends = np.cumsum([len(x) for x in ids])
                offsets = np.append(0, ends).astype(np.int32)
                columns = [
                    batch.column(0)[block.rows],
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(start + offsets[:-1].astype(np.int64)),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                ]
                start += int(ends[-1])
                names = ["doc_id", "part", "start_in_part", "n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
    ranged.mapInArrow(task, schema).write.options(**LAYOUT).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) with `start` in the stream of all ids.

    The table of files has a row per file, whatever the number of documents.
    """
    stored = spark.read.orc(path)
    files = stored.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    start = (F.col("_base") + F.col("start_in_part")).alias("start")
    return stored.join(F.broadcast(base), "part").select("doc_id", start, "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what `read_tokens` gives."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = lists.flatten().to_numpy().astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy())
            raw = memoryview(values.tobytes())
            bounds = [0, *(4 * ends).tolist()]
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
            columns = [*batch.columns[:3], pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return tokens.mapInArrow(task, schema)
