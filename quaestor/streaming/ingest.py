"""Incremental corpus load: exactly once per chunk id, resumable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quaestor.operators.ingest import insert_ignore
from quaestor.streaming.sinks import drain, other_batches, put_batch, run_of


def ingest_stream(
    chunks: DataFrame,
    target: str,
    checkpoint: str,
    key: str = "chunk_id",
    order: Sequence[str] = ("doc_id",),
) -> None:
    """Append the new chunks of the stream to the table at `target`.

    Each micro-batch is compared with what earlier ones stored and written to
    its own folder, so neither a replayed batch nor a restart adds a row twice.
    Folders carry the id of the checkpoint's stream, so a stream with another
    checkpoint adds to the table instead of replacing its batches. One writer
    per table at a time.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch.sparkSession, checkpoint)
        stored = other_batches(batch.sparkSession, target, batch_id, run)
        known = batch.limit(0) if stored is None else stored
        put_batch(insert_ignore(batch, known, key, order), target, batch_id, run)

    drain(chunks.writeStream.foreachBatch(load), checkpoint)
