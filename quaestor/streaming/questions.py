"""Hybrid retrieval for questions as they arrive, against a stored corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from quaestor.operators.knn import knn
from quaestor.operators.retrieval import score_hybrid, with_chunks
from quaestor.session import cut_lineage
from quaestor.streaming.sinks import drain, put_batch, run_of


def question_stream(
    questions: DataFrame,
    corpus: DataFrame,
    target: str,
    checkpoint: str,
    embed: Callable[[str], Column] | None = None,
    k: int = 20,
    alpha: float = 0.7,
) -> None:
    """Write the scored candidates of each micro-batch of questions.

    Questions carry an `embedding` or get it from `embed`. The corpus, with
    `chunk_id`, `text` and `embedding`, is read anew for every micro-batch.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        asked = batch if embed is None else cut_lineage(batch.withColumn("embedding", embed("question")))
        near = with_chunks(knn(asked, corpus, k), corpus.select("chunk_id", "text"))
        put_batch(score_hybrid(near, alpha), target, batch_id, run_of(batch.sparkSession, checkpoint))

    drain(questions.writeStream.foreachBatch(answer), checkpoint)
