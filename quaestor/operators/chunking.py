"""Cutting documents into overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine; "" means single characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def chunk_key(doc_id: Column, chunk_no: Column, text: Column) -> Column:
    """Chunk id that is the same on every run: a hash of where and what."""
    return F.sha2(
        F.concat_ws("\x1f", doc_id.cast("string"), chunk_no.cast("string"), text), 256
    )


def chunk_fixed(
    docs: DataFrame, size: int = 1024, overlap: int = 128, id_col: str = "doc_id"
) -> DataFrame:
    """Windows of `size` characters, each starting `size - overlap` after the last.

    The last window is the first to reach the end of the text. Parent columns
    are carried; empty and null texts give no chunk.
    """
    _check(size, overlap)
    step = size - overlap
    tail = F.greatest(F.char_length("text") - size, F.lit(0))
    last = F.ceil(tail / step).cast("int")
    starts = F.when(F.char_length("text") > 0, F.sequence(F.lit(0), last))
    return _with_parents(
        docs.withColumn("chunk_no", F.explode(starts)).withColumn(
            "_piece", F.substring("text", F.col("chunk_no") * step + 1, F.lit(size))
        ),
        docs,
        id_col,
    )


def chunk_recursive(
    docs: DataFrame, size: int = 1024, overlap: int = 128, id_col: str = "doc_id"
) -> DataFrame:
    """Chunks cut at the coarsest separator that keeps them within `size`."""
    _check(size, overlap)
    split = recursive_splitter(size, overlap)
    return _with_parents(
        docs.select("*", F.posexplode(split("text")).alias("chunk_no", "_piece")), docs, id_col
    )


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and below size {size}")


def _with_parents(pieces: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    parents = [c for c in docs.columns if c not in ("text", "chunk_id") or c == id_col]
    key = chunk_key(F.col(id_col), F.col("chunk_no"), F.col("_piece"))
    head = [] if id_col == "chunk_id" else [key.alias("chunk_id")]
    return pieces.select(*head, F.col("_piece").alias("text"), "chunk_no", *parents)


def recursive_splitter(
    size: int, overlap: int, separators: Sequence[str] = SEPARATORS
) -> Callable[[str], Column]:
    """Arrow UDF from a text column to its array of chunks."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda t: None if t is None else list(split_text(t, size, overlap, separators))
            )

    return split


def split_text(
    text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS
) -> Iterator[str]:
    """Chunks of one text, separators staying at the front of what they precede."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    small: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _pack(small, size, overlap)
        small = []
        if finer:
            yield from split_text(piece, size, overlap, finer)
        else:
            yield piece
    yield from _pack(small, size, overlap)


def _pieces(text: str, separator: str) -> Iterator[str]:
    if not separator:
        yield from text
        return
    head, *rest = text.split(separator)
    if head:
        yield head
    for part in rest:
        yield separator + part


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to `size`, restarting within `overlap`.

    `start` and `total` describe the window pieces[start:here]; the next window
    keeps as many trailing pieces as fit the overlap and leave room.
    """
    start = total = 0
    for here, piece in enumerate(pieces):
        need = len(piece)
        if total + need > size and here > start:
            yield from _stripped(pieces[start:here])
            while total > overlap or (total and total + need > size):
                total -= len(pieces[start])
                start += 1
        total += need
    yield from _stripped(pieces[start:])


def _stripped(pieces: Sequence[str]) -> Iterator[str]:
    chunk = "".join(pieces).strip()
    if chunk:
        yield chunk


def register_chunk_function(spark) -> None:
    """Table function for SQL: `SELECT * FROM chunk_text(text, size, overlap)`."""

    @F.udtf(returnType="chunk_no: int, chunk: string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            if text is not None:
                yield from enumerate(split_text(text, size, overlap))

    spark.udtf.register("chunk_text", ChunkText)
