"""Vector column functions: distances, norms and codecs, all inside the JVM
except the hexadecimal form, which needs the bits of a float."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    squares = lambda acc, x: acc + x * x
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), squares))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; null for a zero vector."""
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(as_doubles(vector), lambda x: x / norm))


def squared_l2(left: Column, right: Column) -> Column:
    squares = F.zip_with(as_doubles(left), as_doubles(right), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero or missing."""
    return F.coalesce(
        F.try_divide(dot(left, right), l2_norm(left) * l2_norm(right)), F.lit(0.0)
    )


def parse_vector(text: Column) -> Column:
    """`[a,b,...]` to an array; blank, missing or malformed text gives null."""
    parsed = F.from_json(F.trim(text), "array<float>")
    bad = F.exists(parsed, lambda x: x.isNull())
    return F.when((F.trim(text) != "") & ~bad, parsed)


def format_vector(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


@F.pandas_udf(T.StringType())
def vector_to_hex(vectors: pd.Series) -> pd.Series:
    """Hex of the vector's little-endian float32 bytes; a batch is one buffer."""
    given = vectors[vectors.notna()]
    digits = np.concatenate([np.zeros(0, "<f4"), *given]).astype("<f4").tobytes().hex()
    ends = np.cumsum([8 * len(v) for v in given]).tolist()
    cut = [digits[a:b] for a, b in zip([0, *ends], ends)]
    return _with_nulls(given.index, cut, vectors.index)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hex_to_vector(texts: pd.Series) -> pd.Series:
    """Inverse of `vector_to_hex`; blank, missing or malformed text gives null."""
    given = texts[texts.astype("string").str.fullmatch(r"(?:[0-9a-fA-F]{8})+").fillna(False).astype(bool)]
    values = np.frombuffer(bytes.fromhex("".join(given)), dtype="<f4")
    ends = np.cumsum([len(t) // 8 for t in given], dtype=int)
    cut = [values[a:b].tolist() for a, b in zip([0, *ends], ends)]
    return _with_nulls(given.index, cut, texts.index)


def _with_nulls(given: pd.Index, values: list, every: pd.Index) -> pd.Series:
    found = dict(zip(given, values))
    return pd.Series([found.get(i) for i in every], index=every, dtype=object)
