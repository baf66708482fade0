"""Language identification with a string kernel.

The kernel of two texts counts the character n-grams of orders 1 to 4 that both
have (presence, not frequency, over all orders: a blended spectrum), divided by
the geometric mean of their own counts. N-grams are those of the lower-cased
whole text, every run of characters that aren't letters read as one blank, and
are hashed into 2^18 columns.

Landmarks are some of the labelled texts. The kernel against them, whitened by
the landmarks' own kernel (Nyström), gives features; kernel ridge regression on
these, one language against the rest, gives weights. Whitening, weights and the
landmarks' n-grams fold into one matrix with a row per n-gram that some landmark
has and a column per language, so a batch of texts is scored by one product of
its presence matrix with it.

The model is fitted on a bounded sample of the labelled rows: per language the
`Fit.texts` different texts with the smallest hash of the text itself, the first
`Fit.landmarks` of them landmarks. Everything else reads all rows whole.

A prediction sees nothing but the text. A null text, or one without a letter, is
`und` with score 0; so is every text if there was nothing to learn from. The
score is a softmax of the languages' regression values. Ties go to the language
that sorts first. Repeated rows are predicted each; null ids are carried. An
empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.symbols import code_points
from quaestor.llm.textops import Block, blocks, map_blocks, mix

ORDERS = 4
_COLUMNS = 1 << 18
_BLANK = 0x20
UNKNOWN = "und"

#: Documents whose presence rows are multiplied at once.
_AT_ONCE = 128


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample, and the ridge's strength."""

    texts: int = 200
    landmarks: int = 40
    ridge: float = 0.1
    sharpness: float = 8.0  # of the softmax behind the score


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter; a blank for all that isn't one."""
    table = np.full(sys.maxunicode + 1, _BLANK, np.uint32)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def presence(block: Block) -> Iterator[np.ndarray]:
    """The distinct n-gram columns of each document; none if it has no letter."""
    points, offsets = code_points(block)
    letters = _letters()[points]
    blank = letters == _BLANK
    starts = np.zeros(len(points) + 1, bool)
    starts[offsets] = True
    # A blank after a blank of the same document is dropped.
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | starts[1:-1]
    kept = np.append(0, np.cumsum(keep))[offsets]
    chars = letters[keep].astype(np.uint64)
    solid = ~blank[keep]
    for a, b in zip(kept[:-1].tolist(), kept[1:].tolist()):
        yield _columns(chars[a:b]) if solid[a:b].any() else np.zeros(0, np.int64)


def _columns(chars: np.ndarray) -> np.ndarray:
    text = np.concatenate([[np.uint64(_BLANK)], chars, [np.uint64(_BLANK)]])
    flags = np.zeros(_COLUMNS, bool)
    code = np.zeros(len(text), np.uint64)
    for order in range(1, ORDERS + 1):
        if len(text) < order:
            break
        code = code[: len(text) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + text[order - 1 :]
        flags[(mix(code + np.uint64(order)) >> np.uint64(46)).astype(np.int64)] = True
    return np.flatnonzero(flags)


class Model:
    """The folded matrix: `weights[slot[c]]` is the row of n-gram column c."""

    def __init__(self, languages: list[str], slot: np.ndarray, weights: np.ndarray, sharpness: float):
        self.languages, self.slot, self.weights, self.sharpness = languages, slot, weights, sharpness

    def predict(self, rows: list[np.ndarray]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(rows), _AT_ONCE):
            part = rows[at : at + _AT_ONCE]
            values = self._values(part)
            shifted = np.exp(self.sharpness * (values - values.max(axis=1, keepdims=True, initial=-9)))
            share = shifted / shifted.sum(axis=1, keepdims=True)
            for columns, value, own in zip(part, values, share):
                known = len(columns) and len(self.languages)
                best = int(np.argmax(value)) if known else 0
                names.append(self.languages[best] if known else UNKNOWN)
                scores.append(float(own[best]) if known else 0.0)
        return names, scores

    def _values(self, rows: list[np.ndarray]) -> np.ndarray:
        matrix = np.zeros((len(rows), len(self.weights)), np.float32)
        for i, columns in enumerate(rows):
            # Slot 0 collects the n-grams of no landmark; its weights are 0.
            matrix[i, self.slot[columns]] = 1
        size = np.sqrt([max(len(columns), 1) for columns in rows])
        return matrix @ self.weights / size[:, None]


def fit(sample: list[tuple[str, str]], options: Fit = Fit()) -> Model:
    """Learn from (lang, text) rows, each language's landmarks first."""
    languages = sorted({lang for lang, _ in sample})
    column = pa.array([text for _, text in sample], pa.string())
    rows = [r for block in blocks(column) for r in presence(block)]
    use = [i for i, r in enumerate(rows) if len(r)]
    taken: dict[str, int] = {}
    landmarks = []
    for i in use:
        taken[sample[i][0]] = taken.get(sample[i][0], 0) + 1
        if taken[sample[i][0]] <= options.landmarks:
            landmarks.append(i)
    if not landmarks:
        return Model([], np.zeros(_COLUMNS, np.int32), np.zeros((1, 0), np.float32), options.sharpness)
    columns = np.unique(np.concatenate([rows[i] for i in landmarks]))
    slot = np.zeros(_COLUMNS, np.int32)
    slot[columns] = np.arange(1, len(columns) + 1)

    def normed(which: list[int]) -> np.ndarray:
        out = np.zeros((len(which), len(columns) + 1), np.float32)
        for j, i in enumerate(which):
            out[j, slot[rows[i]]] = 1 / np.sqrt(len(rows[i]))
        out[:, 0] = 0
        return out

    base = normed(landmarks)
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    solid = value > 1e-6 * value[-1]
    whiten = vector[:, solid] / np.sqrt(value[solid])
    gram = np.zeros((whiten.shape[1],) * 2)
    right = np.zeros((whiten.shape[1], len(languages)))
    for at in range(0, len(use), _AT_ONCE):
        part = use[at : at + _AT_ONCE]
        features = (normed(part) @ base.T) @ whiten
        target = np.array([[1.0 if sample[i][0] == l else -1.0 for l in languages] for i in part])
        gram += features.T @ features
        right += features.T @ target
    ridge = np.linalg.solve(gram + options.ridge * np.eye(len(gram)), right)
    weights = base.T @ (whiten @ ridge)
    return Model(languages, slot, weights.astype(np.float32), options.sharpness)


def sample_of(labelled: DataFrame, options: Fit = Fit(), text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """Per language the texts with the smallest hash: at most `options.texts` each.

    A count of different texts per language, copies being one, tells which share
    of the hashes suffices, so the ranking sees about twice the rows it keeps and
    no language comes together in a task.
    """
    has = F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = labelled.filter(has).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    distinct = rows.select("lang", "hash").distinct()
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(None).cast("long")
    for name, n in sorted(counts.items()):
        share = min(1.0, (2 * options.texts + 40) / n)
        limit = F.when(F.col("lang") == name, int(-(2**63) + share * (2**64 - 4096))).otherwise(limit)
    near = rows.filter(F.col("hash") <= limit).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    ranked = near.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    )
    chosen = ranked.filter(F.col("rank") <= options.texts).select("lang", "rank", "text").collect()
    return [(r.lang, r.text) for r in sorted(chosen, key=lambda r: (r.lang, r["rank"]))]


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        names, scores = model.predict(list(presence(block)))
        columns = [batch.column(0)[block.rows], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    schema = f"doc_id {kind}, lang_pred string, score double"
    return own.mapInArrow(lambda batches: map_blocks(batches, 1, make), schema)


def keep_identified(
    docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """Rows of `docs` whose language is told with at least that score; columns as they are."""
    at = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        names, scores = model.predict(list(presence(block)))
        keep = [n != UNKNOWN and s >= least_score for n, s in zip(names, scores)]
        return batch.slice(block.first, len(block)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lambda batches: map_blocks(batches, at, make), docs.schema)
