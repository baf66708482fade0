"""Texts as sequences over a small alphabet, and the codes of their n-grams.

Latin letters stand for themselves in either case, digits, sentence signs and
other ASCII signs are one symbol each, every other character falls into one of
17 classes by its lower-case code point. An n-gram's code is its number in base
48, so codes are a perfect hash, a code holds its context and its suffix, and a
model of order n has at most 48 + … + 48^n entries however large the corpus: at
order 4, 5.4 million.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from quaestor.llm.textops import Block

BASE = 48
_START = BASE - 1
_CLASSES = 17


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    points = np.arange(0x110000)
    table = (30 + points % _CLASSES).astype(np.uint8)
    for point in range(0x80, 0x2000):
        lower = chr(point).lower()
        if len(lower) == 1:
            table[point] = 30 + ord(lower) % _CLASSES
    table[:128] = 29
    table[:33] = 0
    for sign in ".,;:!?'\"-()":
        table[ord(sign)] = 28
    table[48:58] = 27
    table[65:91] = table[97:123] = np.arange(1, 27)
    return table


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's characters and where each document begins among them."""
    text = block.data.tobytes().decode("utf-8", "replace")
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.searchsorted(lead, block.offsets)


def grams(block: Block, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each character, and the offsets of documents.

    Before its first character a document has start symbols.
    """
    points, offsets = code_points(block)
    symbols = _table()[points]
    pad = order - 1
    shift = pad * (1 + np.repeat(np.arange(len(block)), np.diff(offsets)))
    padded = np.full(len(points) + pad * (len(block) + 1), _START, np.int64)
    place = np.arange(len(points)) + shift
    padded[place] = symbols
    codes = np.zeros(len(points), np.int64)
    for back in range(pad, -1, -1):
        codes = codes * BASE + padded[place - back]
    return codes, offsets
