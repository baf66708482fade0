"""Token ids of whole texts, by a public byte-level vocabulary.

The tokenizers library splits a text into pieces (a word with the blank before
it, a number, a run of signs, white space) and encodes each piece on its own.
Texts repeat pieces, so a block is split with array operations and only its
distinct new pieces go through the library; a bounded table keeps them for the
worker's next blocks, and the commoner half of them when it is full. Texts that hold one of the vocabulary's added tokens go
through the library whole. The tests hold the ids against the library's own.
"""

from __future__ import annotations

import os
import sys
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from quaestor.llm.textops import Block, hash_runs

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0

#: Pieces that a worker keeps; beyond, it keeps the half that came up in most blocks.
KEPT_PIECES = 500_000

#: Pieces that the library gets at once.
_AT_ONCE = 4096

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)

#: The endings that the vocabulary's splitting rule cuts off a word.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    where = np.arange(sys.maxunicode + 1, dtype=np.int32)
    where = where[(where < 0xD800) | (where >= 0xE000)]
    every = where.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            classes[where[found.start() : found.end()]] = kind
    return classes


class Encoder:
    """Encodes blocks of texts; one per worker and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        # Ascending hashes of the pieces, and the number of each.
        self.known = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        # In how many blocks the piece of each number came up; halved with the table.
        self.hits = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _forget_rare(self, wanted: int) -> None:
        """Make room for `wanted` pieces."""
        if wanted > KEPT_PIECES // 2:
            self._forget()
            return
        rows = np.sort(np.argsort(-self.hits[self.number], kind="stable")[: KEPT_PIECES // 2])
        old = self.number[rows]
        self.known, self.number = self.known[rows], np.arange(len(rows), dtype=np.int32)
        length = self.begin[old + 1] - self.begin[old]
        stop = np.cumsum(length)
        self.used = int(stop[-1]) if len(stop) else 0
        self.flat[: self.used] = self.flat[np.repeat(self.begin[old] - (stop - length), length) + np.arange(self.used)]
        self.begin[1 : len(rows) + 1] = stop
        self.hits[: len(rows)] = self.hits[old] // 2

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, block: Block) -> list[np.ndarray]:
        """Ids of each document of the block, without an end id."""
        if not len(block.data):
            return [np.zeros(0, np.int32) for _ in range(len(block))]
        texts = block.data.tobytes().decode("utf-8", "replace")
        ids, counts = self._pieces(block, texts)
        out = np.split(ids, np.cumsum(counts)[:-1])
        if any(token in texts for token in self.added):
            for i in range(len(block)):
                text = block.text(i)
                if any(token in text for token in self.added):
                    out[i] = self.whole(text)
        return out

    def _pieces(self, block: Block, texts: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(texts.encode("utf-32-le"), np.uint32)
        lead = (block.data & 0xC0) != 0x80
        at_byte = np.append(np.flatnonzero(lead), len(block.data))
        offsets = np.searchsorted(at_byte, block.offsets)
        starts = split(points, offsets)
        ends = np.append(starts[1:], len(points))
        hashes = hash_runs(block.data, at_byte[starts], at_byte[ends])
        coded = pa.array(hashes).dictionary_encode()
        inverse, unique = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        order = np.argsort(unique)
        unique = unique[order]
        at, held = self._find(unique)
        missing = len(unique) - int(held.sum())
        if len(self.known) + missing > KEPT_PIECES:
            self._forget_rare(missing)
            at, held = self._find(unique)
        new = np.flatnonzero(~held)
        if len(new):
            # Codes are dealt in reading order, so a new one is larger than all before it.
            first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))[order[new]]
            raw = [texts[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            numbers = self._learn(*self._library_ids(raw))
            self.known = np.insert(self.known, at[new], unique[new])
            self.number = np.insert(self.number, at[new], numbers)
        found = self.number[np.searchsorted(self.known, unique)]
        self.hits[found] += 1
        places = np.empty(len(found), np.int32)
        places[order] = found
        place = places[inverse]
        begin = self.begin[place]
        length = self.begin[place + 1] - begin
        stop = np.cumsum(length)
        take = np.repeat(begin - (stop - length), length) + np.arange(stop[-1])
        per_piece = np.append(0, stop)
        counts = np.diff(per_piece[np.searchsorted(starts, offsets)])
        return self.flat[take], counts

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of ascending hashes stands among the known ones, and whether it is known."""
        at = np.searchsorted(self.known, hashes)
        held = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        held[inside] = self.known[at[inside]] == hashes[inside]
        return at, held

    def _library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        ids, lengths = [], []
        for at in range(0, len(pieces), _AT_ONCE):
            part = pieces[at : at + _AT_ONCE]
            found = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, fresh: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        count, end = len(self.known), self.used + len(fresh)
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * end)
        if count + len(lengths) + 1 > len(self.begin):
            self.begin = np.resize(self.begin, 2 * (count + len(lengths) + 1))
            self.hits = np.resize(self.hits, len(self.begin))
        self.flat[self.used : end] = fresh
        self.begin[count + 1 : count + len(lengths) + 1] = self.used + np.cumsum(lengths)
        self.hits[count : count + len(lengths)] = 0
        self.used = end
        return np.arange(count, count + len(lengths), dtype=np.int32)


def split(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin.

    Letters, numbers, other signs and white space make runs. The last character
    of a run of white space stands apart from the rest if something follows it
    in the text, and if it is a blank it joins what follows. An apostrophe that
    begins a piece takes an English ending with it.
    """
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    last = np.append(first[1:], True)[:n]
    space = kind == _SPACE
    # The last white space before a character that isn't white space.
    joint = np.zeros(n, bool)
    joint[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    begins |= joint
    blank = joint & (points == 0x20)
    after = np.flatnonzero(blank) + 1
    begins[after] = False
    quote = np.flatnonzero(begins & (points == 0x27) & ~last)
    padded = np.concatenate([points[:], np.zeros(3, points.dtype)])
    for ending in _ENDINGS:
        hit = quote
        for j, letter in enumerate(ending, 1):
            hit = hit[(padded[hit + j] == ord(letter)) & ~first[np.minimum(hit + j, n)]]
        begins[hit + 1] = False
        rest = hit + len(ending) + 1
        rest = rest[rest < n]
        # What is left of the word is a piece of its own.
        begins[rest] |= kind[rest] == _LETTER
    return np.flatnonzero(begins)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder; `path` is a vocabulary file on every machine."""
    return Encoder(path or public_tokenizers.path(VOCABULARY))
