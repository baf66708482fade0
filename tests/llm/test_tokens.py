from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa

from quaestor.llm import tokens
from quaestor.llm.textops import blocks


def test_a_full_table_keeps_the_common_pieces(monkeypatch):
    """Words of every block go through the library once, however many rare ones come by."""
    monkeypatch.setattr(tokens, "KEPT_PIECES", 400)
    encoder = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    asked, library = [], encoder._library_ids
    monkeypatch.setattr(encoder, "_library_ids", lambda pieces: (asked.extend(pieces), library(pieces))[1])
    rng = random.Random(3)
    for _ in range(40):
        rare = ["".join(rng.choices("abcdeéß日", k=9)) for _ in range(60)]
        texts = ["the common words, of every text", " ".join(rare), None, "it's\n\n 42 " + rare[0]]
        for block in blocks(pa.array(texts, pa.string())):
            got = [x.tolist() for x in encoder.encode(block)]
            assert got == [encoder.whole(t or "").tolist() for t in texts]
        assert len(encoder.known) <= 400
    assert asked.count(" common") == 1


def test_more_pieces_than_the_table_holds(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    encoder = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    for at in (0, 30, 500, 20, 0):
        text = " ".join(f"w{i}x" for i in range(at, at + 200))
        (block,) = blocks(pa.array([text, "w1x <|endoftext|> w2x"]))
        assert [x.tolist() for x in encoder.encode(block)] == [encoder.whole(text).tolist(), encoder.whole("w1x <|endoftext|> w2x").tolist()]
