"""Chunking and text functions on hand-worked and generated texts."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.functions import vectors as vx
from quaestor.operators.chunking import (
    chunk_fixed,
    chunk_recursive,
    register_chunk_function,
    split_text,
)

MINI_DOCS = [
    ("empty", ""),
    ("null", None),
    ("plain", "abcdefghij" * 3),
    ("newlines", "\n\n\n\n"),
    ("long word", "ab " + "x" * 25 + " cd"),
    ("emoji", "😀" * 12),
    ("accents", "Ő Ű " * 6),
]


def mini_docs(spark):
    return spark.createDataFrame(MINI_DOCS, "doc_id string, text string")


def chunks_of(df):
    found = {}
    for row in df.orderBy("doc_id", "chunk_no").collect():
        found.setdefault(row.doc_id, []).append(row.text)
    return found


def test_split_prefers_coarse_separators():
    text = "aaa bbb\n\nccc ddd\neee"
    assert list(split_text(text, 14, 0)) == ["aaa bbb", "ccc ddd\neee"]
    # The blank line belongs to what follows it, which is now too long.
    assert list(split_text(text, 12, 0)) == ["aaa bbb", "ccc ddd", "eee"]
    assert list(split_text(text, 8, 0)) == ["aaa bbb", "ccc ddd", "eee"]


def test_split_overlaps_by_whole_pieces():
    assert list(split_text("a b c d e f", 5, 2)) == ["a b c", "c d", "d e", "e f"]
    assert list(split_text("abcdefghij", 4, 1)) == ["abcd", "defg", "ghij"]


def test_split_cuts_long_words_by_character():
    assert list(split_text("ab " + "x" * 9 + " cd", 4, 0)) == ["ab", "xxx", "xxxx", "xx", "cd"]


def test_split_of_blank_text_is_empty():
    assert list(split_text("", 5, 1)) == []
    assert list(split_text("\n\n \n", 5, 1)) == []


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet="ab \n😀Ő", max_size=120), st.integers(2, 20), st.integers(0, 19)
)
def test_split_properties(text, size, overlap):
    overlap = min(overlap, size - 1)
    pieces = list(split_text(text, size, overlap))
    assert all(0 < len(p) <= size and p in text for p in pieces)
    # Without overlap the chunks hold every non-space character once, in order.
    plain = "".join("".join(p.split()) for p in split_text(text, size, 0))
    assert plain == "".join(text.split())
    at = 0
    for piece in pieces:
        found = text.find(piece, max(0, at - overlap - size))
        assert found >= 0
        at = found + len(piece)


def test_recursive_chunks_carry_parents(spark):
    docs = mini_docs(spark).withColumn("court", F.lit("X"))
    chunks = chunk_recursive(docs, 10, 2)
    found = chunks_of(chunks)
    assert set(found) == {"plain", "long word", "emoji", "accents"}
    assert found["emoji"] == ["😀" * 10, "😀" * 4]
    assert chunks.columns == ["chunk_id", "text", "chunk_no", "doc_id", "court"]
    assert chunks.select("chunk_id").distinct().count() == chunks.count()


def test_fixed_chunks_end_at_the_text(spark):
    found = chunks_of(chunk_fixed(mini_docs(spark), 10, 3))
    assert found["plain"] == ["abcdefghij", "hijabcdefg", "efghijabcd", "bcdefghij"]
    assert found["emoji"] == ["😀" * 10, "😀" * 5]
    assert "empty" not in found and "null" not in found
    whole = chunks_of(chunk_fixed(mini_docs(spark), 30, 3))
    assert whole["plain"] == ["abcdefghij" * 3]


def test_fixed_and_recursive_agree_without_separators(spark):
    docs = spark.createDataFrame([("d", "q" * 95)], "doc_id string, text string")
    assert chunks_of(chunk_fixed(docs, 20, 5)) == chunks_of(chunk_recursive(docs, 20, 5))


def test_chunk_table_function(spark):
    register_chunk_function(spark)
    rows = spark.sql("SELECT * FROM chunk_text('a b c d e f', 5, 2)").collect()
    assert [(r.chunk_no, r.chunk) for r in rows] == [(0, "a b c"), (1, "c d"), (2, "d e"), (3, "e f")]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [(" a  b\tc ", "A c"), ("", "x"), (None, None)], "text string, other string"
    )
    rows = df.select(
        tx.word_count(F.col("text")),
        tx.contains_ci(F.col("text"), "B"),
        tx.common_terms(F.col("text"), F.col("other")),
        tx.query_term_hits(F.col("other"), F.col("text")),
        tx.preview(F.col("text"), 2),
    ).collect()
    assert tuple(rows[0]) == (3, True, ["a", "c"], 2, " a...")
    assert tuple(rows[1]) == (0, False, [], 0, "")
    assert rows[2][1] is False and rows[2][4] is None


def test_preview_of_two_characters(spark):
    df = spark.createDataFrame([("Test content",), ("ab",)], "t string")
    assert [r[0] for r in df.select(tx.preview(F.col("t"), 2, "..")).collect()] == ["Te..", "ab"]


def test_keyword_boost_ignores_case_and_spaces(spark):
    df = spark.createDataFrame([("INDO KOLÁS itt",), ("semmi",)], "t string")
    rows = df.select(tx.keyword_boost(F.col("t"), F.lit(2.0))).collect()
    assert [r[0] for r in rows] == [3.0, 2.0]


def test_content_keys_differ_by_prefix_and_text(spark):
    df = spark.createDataFrame([("hello",), ("world",)], "t string")
    row = [tuple(r) for r in df.select(tx.content_key("test", F.col("t")), tx.content_key("other", F.col("t"))).collect()]
    assert len({k for pair in row for k in pair}) == 4
    assert row[0][0] == "test:2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_vector_codecs(spark):
    texts = ["[0.1, 0.2, 0.3, 0.4, 0.5]", "", "  ", None, "[1, x]", "nope", "[1, null]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parsed = [r[0] for r in df.select(vx.parse_vector(F.col("t"))).collect()]
    assert [round(x, 4) for x in parsed[0]] == [0.1, 0.2, 0.3, 0.4, 0.5]
    assert parsed[1:] == [None] * 6
    hexes = spark.createDataFrame([("0000803f00000040",), ("xyz",), ("00",), ("",), (None,)], "h string")
    decoded = [r[0] for r in hexes.select(vx.hex_to_vector("h")).collect()]
    assert decoded == [[1.0, 2.0], None, None, None, None]
    back = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert [r[0] for r in back.select(vx.vector_to_hex("v")).collect()] == ["0000803f00000040", None]


def test_vector_measures(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(
        vx.l2_normalize(F.col("a")), vx.l2_normalize(F.col("b")),
        vx.cosine(F.col("a"), F.col("b")), vx.squared_l2(F.col("a"), F.col("b")),
    ).collect()
    assert rows[0][0] == [0.6, 0.8] and rows[0][1] is None
    assert rows[0][2] == 0.0 and rows[0][3] == 25.0
    assert abs(rows[1][2] - 0.5**0.5) < 1e-12


def test_context_and_prompt(spark):
    df = spark.createDataFrame(
        [(1, "c2", "x" * 6, 2), (1, "c1", "short", 1), (2, None, None, 1)],
        "query_id int, chunk_id string, text string, rank int",
    )
    made = {r.query_id: r.context for r in tx.assemble_context(df, max_chars=5).collect()}
    assert made[1] == "### Document ID: c1\nContent:\nshort\n\n### Document ID: c2\nContent:\nxxxxx..."
    assert made[2] == "### Document ID: N/A\nContent:\n"
    numbered = tx.assemble_context(df.filter("query_id = 1"), numbered=True, separator="\n---\n")
    assert numbered.first().context == "### Document 1 (ID: c1)\nshort\n---\n### Document 2 (ID: c2)\nxxxxxx"
    one = spark.createDataFrame([("{question} in context", "why?")], "c string, q string")
    prompt = tx.fill_prompt("C: {context} Q: {question}", context=F.col("c"), question=F.col("q"))
    assert one.select(prompt).first()[0] == "C: {question} in context Q: why?"
