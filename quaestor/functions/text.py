"""Text column functions, built from Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once, even where `use` has lambdas."""
    return F.transform(F.array(value), use)[0]


def terms_in(text: Column, terms: Sequence[str]) -> Column:
    """Those of the given lower-case terms that the text contains, in their order."""
    listed = F.array(*[F.lit(t) for t in terms])
    return bind(F.lower(text), lambda low: F.filter(listed, lambda t: F.contains(low, t)))


# Unicode white space, with the four separators that Java leaves out.
_WHITE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Words between Unicode white space; an empty text has none."""
    return F.filter(F.split(text, _WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def preview(text: Column, limit: int = 500, mark: str = "...") -> Column:
    """The first `limit` characters, with `mark` only when something is cut."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(mark))
    return F.when(F.char_length(text) > limit, cut).otherwise(text)


def contains_ci(text: Column, term: str) -> Column:
    """Literal, case-insensitive contains; null text does not contain anything."""
    return F.coalesce(F.contains(F.lower(text), F.lit(term.lower())), F.lit(False))


def keyword_boost(
    text: Column, score: Column, keyword: str = "indokolás", factor: float = 1.5
) -> Column:
    """Raise the score of a text that holds the keyword, ignoring case and spaces."""
    squeezed = F.lower(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(F.contains(squeezed, F.lit(keyword)), score * factor).otherwise(score)


def common_terms(left: Column, right: Column) -> Column:
    """Distinct lower-case words both texts have, sorted."""
    return F.sort_array(F.array_intersect(words(F.lower(left)), words(F.lower(right))))


def query_term_hits(question: Column, text: Column) -> Column:
    """Number of distinct question words that occur anywhere in the text."""
    terms = F.array_distinct(words(F.lower(question)))
    found = bind(F.lower(text), lambda low: F.filter(terms, lambda t: F.contains(low, t)))
    return F.size(found).cast("long")


def content_key(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.sha2(text, 256))


def normalized_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def assemble_context(
    ranked: DataFrame,
    query_id: str = "query_id",
    id_col: str = "chunk_id",
    text: str = "text",
    max_chars: int = 500,
    separator: str = "\n\n",
    numbered: bool = False,
) -> DataFrame:
    """One context per question from its ranked chunks (at most k of them).

    `numbered` gives the re-ranker's form, `### Document i (ID: ...)`.
    """
    body = preview(F.coalesce(F.col(text), F.lit("")), max_chars)
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit("N/A"))
    if numbered:
        number = F.col("rank").cast("string")
        line = F.concat(F.lit("### Document "), number, F.lit(" (ID: "), identity, F.lit(")\n"), body)
    else:
        line = F.concat(F.lit("### Document ID: "), identity, F.lit("\nContent:\n"), body)
    return (
        ranked.select(query_id, F.struct("rank", line.alias("line")).alias("_entry"))
        .groupBy(query_id)
        .agg(F.sort_array(F.collect_list("_entry")).alias("_entries"))
        .select(
            query_id,
            F.array_join(F.transform("_entries", lambda e: e["line"]), separator).alias("context"),
        )
    )


def fill_prompt(template: str, **values: Column) -> Column:
    """Replace each `{name}` of the template by a column.

    The template is cut at its placeholders, so braces in the values stay.
    """
    parts: list[str | Column] = [template]
    for name, column in values.items():
        marker = "{" + name + "}"
        split: list[str | Column] = []
        for part in parts:
            if isinstance(part, str):
                pieces = part.split(marker)
                for piece in pieces[:-1]:
                    split += [piece, column]
                split.append(pieces[-1])
            else:
                split.append(part)
        parts = split
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])
