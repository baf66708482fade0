"""URL filters: pattern rules found by their rarest literal token.

A rule is a pattern over `host/path?query#fragment` of a URL: `||` stands for
the begin of the host or of one of its parents, `^` for a character that no
name has (or the end), `*` for anything, all else for itself. A token is a run
of `[a-z0-9]`; a pattern names those of its tokens that a fitting URL must have
whole. How many URLs hold each named token is counted over the whole table, and
every rule is filed under its rarest one. A URL's tokens fetch the rules filed
under them, and only those run their expressions; rules without such a token
run on every URL.

Site rules come first: of those that fit, the longest decides. Otherwise a
pattern that allows decides over one that blocks, and a URL that no rule fits is
allowed.

A null url, or one without `://`, has an empty host and path, so no rule fits.
Repeated rows are judged each; null ids are carried. An empty table gives no
rows. Only the id and url columns are read, and nothing is shuffled but the
token counts, whose number the rules bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The site rules, as host and path.
SITE_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

#: Patterns for pages that are not worth a crawl: traps, duplicates by tracking, shops' machinery.
PATTERN_RULES = (
    ("block", "||spam-farm.*^"),
    ("block", "||casino.*^"),
    ("block", "||ads.*^"),
    ("block", "||adserver.*^"),
    ("block", "||doubleclick.net^"),
    ("block", "^utm_source="),
    ("block", "^utm_campaign="),
    ("block", "^gclid="),
    ("block", "^fbclid="),
    ("block", "^sessionid="),
    ("block", "^phpsessid="),
    ("block", "/login^"),
    ("block", "/signup^"),
    ("block", "/cart^"),
    ("block", "/checkout^"),
    ("block", "/wp-admin^"),
    ("block", "/cgi-bin/"),
    ("block", "/search?q="),
    ("block", "/calendar/*^month="),
    ("block", ".exe^"),
    ("block", ".zip^"),
    ("allow", "||docs.*/cart^"),
    ("allow", "||wiki.*^"),
    ("allow", "/login/help^"),
)

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def compile_rule(verdict: str, pattern: str, site: bool = False) -> Rule:
    """Expression and whole tokens of a pattern.

    Site rules end at a prefix of the path that they name in full, and their path
    is compared in its own case; patterns are compared in lower case.
    """
    body = pattern.removeprefix("||")
    parts = [".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body]
    begin = r"^(?:[^/?#]*\.)?" if site or body != pattern else ""
    tokens = []
    for found in _TOKEN.finditer(body.lower()):
        # A token that may go on, at an open end or beside a star, isn't whole.
        before, after = body[: found.start()][-1:], body[found.end() :][:1]
        open_before = before == "*" or (not before and not begin)
        if not open_before and after and after != "*":
            tokens.append(found.group())
    return Rule(verdict, pattern, begin + "".join(parts), tuple(dict.fromkeys(tokens)), site)


def default_rules() -> list[Rule]:
    return [compile_rule(v, p, site=True) for v, p in SITE_RULES] + [
        compile_rule(v, p) for v, p in PATTERN_RULES
    ]


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token that a rule names; one row per token comes back."""
    named = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(_subject(F.col(url_col))), F.lit("([a-z0-9]+)")))
    held = F.array_intersect(tokens, F.lit(named).cast("array<string>"))
    counted = pages.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return {r.token: r.n for r in counted.collect()}


def file_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and those that have none."""
    index: dict[str, list[int]] = {}
    rest = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            rest.append(i)
    return index, rest


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")


def _subject(url: Column) -> Column:
    return F.coalesce(_after_scheme(url), F.lit(""))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge_urls(
    pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row."""
    rules = default_rules() if rules is None else rules
    index, rest = file_rules(rules, token_counts(pages, rules, url_col))
    subject = _subject(F.col(url_col))
    host = _ascii_lower(F.regexp_extract(subject, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(subject, r"(?s)^[^/?#]*([^?#]*)", 1)
    own = pages.select(
        F.col(id_col).alias("page_id"),
        host.alias("host"),
        path.alias("path"),
        F.regexp_extract(subject, r"(?s)^[^?#]*(.*)", 1).alias("rest"),
    )
    kind = own.schema["page_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.regex, re.DOTALL) for r in rules]
        for batch in batches:
            hosts, paths, rests = (batch.column(i).to_pylist() for i in (1, 2, 3))
            judged = [decide(*row, compiled) for row in zip(hosts, paths, rests)]
            columns = [*batch.columns[:3], *[pa.array([j[i] for j in judged], pa.string()) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict", "pattern"])

    def decide(host: str, path: str, rest: str, compiled: list[re.Pattern]) -> tuple:
        site = host + path
        whole = (site + rest).lower()
        fetched = set(rest_of)
        for token in set(_TOKEN.findall(whole)):
            fetched.update(index.get(token, ()))
        fits = [i for i in sorted(fetched) if compiled[i].search(site if rules[i].site else whole)]
        sites = [i for i in fits if rules[i].site]
        if sites:
            best = max(sites, key=lambda i: len(rules[i].text))
            return rules[best].text, rules[best].verdict, None
        allows = [i for i in fits if rules[i].verdict == "allow"]
        first = next(iter(allows or fits), None)
        if first is None:
            return None, "allow", None
        return None, rules[first].verdict, rules[first].text

    rest_of = tuple(rest)
    schema = f"page_id {kind}, host string, path string, rule string, verdict string, pattern string"
    return own.mapInArrow(task, schema)
