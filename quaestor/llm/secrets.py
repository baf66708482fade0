"""Secret scans by a trigram index: queries from the rules, candidates, checks.

A rule is a regular expression. From its syntax tree follows a Boolean query of
trigrams that every match contains: alternatives are joined by or, sequences by
and, and an optional part or a large character class breaks the text around it.
A block of documents is a segment of the index: for each trigram that some query
names, the ascending list of its documents. The lists are intersected and united
as the query says, and the rule runs on those documents alone. A rule whose query
says nothing runs on all. Trigrams are those of the lower-cased text.

Positions count code points, ends are exclusive. Null and empty texts have no
spans. Repeated rows are scanned each; null ids are carried. An empty table gives
no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.textops import LOWER, Block, map_blocks

_parser = re._parser
_ops = re._constants

#: Strings that an expression can stand for, kept while there are so few.
_MOST_STRINGS = 64

ALL = True
Query = object  # ALL, a trigram, ("and", queries) or ("or", queries)


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates, leftmost first; `valid` drops some of them."""

    kind: str
    pattern: str
    valid: Callable[[re.Match], bool] = lambda m: True


#: The base kinds. Their matches are found first and then judged.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m.group(2)) >= 8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    Rule("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
)

#: Formats that issuers of tokens and keys publish.
MORE_RULES = (
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"\bgithub_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"\bpypi-AgE[A-Za-z0-9_-]{40,}"),
    # From the start of a run on: a run of many such starts is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    # To the line of its end, or as far as lines of base64 go.
    Rule(
        "private_key",
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
        r"(?:(?:(?!-----)[A-Za-z0-9+/=\s\\:;,.()@<>_-])*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
        r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]++={1,2}+)?+)",
    ),
    Rule("session_key", r"\bASIA[A-Z0-9]{16}"),
    Rule("bearer", r"\b[Bb]earer [A-Za-z0-9._~+/-]{24,}=*"),
    Rule("credentials", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)

RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> Query:
    """What trigrams of the lower-cased text a match of `pattern` must contain."""
    strings, query = _sequence(_parser.parse(pattern))
    return _both(query, _of_strings(strings))


def _sequence(items) -> tuple[set[str] | None, Query]:
    """The strings that a sequence stands for, if few, and the query of its parts."""
    strings, query, broken = {""}, ALL, False
    for op, value in items:
        own, part = _item(op, value)
        query = _both(query, part)
        if own is not None and len(strings) * len(own) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
            continue
        query = _both(query, _of_strings(strings))
        if own is not None:
            query = _both(query, _of_strings(own))
        strings, broken = {""}, True
    if broken:
        return None, _both(query, _of_strings(strings))
    return strings, query


def _item(op, value) -> tuple[set[str] | None, Query]:
    if op is _ops.LITERAL:
        return ({chr(value).lower()}, ALL) if value < 128 else (None, ALL)
    if op is _ops.IN:
        chars = set()
        for kind, v in value:
            if kind is not _ops.LITERAL or v >= 128:
                return None, ALL
            chars.add(chr(v).lower())
        return chars, ALL
    if op is _ops.AT or op in (_ops.ASSERT, _ops.ASSERT_NOT):
        return {""}, ALL
    if op is _ops.SUBPATTERN:
        return _sequence(value[-1])
    if op is _ops.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*[s for s, _ in parts])
            if len(strings) <= _MOST_STRINGS:
                return strings, _either([q for _, q in parts])
        return None, _either([_both(q, _of_strings(s)) for s, q in parts])
    if op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if least == 0:
            return (strings | {""}, ALL) if most == 1 and strings is not None else (None, ALL)
        if least == most == 1:
            return strings, query
        return None, _both(query, _of_strings(strings))
    return None, ALL


def _of_strings(strings: set[str] | None) -> Query:
    """One of the strings occurs."""
    if strings is None or any(len(s) < 3 for s in strings):
        return ALL
    each = []
    for s in sorted(strings):
        parts = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        each.append(("and", tuple(parts)) if len(parts) > 1 else parts[0])
    return _either(each)


def _both(a: Query, b: Query) -> Query:
    if a is ALL or a == b:
        return b
    return a if b is ALL else ("and", (a, b))


def _either(queries: list[Query]) -> Query:
    if any(q is ALL for q in queries):
        return ALL
    distinct = tuple(dict.fromkeys(queries))
    return distinct[0] if len(distinct) == 1 else ("or", distinct)


def _trigrams(query: Query) -> set[str]:
    if query is ALL:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*[_trigrams(q) for q in query[1]])


class Scanner:
    """Compiled rules, their queries, and the trigrams that the index lists."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        listed = sorted(set().union(*[_trigrams(q) for q in self.queries]))
        self.number = {t: i for i, t in enumerate(listed, 1)}
        # 2^24 places: the number of the trigram, 0 for others.
        self.table = np.zeros(1 << 24, np.uint8 if len(listed) < 256 else np.uint16)
        for trigram, i in self.number.items():
            a, b, c = trigram.encode()
            self.table[a << 16 | b << 8 | c] = i

    def postings(self, block: Block) -> list[np.ndarray]:
        """The ascending documents of each listed trigram."""
        low = LOWER[block.data].astype(np.int32)
        if len(low) < 3:
            return [np.zeros(0, np.int64)] * (len(self.number) + 1)
        found = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        document = np.searchsorted(block.offsets, at, side="right") - 1
        inside = at + 2 < block.offsets[document + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) << 32 | document[inside])
        cuts = np.searchsorted(pairs >> 32, np.arange(1, len(self.number) + 1))
        return np.split(pairs & 0xFFFFFFFF, cuts)

    def candidates(self, query: Query, lists: list[np.ndarray], size: int) -> np.ndarray:
        """Documents that satisfy a query."""
        if query is ALL:
            return np.arange(size)
        if isinstance(query, str):
            return lists[self.number[query]]
        parts = [self.candidates(q, lists, size) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        for part in parts[1:]:
            parts[0] = np.intersect1d(parts[0], part, assume_unique=True)
        return parts[0]

    def scan(self, block: Block) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule) of every span of every document, by start, then rule."""
        lists, texts = self.postings(block), {}
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(block))]
        for r, (rule, compiled, query) in enumerate(zip(self.rules, self.compiled, self.queries)):
            for d in self.candidates(query, lists, len(block)).tolist():
                if d not in texts:
                    texts[d] = block.text(d)
                for match in compiled.finditer(texts[d]):
                    if rule.valid(match):
                        spans[d].append((*match.span(), r))
        return [sorted(s, key=lambda x: (x[0], x[2])) for s in spans]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def joined(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[r]}:{a}:{b}" for a, b, r in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    kinds, base = [r.kind for r in RULES], len(BASE_RULES)

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        spans = scanner().scan(block)
        counts = [[sum(r == k for _, _, r in s) for s in spans] for k in range(base)]
        digests = [
            hashlib.sha256(joined([x for x in s if x[2] < base], kinds).encode()).hexdigest() for s in spans
        ]
        columns = [
            batch.column(0)[block.rows],
            *[pa.array(c, pa.int64()) for c in counts],
            pa.array(digests),
            pa.array([joined(s, kinds) for s in spans]),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return own.mapInArrow(lambda batches: map_blocks(batches, 1, make), schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each secret replaced by its kind in brackets, as `[hex]`.

    Overlapping spans become one, named after the first. A null text stays null.
    """
    names = docs.columns
    kinds, at = [r.kind for r in RULES], names.index(text_col)

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        rows = batch.slice(block.first, len(block))
        spans = scanner().scan(block)
        if not any(spans):
            return rows
        texts = rows.column(at).to_pylist()
        for i, own in enumerate(spans):
            if own:
                texts[i] = _without(texts[i], own, kinds)
        columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(rows.columns)]
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(lambda batches: map_blocks(batches, at, make), docs.schema)


def _without(text: str, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, rule = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kinds[rule]}]"]
        at = end
    return "".join([*out, text[at:]])
