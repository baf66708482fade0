"""Personal data in texts, disguised or plain, with the places in the source.

Plain identifiers (email, ip, card, phone) are found in the text as it is. A
disguised text is first rewritten by a chain of transducers, each of which reads
a tape and writes another one. A tape holds its characters and, beside each, the
source characters it stands for, so a span of the last tape maps back:

1. homoglyphs: full-width and mathematical forms, digits, dashes and blanks of
   any script, Cyrillic and Greek letters that look Latin; what has no width goes;
2. signs in brackets: `(at)`, `[dot]`, `{@}`, `_at_`, and `user @ host`;
3. signs in words: `user at host dot org`, only where a `dot` follows the host;
4. digits in words (English, German, French, Spanish), two or more in a chain,
   `double` and `triple`, `plus` before a digit; letters O and l inside digits.

The same detectors then read the last tape. Their spans are added to the plain
ones, which stay as they are; an added email ends in letters.

Positions count code points, ends are exclusive. All expressions run in time
linear in the text. Null and empty texts have no spans. Repeated rows are
scanned each; null ids are carried. An empty table gives no rows. Only the id
and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.symbols import code_points
from quaestor.llm.textops import Block, map_blocks

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_BLANK = frozenset(" \t")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match at the start of a run of digits fails from its other digits, too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = _left(text, at, done, _LOCAL)
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", done if host else at + 1)


def _addresses(text: str) -> Iterator[Span]:
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") for p in match.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield match.span()


def _luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for match in _CARD.finditer(text):
        a, b = match.span()
        if 13 <= b - a <= 37:
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield a, b


def _phones(text: str) -> Iterator[Span]:
    for match in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in match.group()) <= 15:
            yield match.span()


_DETECTORS: tuple[Callable[[str], Iterator[Span]], ...] = (_emails, _addresses, _cards, _phones)


def detect(text: str) -> list[list[Span]]:
    """Plain identifiers of each kind, ascending."""
    return [list(found(text)) for found in _DETECTORS]


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝѵАВЕКМНОРСТХІЈЅԌαινορτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡıƖ",
        "aeopcyxijshdqwvABEKMHOPCTXIJSGaivoptukABEZHIKMNOPTYXagil",
        strict=True,
    )
)

#: Where characters lie that may stand for an ASCII one.
_SCRIPTS = ((0x80, 0x3100), (0xA000, 0xAC00), (0xFE00, 0x10000), (0x10000, 0x12000), (0x1D400, 0x1D800), (0x1F100, 0x1FC00))

_SAME, _GONE = 0, 1


def _plain(point: int) -> int:
    """The ASCII character that a character stands for, _GONE or _SAME."""
    char = chr(point)
    if char in _LOOKALIKES:
        return ord(_LOOKALIKES[char])
    kind = unicodedata.category(char)
    if kind == "Cf":
        return _GONE
    if kind == "Nd":
        return 48 + unicodedata.decimal(char)
    if kind == "Pd":
        return ord("-")
    if kind == "Zs":
        return ord(" ")
    form = unicodedata.normalize("NFKC", char)
    return ord(form) if len(form) == 1 and " " < form < "\x7f" else _SAME


@lru_cache(maxsize=1)
def _glyphs() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for first, end in _SCRIPTS:
        table[first:end] = [_plain(point) for point in range(first, end)]
    table[[0x3002, 0xFF61, 0x2024, 0x06D4]] = ord(".")
    return table


class Tape:
    """A text, and for each of its characters the source characters it stands for."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, points: np.ndarray) -> Tape:
        """The first transducer: homoglyphs of the source's code points."""
        forms = _glyphs()[points]
        kept = np.flatnonzero(forms != _GONE)
        out = np.where(forms > _GONE, forms, points)[kept].astype("<u4")
        return cls(out.tobytes().decode("utf-32-le"), kept, kept + 1)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Each (start, end, characters) stands for the tape's part between; ascending, apart."""
        if not edits:
            return self
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            texts += [self.text[at:a], new]
            starts.append(self.starts[at:a])
            ends.append(self.ends[at:a])
            if new:
                starts.append(np.full(len(new), self.starts[a]))
                ends.append(np.full(len(new), self.ends[b - 1]))
            at = b
        return Tape("".join(texts), np.concatenate(starts), np.concatenate(ends))

    def source(self, span: Span) -> Span:
        return int(self.starts[span[0]]), int(self.ends[span[1] - 1])


# Words for signs and digits.
_AT = "at|arroba"
_DOT = "dot|punto|punkt|point"
_DIGITS = {
    "0": "zero oh null cero zéro",
    "1": "one eins uno un",
    "2": "two zwei dos deux",
    "3": "three drei tres trois",
    "4": "four vier cuatro quatre",
    "5": "five fünf fuenf cinco cinq",
    "6": "six sechs seis",
    "7": "seven sieben siete sept",
    "8": "eight acht ocho huit",
    "9": "nine neun nueve neuf",
}
_VALUE = {word: digit for digit, words in _DIGITS.items() for word in words.split()}
_TIMES = {"": 1, "double": 2, "triple": 3}

_SIGN = re.compile(rf"(?i)[(\[{{<_][ \t]*+(?:(?P<at>{_AT}|@)|{_DOT}|\.)[ \t]*+[)\]}}>_]")
_SPACED = re.compile(r"(?<=[A-Za-z0-9_%+-])[ \t]*+@[ \t]*+(?=[A-Za-z0-9-])")
_SPELLED = re.compile(
    rf"(?i)(?<=[a-z0-9_%+-])[ \t]++(?:{_AT})[ \t]++"
    rf"(?=[a-z0-9-]++(?:\.[a-z0-9-]++)*+[ \t]++(?:{_DOT})[ \t]++[a-z0-9-])"
)
_BREAK = rf"(?:\.|[ \t]++(?:(?i:{_DOT})[ \t]++|\.[ \t]++(?=[a-z]{{2,6}}(?![A-Za-z0-9]))))"
_HOST = re.compile(rf"@[A-Za-z0-9-]++(?:{_BREAK}[A-Za-z0-9-]++)++")
_INNER = re.compile(rf"(?i)(?<![ \t])[ \t]++(?:{_DOT}|\.)[ \t]++")
_DOTS = frozenset(_DOT.split("|"))
_NUMBER = re.compile(
    rf"(?i)(?<![^\W_])(?:(?P<times>double|triple)[ \t]++)?(?P<word>{'|'.join(sorted(_VALUE, key=len, reverse=True))})(?![^\W_])"
)
_GAP = re.compile(rf"(?i)[ \t,()-]*+(?P<dot>(?:{_DOT}|\.)[ \t]*+)?")
_LETTERS = re.compile(r"(?<=[0-9])[OoIl]++(?=[0-9])")
_PLUS = re.compile(r"(?i)(?<![^\W_])plus[ \t]++(?=[0-9])")

_HINT = re.compile(
    rf"(?i)[(\[{{<_][ \t]*+(?:{_AT}|@|{_DOT}|\.)[ \t]*+[)\]}}>_]|[ \t](?:{_DOT})[ \t]|[ \t]@|@[ \t]|[0-9][OIl]++[0-9]"
    rf"|(?<![^\W_])(?:plus[ \t]++[0-9]|(?:{'|'.join(sorted(_VALUE, key=len, reverse=True))})"
    rf"[ \t,()-]++(?:{'|'.join([*sorted(_VALUE, key=len, reverse=True), 'double', 'triple', _DOT])})(?![^\W_]))"
)


def _blanks_around(text: str, a: int, b: int, floor: int) -> Span:
    a = _left(text, a, floor, _BLANK)
    while b < len(text) and text[b] in " \t":
        b += 1
    return a, b


def _signs(tape: Tape) -> Tape:
    edits, floor = [], 0
    for match in _SIGN.finditer(tape.text):
        a, b = _blanks_around(tape.text, *match.span(), floor)
        edits.append((a, b, "@" if match["at"] else "."))
        floor = b
    tape = tape.rewritten(edits)
    return tape.rewritten([(*m.span(), "@") for m in _SPACED.finditer(tape.text) if m.end() > m.start() + 1])


def _words(tape: Tape) -> Tape:
    tape = tape.rewritten([(*m.span(), "@") for m in _SPELLED.finditer(tape.text)])
    inside = [_INNER.finditer(tape.text, *m.span()) for m in _HOST.finditer(tape.text)]
    tape = tape.rewritten([(*m.span(), ".") for found in inside for m in found])
    return tape.rewritten(_dots_before_at(tape.text))


def _dots_before_at(text: str) -> list[tuple[int, int, str]]:
    """The spelled dots of `jane dot doe@`, read from each sign to the left."""
    edits, floor, at = [], 0, text.find("@")
    while at >= 0:
        own, end = [], at
        while True:
            word = _left(text, end, floor, _LOCAL)
            gap = _left(text, word, floor, _BLANK)
            dot = _left(text, gap, floor, _LOCAL)
            left = _left(text, dot, floor, _BLANK)
            if not (word < end and gap < word and text[dot:gap].lower() in _DOTS and floor < left < dot):
                break
            if text[left - 1] not in _LOCAL:
                break
            own.append((left, word, "."))
            end = left
        edits += reversed(own)
        floor, at = at + 1, text.find("@", at + 1)
    return edits


def _left(text: str, at: int, floor: int, chars: frozenset[str]) -> int:
    """Where the run of `chars` that ends at `at` begins."""
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def _numbers(tape: Tape) -> Tape:
    """Chains of spelled digits become digits, what parts them goes or is a dot."""
    found = list(_NUMBER.finditer(tape.text))
    gaps = [_GAP.fullmatch(tape.text, m.end(), n.start()) for m, n in zip(found, found[1:])]
    edits = []
    for i, match in enumerate(found):
        before = gaps[i - 1] if i else None
        after = gaps[i] if i < len(gaps) else None
        if not (before or after):
            continue
        edits.append((*match.span(), _VALUE[match["word"].lower()] * _TIMES[(match["times"] or "").lower()]))
        if after and after.end() > after.start():
            edits.append((*after.span(), "." if after["dot"] else ""))
    tape = tape.rewritten(edits)
    tape = tape.rewritten([(*m.span(), "+") for m in _PLUS.finditer(tape.text)])
    zero = lambda m: "".join("0" if c in "Oo" else "1" for c in m.group())
    return tape.rewritten([(*m.span(), zero(m)) for m in _LETTERS.finditer(tape.text)])


def clear(points: np.ndarray) -> Tape:
    """The last tape of a source's code points."""
    return _numbers(_words(_signs(Tape.of(points))))


def _proper(kind: int, text: str) -> bool:
    if kind:
        return True
    last = text.rpartition(".")[2]
    return len(last) >= 2 and last.isalpha()


def spans(text: str, points: np.ndarray, disguised: bool) -> tuple[list[list[Span]], list[list[Span]]]:
    """The plain spans and all spans of each kind."""
    base = detect(text)
    if not (disguised or _HINT.search(text)):
        return base, base
    tape = clear(points)
    every = []
    for kind, (own, found) in enumerate(zip(base, detect(tape.text))):
        more = {tape.source(s) for s in found if _proper(kind, tape.text[s[0] : s[1]])}
        every.append(sorted({*own, *more}))
    return base, every


def joined(found: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, found) for a, b in own)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        points, offsets = code_points(block)
        flagged = np.append(0, np.cumsum(_glyphs()[points] != _SAME))[offsets]
        found = [
            spans(block.text(i), points[offsets[i] : offsets[i + 1]], flagged[i + 1] > flagged[i])
            for i in range(len(block))
        ]
        columns = [
            batch.column(0)[block.rows],
            *[pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in range(len(KINDS))],
            pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]),
            pa.array([joined(every) for _, every in found]),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string"
    return own.mapInArrow(lambda batches: map_blocks(batches, 1, make), schema)
